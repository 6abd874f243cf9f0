"""Macros of TeX sources; an Arrow UDF, since braces nest."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia_spark.session import ship_active

MAX_MACROS, MAX_BODY = 512, 400
DEFINITION = re.compile(r"\\(newcommand|renewcommand|providecommand|DeclareMathOperator|def)(?![A-Za-z])(\*?)\s*")
NAME = re.compile(r"\{?\s*(\\(?:[A-Za-z]+|.))\s*\}?\s*")
ARITY = re.compile(r"(?:\[[^\]]*\]\s*)*")
PARAMETERS = re.compile(r"(?:#\d\s*)*")
#: Commands that could run, load or redefine something where formulas are shown.
DANGEROUS_COMMANDS = (
    "href url includegraphics html htmlClass htmlId htmlData htmlStyle def edef gdef xdef let futurelet newcommand renewcommand providecommand "
    "input include catcode expandafter csname endcsname immediate write openout special"
).split()
DANGEROUS = re.compile(rf"\\(?:{'|'.join(DANGEROUS_COMMANDS)})(?![A-Za-z])")


def braced(text: str, at: int) -> tuple[str | None, int]:
    """Contents of the group that opens at ``at``, and the place behind it; null where none opens or it never closes."""
    if text[at : at + 1] != "{":
        return None, at
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.S).finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0:
            return text[at + 1 : m.start()], m.end()
    return None, at


def macros_of(source: str | None) -> dict[str, str]:
    """Name -> expansion, later definitions win; too long and dangerous ones are left out."""
    text = re.sub(r"(?<!\\)%.*", "", source or "")
    found: dict[str, str] = {}
    at = 0
    while len(found) < MAX_MACROS and (m := DEFINITION.search(text, at)):
        at = m.end()
        name = NAME.match(text, at)
        if not name:
            continue
        gap = PARAMETERS if m[1] == "def" else ARITY
        body, end = braced(text, gap.match(text, name.end()).end())
        if body is None:
            continue
        at = end
        if m[1] == "DeclareMathOperator":
            body = f"\\operatorname{m[2]}{{{body}}}"
        if len(body) <= MAX_BODY and not DANGEROUS.search(body):
            found[name[1]] = body
    return found


def macros(source: Column) -> Column:
    """X36 as a map column; null sources give an empty map."""

    ship_active()

    @F.pandas_udf("map<string,string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(macros_of)

    return run(source)
