"""Scalars that need Python: Unicode normal forms, case folding, number forms, particles. Arrow batches, never row by row in the plan."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@F.pandas_udf(StringType())
def nfc_query(raw: pd.Series) -> pd.Series:
    """NFC, then white space collapsed and stripped."""
    return raw.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).split()))


@F.pandas_udf(StringType())
def saved_query(raw: pd.Series) -> pd.Series:
    """X2, then case folding."""
    return raw.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).split()).casefold())


@F.pandas_udf(ArrayType(StringType()))
def number_forms(tokens: pd.Series) -> pd.Series:
    """The token as written, its %g form, and its hundredth (above 1) or hundredfold."""

    def forms(token):
        bare = token.replace(",", "").rstrip("%")
        value = float(bare)
        return sorted({bare, f"{value:g}", f"{value / 100 if value > 1 else value * 100:g}"})

    return tokens.map(lambda t: None if t is None else forms(t))


#: Particle pairs (after a consonant, after a vowel).
PARTICLES = {"은": ("은", "는"), "는": ("은", "는"), "이": ("이", "가"), "가": ("이", "가"), "을": ("을", "를"), "를": ("을", "를"), "과": ("과", "와"), "와": ("과", "와"), "으로": ("으로", "로"), "로": ("으로", "로")}


def particle(mark: str, final: int | None) -> str:
    """The form that agrees with the final consonant; after ㄹ (8) the short direction particle stands."""
    if mark not in PARTICLES or final is None:
        return mark
    consonant, vowel = PARTICLES[mark]
    if consonant == "으로" and final == 8:
        return vowel
    return consonant if final else vowel


def roman_value(token: str) -> int | None:
    """Value of a Roman numeral, null for other strings."""
    worth = dict(zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True))
    marks = [worth.get(c) for c in token.upper()]
    if not marks or None in marks:
        return None
    return sum(-a if a < b else a for a, b in zip(marks, [*marks[1:], 0], strict=True))
