"""Formulas of HTML as TeX: the author's source where the element carries it, else the presentation tree.

Works on element nodes with ``name``, ``attrs``, ``kids`` and ``text()``, as the document parsers build them.

A source is read once from left to right: each command is looked up in a table that says which arguments go with it and what
stands in its place. A tree is folded with a stack: an element is written when all its children are, by the number of
children that the MathML standard requires of it. Missing children are empty and further ones follow behind. In tables a child
that is no row is a row of its own, and a child of a row that is no cell is a cell, as the standard implies them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from scholia_spark.functions.tex import DANGEROUS_COMMANDS

# Delimiters around a source; commands without a meaning in a formula, by what goes with them; marks over a symbol.
DELIMITERS = (("$$", "$$"), ("\\[", "\\]"), ("\\(", "\\)"), ("$", "$"))
LAYOUT = "centering raggedright raggedleft centerline noindent par hfill vfill hfil vfil medskip smallskip bigskip newline linebreak newpage clearpage protect xspace unskip leafmode"
REFERENCES = "eqref ref cref Cref cpageref autoref pageref nameref vref labelcref"
CITATIONS = "cite citep citet citeauthor citeyear citealp citealt citenum footcite parencite textcite"
SIZES = "big Big bigg Bigg"
ACCENTS = {
    "^": "\\hat", "ˆ": "\\hat", "~": "\\tilde", "˜": "\\tilde", "ˉ": "\\bar", "¯": "\\bar", "‾": "\\bar", "→": "\\vec", "⃗": "\\vec",
    "˙": "\\dot", ".": "\\dot", "¨": "\\ddot", "ˇ": "\\check", "˘": "\\breve", "´": "\\acute", "`": "\\grave",
}


@dataclass(frozen=True)
class Gone:
    """A command that goes with ``groups`` groups in braces (and brackets before them); without them it stays."""

    groups: int = 0
    brackets: bool = False
    instead: str = " "


COMMANDS = {name: Gone(instead="") for name in [*LAYOUT.split(), *DANGEROUS_COMMANDS]} | {"label": Gone(1, instead=""), "mathversion": Gone(1)}
COMMANDS |= {name: Gone(1) for name in REFERENCES.split()} | {name: Gone(1, True) for name in CITATIONS.split()}
COMMANDS |= {"color": Gone(1, True), "colorbox": Gone(1, True), "Colorbox": Gone(1, True), "fcolorbox": Gone(2, True), "fColorbox": Gone(2, True), "definecolor": Gone(3, True)}
COMMANDS |= {"lstinline": Gone(), "leavevmode": Gone()}
RENAMED = {"mbox": "text", "hbox": "text"}

_PIECE = re.compile(r"\\(?P<private>(?:lst)?@[A-Za-z@]+)|\\(?P<name>[A-Za-z]+)|(?P<image>(?i:\[image\s*#?\s*\d+\]))|(?P<tag>\{ltx_lst_[A-Za-z_]*\})")
_BRACKETS, _GROUP = re.compile(r"(?:\s*\[[^\]]*\])*"), re.compile(r"\s*\{[^{}]*\}")
_DELIMITER = re.compile(r"\s*\{\s*(\\[A-Za-z]+|\\[{}|]|[()\[\].|/])\s*\}")
_SIZED = {size + side for size in SIZES.split() for side in ("", "l", "r", "m", "L", "R", "M")}


def _behind(source: str, at: int, rule: Gone) -> int | None:
    """Where the arguments of a command end that ends at ``at``; null where one is missing."""
    if rule.brackets:
        at = _BRACKETS.match(source, at).end()
    for _ in range(rule.groups):
        group = _GROUP.match(source, at)
        if group is None:
            return None
        at = group.end()
    return at


def clean(source: str) -> str:
    """Without commands of layout, colour, references and programs; boxes become text, sized delimiters lose their group."""
    out, at = [], 0
    for found in _PIECE.finditer(source):
        if found.start() < at:  # within arguments that are gone
            continue
        out.append(source[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            out.append("" if found["image"] or (found["private"] or "").startswith("@") else " ")
        elif name in COMMANDS and (end := _behind(source, at, COMMANDS[name])) is not None:
            out.append(COMMANDS[name].instead)
            at = end
        elif name in _SIZED and (group := _DELIMITER.match(source, at)):
            out.append(f"\\{name}{group[1]} ")
            at = group.end()
        else:
            out.append("\\" + RENAMED.get(name, name))
    return re.sub(r"[ \t]{2,}", " ", "".join([*out, source[at:]])).strip()


def undelimited(source: str) -> str:
    for left, right in DELIMITERS:
        if len(source) > len(left) + len(right) and source.startswith(left) and source.endswith(right):
            return source[len(left) : -len(right)].strip()
    return source


#: Of the elements with a fixed number of children: the TeX of those. Capitals are braced where they are longer than a sign.
REQUIRED = {
    "mfrac": "\\frac{{{a}}}{{{b}}}", "mroot": "\\sqrt[{b}]{{{a}}}", "msub": "{A}_{B}", "msup": "{A}^{B}", "munder": "{A}_{B}", "mover": "{A}^{B}",
    "msubsup": "{A}_{B}^{C}", "munderover": "{A}_{B}^{C}",
}
TOKENS = {"mi", "mn", "mo", "mtext", "ms"}
UNSEEN = {"annotation", "annotation-xml", "mspace", "none"}


def _braced(tex: str) -> str:
    return tex if len(tex) < 2 else f"{{{tex}}}"


def _children(node) -> list:
    return [k for k in node.kids if not isinstance(k, str) or k.strip()]


def _as_table(node, name: str, tex: list[str]) -> str:
    """A table of its rows, a row of its cells, and a cell: each as the element above takes it."""
    if name == "mtd":
        return "".join(tex)
    cells = " & ".join(tex)
    if name == "mtr":
        return cells
    rows = " \\\\ ".join(r for r in tex if r)
    return f"\\begin{{matrix}} {rows} \\end{{matrix}}" if rows else ""


def _written(node, tex: list[str]) -> str:
    """An element whose children are written."""
    name = node.name
    if name == "semantics":  # the other children say the same in other languages
        return tex[0] if tex else ""
    if name in ("mtable", "mtr", "mtd"):
        return _as_table(node, name, tex)
    if name == "msqrt":
        return f"\\sqrt{{{''.join(tex)}}}"
    if name == "mfenced":
        return node.attrs.get("open", "(") + "".join(tex) + node.attrs.get("close", ")")
    if name in REQUIRED:
        form = REQUIRED[name]
        many = form.lower().count("{a}") + form.lower().count("{b}") + form.lower().count("{c}")
        mark = _children(node)[1:2]
        if name == "mover" and mark:
            stated = not isinstance(mark[0], str) and mark[0].attrs.get("accent") == "true"
            accent = ACCENTS.get(tex[1].strip(), "\\hat" if stated else None)
            if accent:
                return f"{accent}{{{tex[0]}}}" + "".join(tex[2:])
        given = (tex + [""] * many)[:many]
        return form.format(**dict(zip("abc", given)), **dict(zip("ABC", map(_braced, given)))) + "".join(tex[many:])
    return "".join(tex)


def tree(top) -> str:
    """TeX of a presentation element or a piece of text."""
    done: list[list[str]] = [[]]
    stack = [(top, False)]
    while stack:
        node, open_ = stack.pop()
        if isinstance(node, str):
            done[-1].append(node.strip())
        elif open_:
            tex = done.pop()
            done[-1].append(_written(node, tex))
        elif node.name in TOKENS:
            done[-1].append(node.text().strip())
        elif node.name in UNSEEN:
            done[-1].append("")
        else:
            done.append([])
            stack.append((node, True))
            stack += [(k, False) for k in reversed(_children(node))]
    tex = done[0][0]
    # a row without a table is one of its own
    return _as_table(top, "mtable", [tex]) if not isinstance(top, str) and top.name in ("mtr", "mtd") else tex


def latex_of(math) -> str:
    """The alternative text, else the presentation tree, else (where that shows nothing) a TeX annotation; cleaned."""
    source = (math.attrs.get("alttext") or "").strip()
    if source:
        return clean(undelimited(source))
    shown = tree(math).strip()
    if not shown:
        shown = next((" ".join(n.text().split()) for n in math.walk() if n.name == "annotation" and n.attrs.get("encoding") == "application/x-tex"), "")
    return clean(shown)
