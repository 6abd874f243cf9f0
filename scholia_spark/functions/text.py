"""Text and number scalars as Column expressions; all run inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia_spark.functions import patterns

#: Phrases that mark a withdrawn paper.
WITHDRAWAL_MARKERS = (
    "this paper has been withdrawn",
    "this article has been withdrawn",
    "withdrawn by the author",
    "withdrawn by authors",
    "paper withdrawn",
)
#: Hosts and path prefixes of licences that admit a paper.
LICENSE_RULES = (
    ("creativecommons.org", "/licenses/by/"),
    ("creativecommons.org", "/licenses/by-sa/"),
    ("creativecommons.org", "/publicdomain/zero/"),
    ("arxiv.org", "/licenses/nonexclusive-distrib"),
)
MAX_QUERY_CHARS = 500
SNIPPET_CHARS = 280


def normalize_text(x: Column) -> Column:
    """Runs of Unicode white space become one blank; no blanks at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def alnum_key(x: Column) -> Column:
    """X4."""
    return F.lower(F.regexp_replace(x, "[^0-9A-Za-z]+", ""))


def snippet(x: Column, n: int = SNIPPET_CHARS) -> Column:
    """Texts of at most ``n`` characters as they are, else ``n - 1`` characters and an ellipsis."""
    clean = normalize_text(x)
    return F.when(F.length(clean) <= n, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, n - 1)), F.lit("...")))


def tokens(x: Column) -> Column:
    """Words in lower case, split at white space."""
    return F.array_remove(F.split(F.lower(x), r"(?U)\s+"), "")


def estimate_tokens(x: Column) -> Column:
    """X20."""
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("long")


def rate_tokens(x: Column) -> Column:
    """X21."""
    return F.greatest(F.lit(1), F.floor(F.length(x) * 2 / 7)).cast("long")


def label_tokens(x: Column) -> Column:
    """Tokens of a section label without its prefix and punctuation."""
    bare = F.regexp_replace(x, r"(?i)^\s*(?:section\b|sec\.|§)\s*[:.\-]?\s*", "")
    return F.array_remove(F.split(F.lower(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", " ")), r"\s+"), "")


def contiguous(needle: Column, hay: Column) -> Column:
    """The token array ``needle`` is a run of ``hay``."""
    pad = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return (F.size(needle) > 0) & (F.instr(pad(hay), pad(needle)) > 0 if isinstance(needle, str) else F.contains(pad(hay), pad(needle)))


def query_status(raw: Column) -> Column:
    """ok, or the first check that fails: control characters, empty, too long."""
    clean = normalize_text(raw)
    control = F.regexp_like(raw, F.lit("[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x84\\x86-\\x9f]"))
    return F.when(raw.isNull(), "type").when(control, "control").when(clean == "", "empty").when(F.length(clean) > MAX_QUERY_CHARS, "too_long").otherwise("ok")


def license_allowed(url: Column) -> Column:
    """F2."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    host = F.lower(F.regexp_extract(raw, r"^https?://([^/:?#]*)", 1))
    path = F.lower(F.regexp_extract(raw, r"^https?://[^/?#]*(/[^?#]*)", 1))
    rules = [(host == h) & path.startswith(p) for h, p in LICENSE_RULES]
    ok = rules[0]
    for r in rules[1:]:
        ok = ok | r
    return ok


def license_url(value: Column) -> Column:
    """canonical licence address of an address or a short name, else null."""
    raw = F.trim(value)
    host = F.lower(F.regexp_extract(raw, r"^https?://([^/:?#]*)", 1))
    path = F.lower(F.regexp_extract(raw, r"^https?://[^/?#]*(/[^?#]*)", 1))
    known = ((host == "creativecommons.org") & (path.startswith("/licenses/") | path.startswith("/publicdomain/"))) | ((host == "arxiv.org") & path.startswith("/licenses/nonexclusive"))
    cc = F.translate(F.lower(raw), "_ ", "--")
    root = "https://creativecommons.org/"
    return (
        F.when(known, raw).when(cc.isin("cc-by", "ccby"), root + "licenses/by/4.0/")
        .when(cc.isin("cc-by-sa", "ccbysa"), root + "licenses/by-sa/4.0/").when(cc.isin("cc0", "cc-zero"), root + "publicdomain/zero/1.0/")
    )


def withdrawn(*parts: Column) -> Column:
    """any marker occurs in the joined parts."""
    return F.regexp_like(F.lower(F.concat_ws(" ", *parts)), F.lit("|".join(WITHDRAWAL_MARKERS)))


def strip_noise_lines(text: Column) -> Column:
    """lines that are page numbers, and short lines of copyright, affiliation or running heads, go."""
    short = lambda line: F.length(F.trim(line)) <= patterns.NOISE_LINE_CHARS
    has = lambda line, pattern: F.regexp_like(line, F.lit(pattern))
    noise = lambda line: has(line, patterns.COPYRIGHT) | has(line, patterns.AUTHOR) | has(line, patterns.RUNNING_HEAD)
    keep = lambda line: ~(has(line, patterns.PAGE_NUMBER) | (short(line) & noise(line)))
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def summary_numbers(text: Column) -> Column:
    """Numbers with thousands separators."""
    return F.regexp_extract_all(text, F.lit(patterns.SUMMARY_NUMBER), 0)


def evidence_numbers(text: Column) -> Column:
    """Numbers without letters, digits or a point beside them; a percent sign belongs to them."""
    return F.regexp_extract_all(text, F.lit(patterns.EVIDENCE_NUMBER), 0)


def number_value(token: Column) -> Column:
    return F.regexp_replace(token, "[,%]", "").cast("double")


def number_grounded(token: Column, values: Column) -> Column:
    """Some value, its hundredth or hundredfold is within half a unit of the token's last decimal."""
    v = number_value(token)
    decimals = F.length(F.regexp_extract(token, r"\.(\d+)", 1))
    slack = F.lit(0.5) * F.pow(F.lit(10.0), -decimals.cast("double")) + F.lit(1e-9)
    forms = F.array(v, F.when(v > 1, v / 100).otherwise(v * 100))
    return F.exists(values, lambda d: F.exists(forms, lambda f: F.abs(f - d) <= F.lit(1e-9)) | (F.abs(v - d) <= slack))


def usd_estimate(input_tokens: Column, output_tokens: Column, per_million_in: float = 3.0, per_million_out: float = 15.0) -> Column:
    """N7."""
    return input_tokens * per_million_in / 1e6 + output_tokens * per_million_out / 1e6


def box_overlap(a: list[Column], b: list[Column]) -> Column:
    """Area shared by two boxes (x0, y0, x1, y1); 0 when they are apart."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def final_jamo(term: Column) -> Column:
    """Number of the final consonant of a Hangul syllable at the end, 0 without one, null for other endings."""
    code = F.ascii(F.right(term, F.lit(1)))
    return F.when(code.between(0xAC00, 0xD7A3), (code - 0xAC00) % 28)


def _placed(index: Column) -> Column:
    """Words of a map word -> positions, as structs (position, number of the entry, word) in order."""
    pairs = F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w"))))
    return F.sort_array(F.flatten(pairs))


def inverted_text(index: Column) -> Column:
    """SRC19: text of a map word -> positions, all words in the order of their positions."""
    return F.array_join(F.transform(_placed(index), lambda s: s["w"]), " ")


def inverted_text_of_slots(index: Column) -> Column:
    """SRC20: one word a position; of words at one position that of the later entry stays."""
    last = lambda s, t: F.when(t.isNull() | (s["p"] != t["p"]), s["w"])
    # as the variable of a lambda the array is built once; named inside one it would be built anew for each element
    words = F.transform(F.array(_placed(index)), lambda a: F.zip_with(a, F.slice(a, F.lit(2), F.size(a)), last))
    return F.array_join(words[0], " ")
