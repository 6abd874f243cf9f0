"""Text refinement, term masks, batching and rendering of translations and partial summaries."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia_spark.functions import patterns
from scholia_spark.functions.unicode import PARTICLES, particle
from scholia_spark.session import ship_active, ship_package

#: What refinement reports of a body: column -> pattern.
FOUND = {"captions": re.compile(patterns.CAPTION), "formulas": re.compile(patterns.FORMULA), "preserved": re.compile(patterns.PRESERVED)}
REFINED = "body string, captions array<string>, formulas array<string>, preserved array<string>, sections array<struct<label:string,start:int,end:int>>, token_count long"


def _tokens(text: str) -> int:
    return max(1, len(text) // 4)


def is_noise(line: str) -> bool:
    """Page numbers, and short lines of copyright, affiliation or running heads; long lines are prose that mentions them."""
    if re.match(patterns.PAGE_NUMBER, line):
        return True
    short = len(line.strip()) <= patterns.NOISE_LINE_CHARS
    return short and any(re.search(p, line) for p in (patterns.COPYRIGHT, patterns.AUTHOR, patterns.RUNNING_HEAD))


def refine_text(raw: str | None) -> dict:
    """Body without control characters, references and noise lines; what its patterns find. Null counts as empty."""
    clean = re.sub(patterns.CONTROL, "", raw or "")
    end = re.search(patterns.REFERENCES, clean)
    lines = (clean[: end.start()] if end else clean).splitlines()
    body = "\n".join(line for line in lines if not is_noise(line)).strip()
    out = {column: [m.group().strip() for m in pattern.finditer(body)] for column, pattern in FOUND.items()}
    sections = [{"label": m.group().strip(), "start": m.start(), "end": m.end()} for m in re.finditer(patterns.SECTION, body)]
    return {"body": body, **out, "sections": sections, "token_count": _tokens(body)}


def refine(raw: Column) -> Column:
    """Struct of REFINED."""

    ship_active()

    @F.pandas_udf(REFINED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([refine_text(x) for x in texts], columns=["body", "captions", "formulas", "preserved", "sections", "token_count"])

    return run(raw)


def windows(body: str, starts: list[int], budget: int, overlap: int) -> list[str]:
    """Pieces between section starts, cut to the budget's characters, packed while the estimate fits; each next window begins with the last ``overlap`` characters."""
    edges = sorted({0, len(body), *(s for s in starts if 0 <= s <= len(body))})
    limit = budget * 4
    parts = [body[i : min(i + limit, b)] for a, b in zip(edges, edges[1:], strict=False) for i in range(a, b, limit)]
    done, now = [], ""
    for part in parts:
        if now and _tokens(now) + _tokens(part) > budget:
            done.append(now)
            now = now[-overlap:] if overlap else ""
        now += part
    return [*done, now] if now.strip() else done


def map_reduce_chunks(docs: DataFrame, budget: int = 30_000, overlap: int = 2_000) -> DataFrame:
    """Docs (doc_id, text) to windows of the refined body. A document is one row, so nothing is grouped or shuffled."""

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, raw in zip(pdf["doc_id"], pdf["text"], strict=True):
                r = refine_text(raw)
                cut = windows(r["body"], [s["start"] for s in r["sections"]], budget, overlap)
                rows += [(doc, i, w, _tokens(w)) for i, w in enumerate(cut)]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "body", "token_count"])

    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ordinal int, body string, token_count long")


def segment_batches(segments: DataFrame, budget: int = 3_500) -> DataFrame:
    """Segments (doc_id, ord, text) numbered by batch in order; a segment over the budget has a batch of its own."""

    def run(batches):
        doc, batch, used = None, 0, 0
        for pdf in batches:
            out = []
            for d, n in zip(pdf["doc_id"], pdf["n"], strict=True):
                if d != doc:
                    doc, batch, used = d, 0, 0
                if used and used + n > budget:
                    batch, used = batch + 1, 0
                used += n
                out.append(batch)
            yield pdf[["doc_id", "ord"]].assign(batch=out)

    sized = segments.select("doc_id", "ord", F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)).cast("long").alias("n"))
    ship_package(sized.sparkSession)
    return sized.repartition("doc_id").sortWithinPartitions("doc_id", "ord").mapInPandas(run, "doc_id long, ord long, batch int")


#: Whether the Korean reading of a kept English term ends in a consonant.
READING_FINALS = {
    "transformer": False, "bert": False, "gpt": False, "bart": False, "roberta": False, "clip": True, "resnet": True, "u-net": True, "cnn": True,
    "rnn": True, "lstm": True, "gan": True, "gnn": True, "lora": False, "rag": True, "fine-tuning": True, "llm": True, "sota": False, "relu": False,
    "adam": True, "sgd": False, "imagenet": True, "bleu": False, "rouge": False, "f1": True, "auc": False, "iou": False,
}
TOKEN = re.compile(rf"⟦\s*G\s*(\d+)\s*⟧(?:({'|'.join(sorted(PARTICLES, key=len, reverse=True))})(?![가-힣]))?")
RESIDUE = re.compile(r"⟦\s*G?\s*\d*\s*⟧")


def _final(term: str) -> int | None:
    code = ord(term[-1]) - 0xAC00 if term else -1
    if 0 <= code < 11172:
        return code % 28
    known = READING_FINALS.get(term.rstrip().lower())
    return None if known is None else int(known)


def mask_terms(terms: list[str]):
    """A UDF text -> (text, planted): terms become ``⟦Gn⟧`` by their index, longest first, any case, between characters that are no ASCII word characters."""
    order = sorted(range(len(terms)), key=lambda i: -len(terms[i]))
    found = [(i, re.compile(rf"(?<![A-Za-z0-9_]){re.escape(terms[i])}(?![A-Za-z0-9_])", re.I)) for i in order]

    def one(text: str | None):
        planted = []
        for i, pattern in found:
            text, n = pattern.subn(f"⟦G{i}⟧", text or "")
            if n:
                planted.append(i)
        return text or "", sorted(planted)

    ship_active()

    @F.pandas_udf("text string, planted array<int>")
    def mask(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in text], columns=["text", "planted"])

    return mask


def render_terms(forms: list[str]):
    """A UDF text -> (text, seen): tokens become their forms with the particle that agrees; unknown tokens go."""

    def one(text: str | None):
        seen = set()

        def put(m):
            i = int(m[1])
            if i >= len(forms):
                return ""
            seen.add(i)
            return forms[i] + (particle(m[2], _final(forms[i])) if m[2] else "")

        return RESIDUE.sub("", TOKEN.sub(put, text or "")), sorted(seen)

    ship_active()

    @F.pandas_udf("text string, seen array<int>")
    def render(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in text], columns=["text", "seen"])

    return render


#: Names of notation, and characters of notation, that no glossary term holds.
MATH_WORDS = (
    "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi varpi rho varrho sigma varsigma tau upsilon phi varphi chi psi omega "
    "nabla partial langle rangle odot oplus otimes cdot cdots ldots mid mathbb mathrm mathcal mathbf mathsf boldsymbol bm widehat widetilde hat tilde bar vec sqrt argmax argmin "
    "sum prod forall exists infty leftarrow rightarrow mapsto top ell"
).split()
MATH_CHARS = "{}\\^_()[]=<>|/,~⟨⟩∇√∂⊙⊕⊗·×∑∏∈≤≥≈≠±∗•←→↦"


def glossary_worthy(term: Column) -> Column:
    """longer than a character, without characters or names of notation."""
    t = F.trim(term)
    words = F.split(F.lower(t), r"[\s\-,]+")
    return (F.length(t) > 1) & (F.length(F.translate(t, MATH_CHARS, "")) == F.length(t)) & ~F.arrays_overlap(words, F.array(*map(F.lit, MATH_WORDS)))


def kept_terms(terms: Column, strip: Column) -> Column:
    """Terms worth a chip: worthy, no token inside, not in the strip set (compared in lower case), each once."""
    low = F.transform(strip, lambda s: F.lower(s))
    return F.array_distinct(F.filter(terms, lambda t: glossary_worthy(t) & ~F.contains(t, F.lit("⟦")) & ~F.array_contains(low, F.lower(t))))


def resolve_glossary(seed: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per user the seed (term_from, term_to) with the user's overrides (user_id, term_from, term_to, prompt_enforced) in their place."""
    own = overrides.select("user_id", "term_from", F.col("term_to").alias("_own"), "prompt_enforced")
    base = overrides.select("user_id").distinct().crossJoin(F.broadcast(seed.select("term_from", "term_to")))  # the seed is a fixed list
    both = base.join(own, ["user_id", "term_from"], "full")
    return both.select("user_id", "term_from", F.coalesce("_own", "term_to").alias("term_to"), F.coalesce("prompt_enforced", F.lit(False)).alias("prompt_enforced"))


def glossary_signatures(overrides: DataFrame) -> DataFrame:
    """Per user a number of 48 bits that names the enforced overrides; 0 without any. A user's list is short."""

    ship_active()

    @F.pandas_udf("long")
    def sign(pairs: pd.Series) -> pd.Series:
        def one(p):
            listed = sorted((x["a"], x["b"]) for x in p)
            return int(hashlib.sha256(repr(listed).encode()).hexdigest()[:12], 16) if listed else 0

        return pairs.map(one)

    pair = F.when(F.col("prompt_enforced"), F.struct(F.col("term_from").alias("a"), F.col("term_to").alias("b")))
    return overrides.groupBy("user_id").agg(F.collect_list(pair).alias("p")).select("user_id", sign("p").alias("signature"))


def apply_translations(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Segments (doc_id, ord, text) with their translation or, without one, the source text; ``applied`` tells which."""
    t = translations.select("doc_id", "ord", F.nullif(F.trim("translated"), F.lit("")).alias("_t")).dropDuplicates(["doc_id", "ord"])
    out = segments.join(t, ["doc_id", "ord"], "left")
    return out.select("doc_id", "ord", F.coalesce("_t", "text").alias("text"), F.col("_t").isNotNull().alias("applied"))


def reduce_input(partials: DataFrame) -> DataFrame:
    """Partials (doc_id, ord, tldr, contributions, method, results, limitations) as one text, in order. A document's partials are bounded by its windows."""
    fields = ["tldr", "contributions", "method", "results", "limitations"]
    listed = partials.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("l"))

    def block(p: Column, i: Column) -> Column:
        bullets = F.array_join(F.transform(p["contributions"], lambda c: F.concat(F.lit("- "), c)), "\n")
        return F.concat(
            F.lit("[부분 요약 "), (i + 1).cast("string"), F.lit("]\nTL;DR: "), p["tldr"], F.lit("\n기여:\n"), bullets, F.lit("\n방법: "), p["method"], F.lit("\n결과: "), p["results"], F.lit("\n한계: "), p["limitations"],
        )

    return listed.select("doc_id", F.array_join(F.transform("l", block), "\n\n").alias("body"))


def roman_number(token: Column) -> Column:
    """X32 for columns: every mark counts, less those with a larger mark to their right; null where the token is no numeral."""
    up = F.upper(token)
    marks = "IVXLCDM"
    worth = (1, 5, 10, 50, 100, 500, 1000)
    total = F.lit(0)
    for k, (m, w) in enumerate(zip(marks, worth, strict=True)):
        total = total + F.regexp_count(up, F.lit(m)) * w
        if marks[k + 1 :]:
            total = total - F.regexp_count(up, F.lit(f"{m}(?=.*[{marks[k + 1:]}])")) * (2 * w)
    return F.when(F.regexp_like(up, F.lit(f"^[{marks}]+$")), total)


def caption_number(line: Column) -> Column:
    """Struct (kind, number) of a caption line: a number and then a mark, a capital or the end; else null."""
    rule = r"^\s*((?i:figure|fig\.?|table))\s*(\d+|[IVXLCDM]+)(?:\s*[:.—]|\s+(?=[A-Z])|\s*$)"
    kind, number = F.lower(F.regexp_extract(line, rule, 1)), F.regexp_extract(line, rule, 2)
    return F.when(kind != "", F.struct(F.when(kind.startswith("tab"), "table").otherwise("figure").alias("kind"), F.coalesce(number.try_cast("int"), roman_number(number)).alias("number")))


def floats_in(text: Column, most: int = 40) -> Column:
    """Sorted distinct (kind, number) that the text names, numbers 1 to ``most``; listings count as algorithms."""
    rule = r"(?i)\b(fig(?:ure)?|table|algorithm|listing)\s*\.?\s*(\d{1,2}|[IVXL]{1,5})\b"
    found = F.regexp_extract_all(text, F.lit(rule), 0)

    def one(m: Column) -> Column:
        word, raw = F.lower(F.regexp_extract(m, rule, 1)), F.regexp_extract(m, rule, 2)
        kind = F.when(word.startswith("fig"), "figure").when(word == "table", "table").otherwise("algorithm")
        return F.struct(kind.alias("kind"), F.coalesce(raw.try_cast("int"), roman_number(raw)).alias("number"))

    return F.array_sort(F.array_distinct(F.filter(F.transform(found, one), lambda s: s["number"].between(1, most))))


def first_mentions(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (paper_id, ord, text) to the first paragraph that names each float."""
    named = paragraphs.select("paper_id", "ord", F.explode(floats_in(F.col("text"))).alias("f"))
    return named.groupBy("paper_id", F.col("f.kind").alias("kind"), F.col("f.number").alias("number")).agg(F.min("ord").alias("first"))


def split_bullets(text: Column) -> Column:
    """Items of a paragraph that opens with a bullet, else none. A glyph inside an item stays."""
    parts = F.transform(F.split(text, r"(?:(?<=\s)|^)[•▪‣◦]\s"), lambda p: F.regexp_replace(p, r"^[ \t:;,•▪‣◦]+|[ \t:;,•▪‣◦]+$", ""))
    return F.when(F.regexp_like(text, F.lit(r"^\s*[•▪‣◦]")), F.filter(parts, lambda p: p != "")).otherwise(F.array().cast("array<string>"))
