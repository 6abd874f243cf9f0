"""Queries of refinement, masking, captions and translation over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia_spark.functions import patterns as P
from scholia_spark.operators import refine as R
from scholia_spark.plans.base import query, table



def _s(c):
    return c.cast("string")


def _pick(i, *values):
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


_BODY = f"""trim(array_to_string(list_filter(lines, lambda x: NOT (regexp_matches(x, '{P.PAGE_NUMBER}') OR length(trim(x)) <= {P.NOISE_LINE_CHARS} AND (regexp_matches(x, '{P.COPYRIGHT}') OR regexp_matches(x, '{P.AUTHOR}') OR regexp_matches(x, '{P.RUNNING_HEAD}')))), chr(10)), chr(10) || chr(9) || ' ')"""


def _all(pattern: str) -> str:
    return f"list_transform(regexp_extract_all(body, '{pattern}'), lambda x: trim(x, chr(10) || chr(9) || ' '))"


@query(f"""WITH t AS (SELECT doc_id, '2 Methods of ' || source AS label, string_split(concat_ws(chr(10), text, '2 Methods of ' || source, 'Figure 3: ' || lang || ' shown.', '17', 'Copyright ' || source, 'See the appendix for ' || lang || '.'), chr(10)) AS lines FROM documents),
b AS (SELECT doc_id, label, {_BODY} AS body FROM t)
SELECT doc_id, body, {_all(P.CAPTION)} AS captions, {_all(P.FORMULA)} AS formulas, {_all(P.PRESERVED)} AS preserved, [label] AS section_labels, [strpos(body, chr(10) || label)]::INT[] AS section_starts, [strpos(body, chr(10) || label) + length(label)]::INT[] AS section_ends, greatest(1, length(body) // 4) AS token_count FROM b""")
def d17_refine(spark, d):
    """D17 over whole texts, followed by a heading, a caption, noise, an appendix and references."""
    tail = [F.concat(F.lit("2 Methods of "), "source"), F.concat(F.lit("Figure 3: "), "lang", F.lit(" shown.")), F.lit("17"), F.concat(F.lit("Copyright "), "source"), F.concat(F.lit("See the appendix for "), "lang", F.lit(".")), F.lit("References"), F.lit("[1] A. Copyright.")]
    refined = table(spark, d, "documents").select("doc_id", R.refine(F.concat_ws("\n", "text", *tail)).alias("r"))
    sections = [F.col(f"r.sections.{k}").alias(f"section_{k}s") for k in ("label", "start", "end")]
    return refined.select("doc_id", *[F.col(f"r.{k}") for k in ("body", "captions", "formulas", "preserved", "token_count")], *sections)


@query(f"""WITH b AS (SELECT doc_id, {_BODY} AS body FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
w AS (SELECT doc_id, i::INT AS ordinal, substr(body, greatest(0, i * 1600 - 200) + 1, (i + 1) * 1600 - greatest(0, i * 1600 - 200)) AS body FROM (SELECT doc_id, body, unnest(range((length(body) + 1599) // 1600)) AS i FROM b))
SELECT doc_id, ordinal, body, greatest(1, length(body) // 4) AS token_count FROM w""")
def d18_map_reduce_chunks(spark, d):
    """Texts without headings, so that every window is full and begins with the end of the one before."""
    return R.map_reduce_chunks(table(spark, d, "documents"), 400, 200)


@query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS ord FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
s AS (SELECT doc_id, ord, greatest(1, length(t) // 4) AS n FROM l),
r AS (SELECT doc_id, ord, n AS used, 0 AS batch FROM s WHERE ord = 0 UNION ALL
SELECT s.doc_id, s.ord, CASE WHEN used + n > 350 THEN n ELSE used + n END, CASE WHEN used + n > 350 THEN batch + 1 ELSE batch END FROM r JOIN s ON s.doc_id = r.doc_id AND s.ord = r.ord + 1)
SELECT doc_id, ord, batch::INT AS batch FROM r""")
def d19_segment_batches(spark, d):
    """D19."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))
    return R.segment_batches(lines.withColumn("ord", F.col("ord").cast("long")), 350)


#: Terms that stand in the documents' texts, one inside another, with the forms that replace them.
_COMMON = {"de la": "의 그", "la": "그", "the": "정관사", "und": "그리고", "attention": "어텐션"}


def _planted(text: str) -> str:
    """SQL that masks the terms, longest first; twice each, as neighbours share the blank between them."""
    order = sorted(range(len(_COMMON)), key=lambda i: -len(list(_COMMON)[i]))
    for i in order:
        for _ in range(2):
            text = f"regexp_replace({text}, '(^|[^A-Za-z0-9_])(?i:{list(_COMMON)[i]})($|[^A-Za-z0-9_])', '\\1⟦G{i}⟧\\2', 'g')"
    return text


def _rendered(text: str) -> str:
    for i, form in enumerate(_COMMON.values()):
        text = f"replace({text}, '⟦G{i}⟧', '{form}')"
    return text


@query(f"""SELECT doc_id, masked, list_filter(range({len(_COMMON)}), lambda i: contains(masked, '⟦G' || i || '⟧'))::INT[] AS planted, {_rendered('masked')} AS rendered FROM (SELECT doc_id, {_planted("coalesce(text, '')")} AS masked FROM documents)""")
def x27_x28_masks(spark, d):
    """X27, X28, G21 over whole texts."""
    masked = table(spark, d, "documents").select("doc_id", R.mask_terms(list(_COMMON))(F.col("text")).alias("m"))
    return masked.select("doc_id", F.col("m.text").alias("masked"), F.col("m.planted").alias("planted"), R.render_terms(list(_COMMON.values()))(F.col("m.text"))["text"].alias("rendered"))


@query("""SELECT doc_id, [true, false, false, true, false][(doc_id % 5) + 1] AS worthy, CASE WHEN doc_id % 5 IN (0, 3) THEN [t] ELSE [] END::VARCHAR[] AS kept FROM (SELECT doc_id, ['diffusion model', 'x', 'the alpha-term', 'BERT', 'W_q'][(doc_id % 5) + 1] AS t FROM documents)""")
def f19_g21_kept_terms(spark, d):
    """F19, G21."""
    term = _pick(F.col("doc_id"), "diffusion model", "x", "the alpha-term", "BERT", "W_q")
    return table(spark, d, "documents").select("doc_id", R.glossary_worthy(term).alias("worthy"), R.kept_terms(F.array(term, F.lit("GPT"), F.lit("⟦G1⟧"), term), F.array(F.lit("gpt"))).alias("kept"))


@query("""WITH o AS (SELECT c_custkey AS user_id, ['attention', 'own'][(c_custkey % 2) + 1] AS term_from, 'T' || c_custkey AS term_to, c_custkey % 3 = 0 AS e FROM customer), b AS (SELECT user_id, s.f AS term_from, s.t AS term_to FROM o, (VALUES ('attention', 'A'), ('latent', 'L')) s(f, t))
SELECT coalesce(b.user_id, o.user_id) AS user_id, coalesce(b.term_from, o.term_from) AS term_from, coalesce(o.term_to, b.term_to) AS term_to, coalesce(e, false) AS prompt_enforced FROM b FULL JOIN o ON b.user_id = o.user_id AND b.term_from = o.term_from""")
def d26_glossaries(spark, d):
    return R.resolve_glossary(spark.sql("SELECT * FROM VALUES ('attention', 'A'), ('latent', 'L') AS s(term_from, term_to)"), _overrides(spark, d))


def _overrides(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("user_id"), _pick(k, "attention", "own").alias("term_from"), F.concat(F.lit("T"), _s(k)).alias("term_to"), (k % 3 == 0).alias("prompt_enforced"))


@query("""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN ('0x' || substr(sha256('[(''' || ['attention', 'own'][(c_custkey % 2) + 1] || ''', ''T' || c_custkey || ''')]'), 1, 12))::BIGINT ELSE 0 END AS signature FROM customer""")
def x34_glossary_signatures(spark, d):
    return R.glossary_signatures(_overrides(spark, d))


@query("""SELECT conv_id AS doc_id, turn AS ord, CASE WHEN turn % 2 = 0 THEN upper('t' || turn) ELSE text END AS text, turn % 2 = 0 AS applied FROM conversations""")
def g22_translations(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "text")
    return R.apply_translations(turns, turns.where("ord % 3 <> 1 OR ord % 2 = 0").select("doc_id", "ord", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("T"), _s(F.col("ord")))).otherwise(" ").alias("translated")))


@query("""SELECT conv_id AS doc_id, string_agg('[부분 요약 ' || n || ']' || chr(10) || 'TL;DR: ' || role || chr(10) || '기여:' || chr(10) || '- a' || chr(10) || '- ' || turn || chr(10) || '방법: m' || chr(10) || '결과: ' || turn || chr(10) || '한계: x', chr(10) || chr(10) ORDER BY turn) AS body
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1""")
def g23_reduce_input(spark, d):
    t = _s(F.col("turn"))
    return R.reduce_input(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("role").alias("tldr"), F.array(F.lit("a"), t).alias("contributions"), F.lit("m").alias("method"), t.alias("results"), F.lit("x").alias("limitations")))


@query("""SELECT doc_id, ['figure', 'table', NULL, 'figure', 'table'][(doc_id % 5) + 1] AS kind, [doc_id % 30, 4, NULL, 12, 9][(doc_id % 5) + 1]::INT AS number,
[['figure:' || nullif(doc_id % 30, 0)], ['table:4'], ['table:6'], ['figure:12'], ['table:9']][(doc_id % 5) + 1][1] AS named FROM documents""")
def x31_h21_captions(spark, d):
    """X31, X32, H21."""
    i = F.col("doc_id")
    line = F.when(i % 5 == 0, F.concat(F.lit("Figure "), _s(i % 30), F.lit(": a"))).otherwise(_pick(i, "", "TABLE IV RESULTS", "Table 6 shows that", "Fig. 12", " Table IX. Listing"))
    named = F.transform(R.floats_in(line), lambda s: F.concat_ws(":", s["kind"], s["number"].cast("string")))
    return table(spark, d, "documents").select("doc_id", R.caption_number(line)["kind"].alias("kind"), R.caption_number(line)["number"].alias("number"), F.array_join(named, ",").alias("_n")).select("doc_id", "kind", "number", F.nullif("_n", F.lit("")).alias("named"))


@query("""SELECT 'p' || doc_id % 20 AS paper_id, CASE WHEN doc_id % 2 = 0 THEN 'figure' ELSE 'table' END AS kind, (doc_id % 6 + 1)::INT AS number, min(doc_id) AS first FROM documents GROUP BY 1, 2, 3""")
def w13_first_mentions(spark, d):
    i = F.col("doc_id")
    text = F.concat(F.lit("as "), F.when(i % 2 == 0, "Fig. ").otherwise("table "), _pick(i, "I", "ii", "III", "4", "V", "6"), F.lit(" shows"))
    return R.first_mentions(table(spark, d, "documents").select(F.concat(F.lit("p"), _s(i % 20)).alias("paper_id"), i.alias("ord"), text.alias("text")))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['one ' || doc_id, 'p(•) two'] ELSE [] END::VARCHAR[] AS items FROM documents")
def h13_bullets(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", R.split_bullets(F.concat(F.when(i % 2 == 0, " • ").otherwise("p • "), F.lit("one "), _s(i), F.lit("; ▪ p(•) two "))).alias("items"))
