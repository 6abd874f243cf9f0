"""The evidence gate over claims and references made of the documents' own texts.

Each document is a paper: its scope follows its source, its blocks are two halves of its text, and its references quote
from it at places that vary with the document, so every check is met by some rows and the outcome depends on the texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia_spark.operators import evidence as E
from scholia_spark.plans.base import query, table


def _papers(spark, d):
    docs = table(spark, d, "documents").select("doc_id", E.squeeze(F.col("text")).alias("text"))
    return docs.select("doc_id", "text", F.concat(F.lit("24"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.when(F.col("doc_id") % 2 == 0, "v2").otherwise("")).alias("paper_id"), F.when(F.col("doc_id") % 5 == 0, "abstract").otherwise("fulltext").alias("scope"))


def _gate_inputs(spark, d):
    p, i = _papers(spark, d), F.col("doc_id")
    half = F.floor(F.length("text") / 2).cast("int")
    kinds = F.array(
        F.struct(F.lit("b1").alias("anchor"), F.lit("paragraph").alias("anchor_type"), F.substring("text", F.lit(1), half).alias("block_text")),
        F.struct(F.lit("b2").alias("anchor"), F.lit("figure").alias("anchor_type"), F.substring("text", half + 1, F.length("text")).alias("block_text")),
    )
    blocks = p.select("paper_id", F.inline(kinds))
    at = (i * 7 % 40 + 1).cast("int")
    quote = F.substring("text", at, (i % 50 + 5).cast("int"))
    n = F.posexplode(F.array([F.lit(k) for k in range(4)])).alias("ref_no", "k")
    refs = p.select("doc_id", "text", "paper_id", n).select(
        i.alias("item_id"), "ref_no",
        F.when((i + F.col("k")) % 3 == 0, "conflicting").otherwise("supporting").alias("side"),
        F.when((i + F.col("k")) % 13 == 0, "9999.99999").when((i + F.col("k")) % 4 == 0, F.concat(F.lit("arXiv:"), F.regexp_replace("paper_id", "v2$", ""))).otherwise(F.col("paper_id")).alias("paper_id"),
        F.when((i + 3 * F.col("k")) % 17 == 0, "").when((i + F.col("k")) % 19 == 0, "a quote that stands in no paper at all").otherwise(quote).alias("quote"),
        F.element_at(F.array(F.lit("b1"), F.lit("b2"), F.lit(""), F.lit("b9"), F.lit("b1")), ((i + 2 * F.col("k")) % 5 + 1).cast("int")).alias("anchor"),
        F.element_at(F.array(F.lit("fulltext"), F.lit("figure"), F.lit("abstract"), F.lit(None)), ((i * 3 + F.col("k")) % 4 + 1).cast("int")).alias("scope"),
        ((i * 5 + F.col("k")) % 23 == 0).alias("malformed"),
    )
    number = F.coalesce(F.try_element_at(E.numbers_in(F.substring("text", at, F.lit(60))), F.lit(1)), F.lit("7"))
    statement = F.when(i % 29 == 0, "  ").when(i % 3 == 0, F.concat(F.lit("it reaches "), number, F.lit("% of all"))).when(i % 31 == 0, "it reaches 123456.789").otherwise(F.lit("it is stated so"))
    return p.select(i.alias("item_id"), statement.alias("statement")), refs, p.select("paper_id", "scope", "text"), blocks


_SQUEEZE = r"trim(regexp_replace(coalesce(text, ''), '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"


@query()
def q14_evidence_gate(spark, d):
    """Claims with their valid references, codes of the others, and the claim's own outcome.

    No SQL: numbers need look-around, which the oracle's dialect lacks. tests/test_evidence.py holds it against plain loops.
    """
    items, refs, sources, blocks = _gate_inputs(spark, d)
    return E.evidence_gate(items, E.judge_refs(refs, sources, blocks))


@query(f"""WITH p AS (SELECT doc_id, {_SQUEEZE} AS text, '24' || lpad(doc_id::VARCHAR, 7, '0') || CASE WHEN doc_id % 2 = 0 THEN 'v2' ELSE '' END AS paper_id, CASE WHEN doc_id % 5 = 0 THEN 'abstract' ELSE 'fulltext' END AS has FROM documents),
r AS (SELECT doc_id AS item_id, k AS ref_no, p.text, p.paper_id AS paper, has, CASE WHEN (doc_id + k) % 3 = 0 THEN 'conflicting' ELSE 'supporting' END AS side, (doc_id + k) % 13 = 0 AS lost,
 CASE WHEN (doc_id + 3 * k) % 17 = 0 THEN '' WHEN (doc_id + k) % 19 = 0 THEN 'a quote that stands in no paper at all' ELSE trim(substring(text, doc_id * 7 % 40 + 1, doc_id % 50 + 5)) END AS quote,
 ['b1', 'b2', '', 'b9', 'b1'][(doc_id + 2 * k) % 5 + 1] AS anchor, ['fulltext', 'figure', 'abstract', NULL][(doc_id * 3 + k) % 4 + 1] AS declared, (doc_id * 5 + k) % 23 = 0 AS malformed FROM p, range(4) x(k)),
s AS (SELECT *, CASE WHEN declared = 'figure' THEN 'figure' WHEN has = 'abstract' THEN 'abstract' WHEN declared IN ('fulltext', 'abstract') THEN declared ELSE 'fulltext' END AS scope,
 trim(CASE anchor WHEN 'b1' THEN substring(text, 1, length(text) // 2) WHEN 'b2' THEN substring(text, length(text) // 2 + 1) END) AS block FROM r),
j AS (SELECT *, CASE WHEN malformed THEN 'malformed_ref' WHEN lost THEN 'unknown_paper' WHEN scope = 'figure' AND anchor = '' THEN 'figure_anchor_required' WHEN scope <> 'abstract' AND anchor = '' THEN 'anchor_missing'
 WHEN scope <> 'abstract' AND anchor = 'b9' THEN 'anchor_not_found' WHEN scope = 'figure' AND anchor <> 'b2' THEN 'anchor_type_mismatch' WHEN scope = 'abstract' AND anchor <> '' THEN 'anchor_on_abstract'
 WHEN scope <> 'figure' AND quote = '' THEN 'missing_quote' WHEN scope <> 'figure' AND length(quote) < 20 THEN 'quote_too_short' WHEN scope <> 'figure' AND NOT contains(text, quote) THEN 'quote_not_verbatim'
 WHEN scope = 'fulltext' AND NOT contains(block, quote) THEN 'quote_outside_anchor' END AS reason FROM s)
SELECT item_id, side, ref_no, CASE WHEN NOT lost THEN paper END AS paper, CASE WHEN NOT lost THEN scope END AS scope, quote, reason FROM j""")
def j9_judged_references(spark, d):
    """Each reference with the first check it fails; prefixes and versions of ids don't matter."""
    _, refs, sources, blocks = _gate_inputs(spark, d)
    judged = E.judge_refs(refs, sources, blocks)
    unknown = F.col("paper").isNull()
    scope = F.when(unknown, F.lit(None)).otherwise(F.col("scope"))
    return judged.select("item_id", "side", "ref_no", "paper", scope.alias("scope"), "quote", "reason")
