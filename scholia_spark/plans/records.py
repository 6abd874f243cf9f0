"""Record-level queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia_spark.operators import records as R
from scholia_spark.plans.base import query, table


@query("""SELECT page_id, CASE WHEN regexp_matches(u, '^https?://', 'i') THEN u ELSE '' END AS card_url, CASE WHEN page_id % 3 = 0 THEN 'a' || page_id WHEN page_id % 3 = 1 THEN url WHEN page_id % 2 = 0 THEN 'https://doi.org/10.1/' || page_id ELSE 'a' || page_id END AS source_url
FROM (SELECT *, CASE WHEN page_id % 4 = 0 THEN 'ftp://x' ELSE url END AS u FROM pages)""")
def f7_f9_card_urls(spark, d):
    """F7, F8, F9."""
    i = F.col("page_id")
    own = F.when(i % 3 == 1, F.col("url")).otherwise(" ")
    doi = F.when(i % 2 == 0, F.concat(F.lit("10.1/"), i.cast("string")))
    found = R.source_url(F.when(i % 3 == 0, "ARXIV").otherwise("OPENALEX"), F.concat(F.lit("a"), i.cast("string")), own, doi)
    return table(spark, d, "pages").select("page_id", R.web_url(F.when(i % 4 == 0, "ftp://x").otherwise(F.col("url"))).alias("card_url"), found.alias("source_url"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'title' WHEN doc_id % 7 = 0 THEN 'authors' WHEN trim(text) = '' THEN 'abstract' WHEN doc_id % 11 = 0 THEN 'categories' END AS problem, CASE WHEN n_chars > 2400 THEN ['bad', 'query'] ELSE ['bad'] END AS violations FROM documents")
def f4_f16_metadata(spark, d):
    """F4, F16."""
    i = F.col("doc_id")
    tags = F.create_map(F.lit("bad"), F.lit("x"), F.lit("query"), F.repeat(F.lit("x"), F.expr("cast((n_chars + 9) div 10 as int)")), F.lit("scope"), F.lit("y"))
    problem = R.metadata_problem(F.when(i % 5 != 0, F.col("source")), F.when(i % 7 != 0, F.array("source")), F.col("text"), F.when(i % 11 != 0, F.array("lang")).otherwise(F.array().cast("array<string>")))
    docs = table(spark, d, "documents")
    return docs.select("doc_id", problem.alias("problem"), R.metadata_violations(tags, ["query", "scope"], 240).alias("violations"))


@query("""WITH p AS (SELECT event_id, ['success', 'degraded', 'error', 'success'][(event_id % 4) + 1] AS s, event_id % 9 = 0 AS f, (event_id % 6)::INT AS rc, (event_id % 5)::INT AS it, CASE WHEN event_id % 7 = 0 THEN 'lexical' END AS m, event_id % 2 = 0 AS dg FROM events)
SELECT event_id, CASE WHEN s IN ('abstain', 'fail_closed', 'failed', 'error') OR (s = 'degraded' AND dg) THEN NULL WHEN s = 'success' AND f THEN 'retrieval failure was reported as success' WHEN s = 'success' AND rc = 0 THEN 'empty result was reported as success'
 WHEN it <> rc THEN 'result count does not match returned cards' WHEN s = 'success' AND m IS NOT NULL AND NOT dg THEN 'degraded execution was reported as success' END AS reason FROM p""")
def t12_partial_results(spark, d):
    """T12, T13."""
    i = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("success", "degraded", "error", "success"))), (i % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", R.partial_reason(status, i % 9 == 0, i % 6, i % 5, F.when(i % 7 == 0, "lexical"), i % 2 == 0).alias("reason"))


@query("SELECT lang AS paper_id, source AS type, doc_id AS asset_id, n_chars AS ord, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id)::INT AS ordinal FROM documents")
def w11_ordinals(spark, d):
    """W11, H2."""
    docs = table(spark, d, "documents")
    return R.ordinals(docs.select(F.col("lang").alias("paper_id"), F.col("source").alias("type"), F.col("doc_id").alias("asset_id"), F.col("n_chars").alias("ord")))


@query("SELECT conv_id AS job_id, max(turn) + 1 AS next_seq FROM conversations GROUP BY 1")
def w9_next_sequence(spark, d):
    return R.next_sequence(table(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq")))


@query("""WITH t AS (SELECT conv_id AS session_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT session_id, string_agg(substr(trim(text), 1, 120), ' / ' ORDER BY turn) AS summary FROM t WHERE n > 1 AND trim(text) <> '' GROUP BY 1""")
def g12_evicted_topics(spark, d):
    return R.evicted_topics(table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"), F.col("text").alias("topic")), 1)


@query("""SELECT doc_id, regexp_extract_all('a ' || doc_id % 9 || '.' || doc_id % 7 || ' -' || doc_id % 5, '-?\\d+(?:\\.\\d+)?') AS numbers, doc_id % 3 = 0 OR doc_id % 4 = 0 AS repair FROM documents""")
def h15_h20_cells(spark, d):
    """H15, H20."""
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    text = F.concat(F.lit("a "), s(i % 9), F.lit(" . "), s(i % 7), F.lit(" −"), s(i % 5))
    cells = F.when(i % 3 == 0, F.array(F.lit(" "), F.lit(""))).when(i % 4 == 0, F.array(F.lit("x"), F.lit("1 2 3"))).otherwise(F.array(F.lit("1 2"), F.lit("y")))
    return table(spark, d, "documents").select("doc_id", R.cell_numbers(text).alias("numbers"), R.needs_repair(cells).alias("repair"))


@query("""SELECT 'n_chars' AS field, count(*) FILTER (WHERE a < n_chars) AS losses, count(*) FILTER (WHERE a > n_chars) AS gains, sum(n_chars)::BIGINT AS before, sum(a)::BIGINT AS after FROM (SELECT n_chars, n_chars + doc_id % 3 - 1 AS a FROM documents WHERE doc_id % 10 <> 0)""")
def h25_before_after(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    after = docs.where("doc_id % 10 <> 0").select("doc_id", (F.col("n_chars") + F.col("doc_id") % 3 - 1).alias("n_chars"))
    return R.score_shift(docs, after, "doc_id", ["n_chars"])


@query("""WITH c AS (SELECT user_id AS job_id, event_id AS seq, (event_id % 10)::DOUBLE AS cost FROM events)
SELECT job_id, seq, count(*) OVER w < 20 AND coalesce(sum(cost) OVER w, 0) < 60 AS allowed FROM c WINDOW w AS (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def g4_iteration_budget(spark, d):
    """G4, G6."""
    e = table(spark, d, "events")
    return R.running_budget(e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 10).cast("double").alias("cost")), 20, 60.0)


@query()
def x25_x26_glossary(spark, d):
    """X25, X26."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", R.term_in_text("the", F.col("text")).alias("has_term"), R.substitute(F.col("text"), {"the": "THE", "the that": "BOTH"}).alias("text"))
