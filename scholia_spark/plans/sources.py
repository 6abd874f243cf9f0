"""Queries over file sources, ledgers and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia_spark.functions import text as T
from scholia_spark.operators import ingest as I
from scholia_spark.plans.base import query, table
from scholia_spark.sources import files


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '%([A-Za-z0-9])', ' \\1', 'g') AS t FROM documents)
SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '[A-Za-z0-9.]+%?'), lambda r: regexp_extract(r, '^([0-9]+(?:\\.[0-9]+)?%?)(?:[^A-Za-z0-9]|$)', 1)), lambda x: x <> '') AS numbers FROM t""")
def n2_evidence_numbers(spark, d):
    """The numbers of whole texts."""
    return table(spark, d, "documents").select("doc_id", T.evidence_numbers(F.col("text")).alias("numbers"))


@query("""WITH e AS (SELECT user_id AS paper_id, event_id AS arrival, floor(abs(value))::BIGINT % 7 AS version FROM events), b AS (SELECT *, max(version) OVER (PARTITION BY paper_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e)
SELECT paper_id, arrival, version, version >= coalesce(top, version) AS claimed, version >= top AND top IS NOT NULL AS cleared FROM b""")
def d2_claims(spark, d):
    """Claims in the order of events."""
    e = table(spark, d, "events").select(F.col("user_id").alias("paper_id"), F.col("event_id").alias("arrival"), (F.floor(F.abs("value")).cast("long") % 7).alias("version"))
    return I.claim_upserts(e)


_OUTCOME = "CASE WHEN quality = 1 THEN 'ok' ELSE 'failed:ingest:x:' || CASE WHEN toxic = 1 THEN 'parse' ELSE 'fetch' END END"


@query(f"""WITH l AS (SELECT doc_id, max({_OUTCOME}) AS outcome FROM labels GROUP BY 1)
SELECT doc_id, n_chars FROM documents LEFT JOIN l USING (doc_id) WHERE outcome IS NULL OR doc_id = 7 OR (outcome LIKE 'failed%' AND coalesce(split_part(outcome, ':', 4), '') <> 'parse')""")
def f15_pending(spark, d):
    """Documents without a label, asked for again, or failed at another stage than parsing."""
    ledger = table(spark, d, "labels").groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max(F.expr(_OUTCOME)).alias("outcome"))
    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.col("doc_id").cast("string").alias("id"))
    return files.pending(rows, ledger, ["7"], True, ["parse"]).drop("id")


@query(f"""SELECT doc_id, nullif(split_part({_OUTCOME}, ':', 4), '') AS stage FROM labels""")
def g24_failure_stage(spark, d):
    """G24."""
    return table(spark, d, "labels").select("doc_id", files.failure_stage(F.expr(_OUTCOME)).alias("stage"))


@query("""SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderdate END, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END, TIMESTAMP '1995-06-01') > TIMESTAMP '1995-06-01'
 AND coalesce(CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderdate END, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END, TIMESTAMP '1995-06-01') <= TIMESTAMP '1997-03-01'""")
def src6_window(spark, d):
    """SRC6: after a time, and up to another; without an update the publication counts, and without both nothing is inside."""
    o, since, until = table(spark, d, "orders"), F.lit("1995-06-01").cast("timestamp"), F.lit("1997-03-01").cast("timestamp")
    at = F.col("o_orderdate").cast("timestamp")
    updated, published = F.when(~F.col("o_orderpriority").startswith("1"), at), F.when(F.col("o_orderstatus") != "F", at)
    return o.where(files.in_window(updated, published, since, until)).select("o_orderkey")


_MEMBER = "o_orderstatus || '/' || strftime(o_orderdate, '%y%m') || '.' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'v' || (o_orderkey % 12 + 1) END || CASE WHEN o_orderstatus = 'P' THEN '.txt.gz' WHEN o_orderstatus = 'O' THEN '.pdf' ELSE '/' END"


@query(f"""WITH m AS (SELECT o_orderkey, {_MEMBER} AS name FROM orders), r AS (SELECT *, regexp_extract(name, '([0-9]{{4}}\\.[0-9]{{4,5}})(v([0-9]+))?\\.[A-Za-z.]+$', ['paper_id', 'x', 'version']) AS m FROM m)
SELECT o_orderkey, m.paper_id, coalesce(try_cast(m.version AS INT), 1) AS version FROM r WHERE m.paper_id <> ''""")
def src13_members(spark, d):
    """SRC13: members of bulk files; folders are none."""
    k = F.col("o_orderkey")
    name = F.concat(
        "o_orderstatus", F.lit("/"), F.date_format("o_orderdate", "yyMM"), F.lit("."), F.lpad((k % 100000).cast("string"), 5, "0"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("v"), (k % 12 + 1).cast("string"))),
        F.when(F.col("o_orderstatus") == "P", ".txt.gz").when(F.col("o_orderstatus") == "O", ".pdf").otherwise("/"),
    )
    return table(spark, d, "orders").select("o_orderkey", files.member_id(name).alias("m")).where("m IS NOT NULL").select("o_orderkey", "m.paper_id", "m.version")
