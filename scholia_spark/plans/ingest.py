"""Ingestion queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia_spark.operators import ingest as I
from scholia_spark.plans.base import query, table

_ARR = """a AS (SELECT 'p' || (doc_id % 97) AS paper_id, doc_id AS arrival, (doc_id * 7 % 5 + 1)::INT AS version, 'f' || (doc_id * 7 % 5 + doc_id // 97 % 2) AS fingerprint, doc_id % 4 > 1 AS indexed FROM documents)"""


def _arrivals(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        F.concat(F.lit("p"), (i % 97).cast("string")).alias("paper_id"), i.alias("arrival"), (i * 7 % 5 + 1).cast("int").alias("version"), F.concat(F.lit("f"), (i * 7 % 5 + F.expr("doc_id div 97") % 2).cast("string")).alias("fingerprint"), (i % 4 > 1).alias("indexed")
    )


@query(f"""WITH RECURSIVE {_ARR}, b AS (SELECT *, max(version) OVER w AS top FROM a WINDOW w AS (PARTITION BY paper_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT * FROM b WHERE top IS NULL OR version >= top), l AS (SELECT *, lag(version) OVER w AS pv, lag(fingerprint) OVER w AS pf, row_number() OVER w AS n FROM o WINDOW w AS (PARTITION BY paper_id ORDER BY arrival)),
t(paper_id, arrival, version, fingerprint, n, held, decision) AS (SELECT paper_id, arrival, version, fingerprint, n, indexed, 'NEW' FROM l WHERE n = 1 UNION ALL
 SELECT l.paper_id, l.arrival, l.version, l.fingerprint, l.n, CASE WHEN l.version = t.version AND l.fingerprint = t.fingerprint AND t.held THEN true ELSE l.indexed END,
 CASE WHEN l.version = t.version AND l.fingerprint = t.fingerprint AND t.held THEN 'DUPLICATE' ELSE 'CHANGED' END FROM t JOIN l ON l.paper_id = t.paper_id AND l.n = t.n + 1)
SELECT paper_id, arrival, version, decision FROM t UNION ALL SELECT paper_id, arrival, version, 'STALE' FROM b WHERE version < top""")
def d1_dedup_decisions(spark, d):
    return I.dedup_decisions(_arrivals(spark, d))


_REC = """r AS (SELECT 'k' || (doc_id % 211) AS canonical_key, 'p' || doc_id AS paper_id, ['ARXIV', 'SEMANTIC_SCHOLAR', 'OPENALEX'][(doc_id * 11 % 3) + 1] AS source, (doc_id * 11 % 3)::INT AS priority, (doc_id % 4)::INT AS version, doc_id AS arrival FROM documents),
w AS (SELECT canonical_key, arg_max(paper_id, struct_pack(p := -priority, v := version, a := arrival)) AS paper_id, arg_max(version, struct_pack(p := -priority, v := version, a := arrival)) AS winning_version,
 arg_max(source, struct_pack(p := -priority, v := version, a := arrival)) AS winning_source, list_sort(list(DISTINCT source)) AS seen_sources FROM r GROUP BY 1)"""


def _records(spark, d):
    i = F.col("doc_id")
    names = F.array(F.lit("ARXIV"), F.lit("SEMANTIC_SCHOLAR"), F.lit("OPENALEX"))
    return table(spark, d, "documents").select(
        F.concat(F.lit("k"), (i % 211).cast("string")).alias("canonical_key"), F.concat(F.lit("p"), i.cast("string")).alias("paper_id"), F.element_at(names, (i * 11 % 3 + 1).cast("int")).alias("source"), (i * 11 % 3).cast("int").alias("priority"), (i % 4).cast("int").alias("version"), i.alias("arrival")
    )


@query(f"WITH {_REC} SELECT * FROM w")
def d5_canonical_winners(spark, d):
    """D5, A16, X9."""
    return I.canonical_winners(_records(spark, d))


@query(f"WITH {_REC} SELECT DISTINCT r.paper_id, w.paper_id AS winner FROM r JOIN w USING (canonical_key) WHERE r.paper_id <> w.paper_id")
def d6_losing_papers(spark, d):
    r = _records(spark, d)
    return I.losing_papers(r, I.canonical_winners(r))


@query(f"WITH {_REC} SELECT winning_source, count(*) AS papers FROM w GROUP BY 1")
def a1_source_tier_counts(spark, d):
    return I.canonical_winners(_records(spark, d)).groupBy("winning_source").agg(F.count("*").alias("papers")).orderBy(F.desc("papers"))


_CH = "c AS (SELECT 'p' || (doc_id % 50) AS paper_id, 'p' || (doc_id % 50) || '#' || (doc_id // 50) AS chunk_id, n_chars FROM documents)"


def _stored(spark, d):
    p = F.concat(F.lit("p"), (F.col("doc_id") % 50).cast("string"))
    return table(spark, d, "documents").select(p.alias("paper_id"), F.concat(p, F.lit("#"), F.expr("doc_id div 50").cast("string")).alias("chunk_id"), "n_chars")


@query(f"""WITH {_CH}, n AS (SELECT paper_id, chunk_id, -n_chars AS n_chars FROM c WHERE n_chars % 2 = 0)
SELECT paper_id, chunk_id, n_chars FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM n) UNION ALL SELECT * FROM n""")
def snk1_upsert(spark, d):
    s = _stored(spark, d)
    return I.upsert(s, s.where("n_chars % 2 = 0").withColumn("n_chars", -F.col("n_chars")), ["chunk_id"])


@query(f"WITH {_CH} SELECT * FROM c WHERE paper_id NOT IN ('p3', 'p7')")
def snk2_tombstone(spark, d):
    return I.tombstone(_stored(spark, d), spark.createDataFrame([("p3",), ("p7",)], "paper_id string"))


@query(f"WITH {_CH} SELECT * FROM c WHERE paper_id NOT IN (SELECT paper_id FROM c WHERE n_chars > 9000) OR n_chars > 9000")
def snk3_delete_stale(spark, d):
    s = _stored(spark, d)
    return I.delete_stale(s, s.where("n_chars > 9000"))


@query("SELECT (SELECT count(*) FROM documents) AS source_count, (SELECT count(*) FROM embeddings) AS target_count, (SELECT count(*) FROM documents) <= (SELECT count(*) FROM embeddings) AS complete")
def snk6_completeness(spark, d):
    return I.completeness(table(spark, d, "documents"), table(spark, d, "embeddings"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'field_unknown' WHEN lang <> 'en' THEN 'off_field' WHEN doc_id % 3 = 0 THEN 'venue_unknown' WHEN doc_id % 7 = 0 THEN 'venue_blocked' END AS reason FROM documents""")
def f5_admission(spark, d):
    i = F.col("doc_id")
    fields = F.when(i % 5 != 0, F.array(F.when(F.col("lang") == "en", "Computer Science").otherwise("Art")))
    reason = I.admission(F.when(i % 4 == 0, "ARXIV").otherwise("OPENALEX"), fields, F.when(i % 3 != 0, F.when(i % 7 == 0, "A Workshop of X").otherwise("venue")), blocked=("workshop",))
    return table(spark, d, "documents").select("doc_id", reason.alias("reason"))


def _papers(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.element_at(F.split("text", "\n"), 1).alias("abstract"), F.col("text").alias("body"))


@query("""WITH RECURSIVE c AS (SELECT doc_id::VARCHAR AS paper_id, unnest([0, 1]) AS s, trim(regexp_replace(unnest([string_split(text, chr(10))[1], text]), '\\s+', ' ', 'g')) AS x FROM documents),
r AS (SELECT *, 0 AS k, 0 AS pos, NULL::VARCHAR AS piece FROM c WHERE x <> '' UNION ALL
SELECT paper_id, s, x, k + 1, CASE WHEN stop < length(x) THEN greatest(0, stop - 240) END, trim(substr(x, pos + 1, stop - pos)) FROM (
 SELECT *, CASE WHEN far < length(x) AND back > 0 AND far - back > pos + 1200 THEN far - back ELSE far END AS stop FROM (
  SELECT *, least(pos + 2400, length(x)) AS far, strpos(reverse(substr(x, pos + 1, 2400)), ' ') AS back FROM r WHERE pos IS NOT NULL)))
SELECT paper_id, (row_number() OVER (PARTITION BY paper_id ORDER BY s, k) - 1)::INT AS ordinal, ['abstract', 'body'][s + 1] AS section, piece AS text, count(*) OVER (PARTITION BY paper_id) > 2048 AS truncated FROM r WHERE piece <> ''""")
def d11_chunk_papers(spark, d):
    """D10, D11, A19."""
    return I.chunk_papers(_papers(spark, d))


@query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS o FROM documents),
r AS (SELECT doc_id, o, 0 AS bin, length(t) AS chars FROM l WHERE o = 0 UNION ALL
SELECT doc_id, o, CASE WHEN fits THEN bin ELSE bin + 1 END, CASE WHEN fits THEN chars + 1 + n ELSE n END FROM (
 SELECT l.doc_id, l.o, bin, chars, length(t) AS n, l.o % 4 > 0 AND chars + 1 + length(t) <= 1200 AS fits FROM r JOIN l ON l.doc_id = r.doc_id AND l.o = r.o + 1))
SELECT doc_id::VARCHAR AS paper_id, bin::INT AS ordinal, 's' || (min(o) // 4) AS section_id, max(chars)::INT AS chars, list('s' || (o // 4) || '.p' || o ORDER BY o) AS block_refs FROM r GROUP BY doc_id, bin""")
def d12_pack_blocks(spark, d):
    """D12."""
    lines = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("block_ord", "text"))
    section = F.concat(F.lit("s"), F.expr("block_ord div 4").cast("string"))
    return I.pack_blocks(lines.select("paper_id", section.alias("section_id"), "block_ord", F.concat(section, F.lit(".p"), F.col("block_ord").cast("string")).alias("block_id"), "text"))


@query("SELECT doc_id, n_chars, CASE WHEN n_chars * 10 > 120000 THEN 'OVER_CAP' WHEN n_chars * 10 > 40000 THEN 'MAP_REDUCE' ELSE 'SINGLE' END AS route FROM documents")
def d20_length_route(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars", I.length_route(F.col("n_chars") * 10).alias("route"))


@query("""WITH s AS (SELECT DISTINCT 'p' || (doc_id % 40) AS paper_id, (doc_id % 3 + 1)::INT AS version FROM documents WHERE doc_id % 40 < 30), q AS (SELECT doc_id AS request_id, 'p' || (doc_id % 40) AS paper_id, (doc_id % 5 + 1)::INT AS requested FROM documents)
SELECT request_id, q.paper_id, requested, CASE WHEN s.version IS NOT NULL THEN requested ELSE m.latest END AS served FROM q LEFT JOIN s ON q.paper_id = s.paper_id AND requested = s.version LEFT JOIN (SELECT paper_id, max(version) AS latest FROM s GROUP BY 1) m ON q.paper_id = m.paper_id""")
def d22_version_fallback(spark, d):
    """D22, A17."""
    i, docs = F.col("doc_id"), table(spark, d, "documents")
    paper = F.concat(F.lit("p"), (i % 40).cast("string")).alias("paper_id")
    stored = docs.where("doc_id % 40 < 30").select(paper, (i % 3 + 1).cast("int").alias("version")).distinct()
    return I.version_fallback(docs.select(i.alias("request_id"), paper, (i % 5 + 1).cast("int").alias("requested")), stored)


#: The text of pages: script-like elements and comments go, block elements give lines, other tags nothing.
_PAGE_TEXT = """(SELECT page_id, string_agg(x, chr(10) ORDER BY o) FILTER (WHERE x <> '') AS text FROM (SELECT page_id, o, trim(regexp_replace(replace(replace(replace(replace(replace(replace(line, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \\t\\f\\v\\x{a0}]+', ' ', 'g')) AS x
FROM (SELECT page_id, unnest(p) AS line, generate_subscripts(p, 1) AS o FROM (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<head.*?</head>|<script.*?</script>|<style.*?</style>', '', 'g'), '(?i)</?(p|div|br|li|ul|ol|article|nav|footer|h1)(\\s[^>]*)?>', chr(10), 'g'), '</?[a-zA-Z][^>]*>', '', 'g'), chr(10)) AS p FROM pages))) GROUP BY page_id)"""


@query(f"SELECT page_id, coalesce(text, '') AS text FROM {_PAGE_TEXT}")
def src10_html_to_text(spark, d):
    """SRC10."""
    return I.html_to_text(table(spark, d, "pages"))


@query("SELECT page_id % 5 AS host_group, count(*) AS pages, max(length(html)) AS longest FROM pages GROUP BY 1")
def a20_index_stats(spark, d):
    """A3, A20."""
    return table(spark, d, "pages").groupBy((F.col("page_id") % 5).alias("host_group")).agg(F.count("*").alias("pages"), F.max(F.length("html")).alias("longest"))


@query("""WITH m AS (SELECT DISTINCT 'p' || (doc_id % 40) AS paper_id, (doc_id % 3 + 1)::INT AS version FROM documents WHERE doc_id % 40 < 20), q AS (SELECT doc_id AS request_id, 'p' || (doc_id % 40) AS paper_id, (doc_id % 5 + 1)::INT AS requested, doc_id % 40 AS n FROM documents),
x AS (SELECT q.*, m.version IS NOT NULL AS exact, (SELECT max(version) FROM m WHERE m.paper_id = q.paper_id) AS latest FROM q LEFT JOIN m ON m.paper_id = q.paper_id AND m.version = q.requested)
SELECT request_id, paper_id, requested, CASE WHEN exact THEN 'model' WHEN latest IS NOT NULL THEN 'model_latest' WHEN n < 28 THEN 'full_text' WHEN n < 36 THEN 'abstract' END AS tier, CASE WHEN exact THEN requested ELSE latest END AS version FROM x""")
def d21_source_fallback(spark, d):
    docs, i = table(spark, d, "documents"), F.col("doc_id")
    paper = F.concat(F.lit("p"), (i % 40).cast("string")).alias("paper_id")
    models = docs.where("doc_id % 40 < 20").select(paper, (i % 3 + 1).cast("int").alias("version"))
    return I.source_fallback(docs.select(i.alias("request_id"), paper, (i % 5 + 1).cast("int").alias("requested")), models, docs.where("doc_id % 40 < 28").select(paper), docs.where("doc_id % 40 < 36").select(paper))


@query("SELECT conv_id AS paper_id, (max(turn) + 1)::BIGINT AS chunks FROM conversations GROUP BY 1 HAVING max(turn) + 1 >= 6")
def a19_truncation_report(spark, d):
    """Conversations stand for papers, turns for chunks."""
    return I.truncation_report(table(spark, d, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").cast("long").alias("ordinal")), 6)
