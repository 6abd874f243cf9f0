"""Queries of table repair, audits, quotas and bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia_spark.operators import repair as P
from scholia_spark.plans.base import query, table


def _s(c):
    return c.cast("string")


def _arr(*v):
    return F.array(*[x if not isinstance(x, str) else F.lit(x) for x in v])


_CAP = "accuracy of all models under the first set of conditions"


@query(f"""SELECT doc_id AS spec_id, CASE doc_id % 4 WHEN 0 THEN doc_id ELSE doc_id + 1000000 END AS table_id, CASE doc_id % 4 WHEN 0 THEN length(replace('{_CAP}', ' ', '') || doc_id) ELSE length(replace('{_CAP}', ' ', '')) END::INT AS agreed FROM documents WHERE doc_id % 4 IN (0, 1)""")
def h17_caption_match(spark, d):
    """Quoted whole, cut off in the reading, ambiguous, and too short captions."""
    i, docs = F.col("doc_id"), table(spark, d, "documents")
    spec = F.when(i % 4 == 3, "Table 1: short").otherwise(F.concat(F.lit(f"Table 1: {_CAP} "), F.when(i % 4 == 0, _s(i)).otherwise("and more")))
    specs = docs.select(i.alias("spec_id"), i.alias("page_key"), spec.alias("caption"))
    first = docs.select(i.alias("table_id"), i.alias("page_key"), F.when(i % 4 == 0, F.concat(F.lit(f"(a) {_CAP} "), _s(i), F.lit("x"))).when(i % 4 == 2, f"TABLE II. {_CAP}").otherwise("else").alias("caption"))
    second = docs.select((i + 1_000_000).alias("table_id"), i.alias("page_key"), F.lit(_CAP).alias("caption"))
    return P.caption_match(specs, first.unionByName(second))


@query("""SELECT doc_id AS spec_id, CASE WHEN doc_id % 5 IN (0, 4) THEN [doc_id || '.5', 'ab'] WHEN doc_id % 5 = 2 THEN ['ab'] ELSE [doc_id || '.5 ab'] END AS cells, doc_id % 5 IN (0, 2, 4) AS repaired FROM documents""")
def h16_repairs(spark, d):
    """Proven, unprinted number, words alone, no table, rotated word."""
    i, docs = F.col("doc_id"), table(spark, d, "documents")
    n = F.concat(_s(i), F.lit(".5"))
    rebuilt = F.when(i % 5 == 1, _arr(F.lit("999999.5"), "ab")).when(i % 5 == 2, _arr("ab")).otherwise(_arr(n, "ab"))
    page = F.when(i % 5 == 4, F.concat(n, F.lit(" ba"))).otherwise(F.concat(n, F.lit(" ab cd")))
    tables = docs.where("doc_id % 5 <> 3").select(i.alias("table_id"), rebuilt.alias("rebuilt"), page.alias("page"), _arr("ba").alias("rotated"))
    named = docs.select(i.alias("spec_id"), i.alias("table_id"))
    return P.apply_repairs(docs.select(i.alias("spec_id"), F.array(F.concat(n, F.lit(" ab"))).alias("cells")), named.where("spec_id % 2 = 0"), named, tables)


@query("""SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 1 THEN 'figure_lost' END, CASE WHEN doc_id % 3 = 0 THEN 'coverage_low' END, CASE WHEN doc_id % 4 > 1 THEN 'crop_missing' END, CASE WHEN doc_id % 5 > 0 THEN 'crop_unaccounted' END, CASE WHEN doc_id % 7 = 0 THEN 'crop_geometry_error' END], lambda x: x IS NOT NULL) AS violations FROM documents""")
def h24_audit(spark, d):
    i, zero = F.col("doc_id"), F.lit(0)
    signals = table(spark, d, "documents").select(
        "doc_id", (i % 2).alias("lost_figures"), zero.alias("lost_tables"), zero.alias("captions_dropped"), zero.alias("empty_tables"), zero.alias("figures_without_asset"), F.when(i % 3 == 0, 0.4).when(i % 3 == 1, 0.9).alias("coverage"),
        (i % 4).alias("crops_refused"), F.lit(1).alias("crops_refused_by_design"), (i % 4 + i % 5 + 3).alias("crop_specs"), F.lit(3).alias("crops_stored"), (i % 7 == 0).alias("geometry_error"), zero.alias("crop_duplicates"), zero.alias("cells_merged"), zero.alias("labels_unreadable"))
    return signals.select("doc_id", P.audit_violations().alias("violations"))


_BANDS = """r AS (SELECT doc_id AS id, 2010 + doc_id % 16 AS year, n_chars AS score, doc_id % 2 = 0 AS in_b FROM documents), k AS (SELECT *, CASE WHEN year >= 2024 THEN 0 WHEN year >= 2020 THEN 1 ELSE 2 END AS band FROM r),
a0 AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY score DESC, id) AS n FROM k), a AS (SELECT id FROM a0 WHERE n <= CASE band WHEN 0 THEN 12 WHEN 1 THEN 8 ELSE 40 END ORDER BY band, n LIMIT 40),
b0 AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY score DESC, id) AS n FROM k WHERE in_b AND id NOT IN (SELECT id FROM a)), b AS (SELECT id FROM b0 WHERE n <= CASE band WHEN 0 THEN 6 WHEN 1 THEN 4 ELSE 20 END ORDER BY band, n LIMIT 20)"""


@query(f"WITH {_BANDS} SELECT id, 'core' AS bucket FROM a UNION ALL SELECT id, 'even' FROM b")
def s11_band_quota(spark, d):
    i = F.col("doc_id")
    ranked = table(spark, d, "documents").select(i.alias("id"), (2010 + i % 16).alias("year"), F.col("n_chars").alias("score"), F.when(i % 2 == 0, _arr("core", "even")).otherwise(_arr("core")).alias("buckets"))
    return P.band_quota(ranked, [("core", 40), ("even", 20)], 2024, 2020, (0.3, 0.2))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'abs' WHEN doc_id % 5 > 0 THEN source WHEN doc_id % 2 = 0 THEN 'abs' ELSE 'title' END AS embed_text, CASE WHEN doc_id % 2 = 0 THEN 2000 + doc_id % 20 ELSE 2019 + doc_id % 3 END AS year,
CASE WHEN doc_id % 4 > 0 THEN ['intro', 'end'] ELSE ['body'] END AS sections FROM documents""")
def d8_d9_parse(spark, d):
    """D8, D9, SNK7."""
    i = F.col("doc_id")
    text = F.when(i % 4 > 0, "lead, gone.\nIntro\nsome text.\n\nmore text.\nEnd\nlast words here.").otherwise("plain text.")
    embed = P.embed_text(F.when(i % 3 == 0, "abstract").otherwise("body"), F.when((i % 3 == 0) | (i % 2 == 0), "abs").otherwise(" "), F.when(i % 5 > 0, F.col("source")), F.lit("title"))
    paper = F.when(i % 2 == 0, F.concat(F.lpad(_s(i % 20), 2, "0"), F.lit("01.00001")))
    year = P.parsed_year(paper, F.make_date(2019 + (i % 3).cast("int"), F.lit(1), F.lit(1)), F.lit(None).cast("date"))
    return table(spark, d, "documents").select("doc_id", embed.alias("embed_text"), year.cast("long").alias("year"), F.transform(P.heading_sections(text), lambda s: s["section"]).alias("sections"))


@query("""SELECT 'p' || doc_id % 50 AS paper_id, doc_id AS ordinal, CASE WHEN doc_id % 3 = 0 THEN 'abstract' ELSE 'body' END AS section, 't' || doc_id % 50 AS title, 'a' || doc_id % 50 AS abstract, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS lexical_terms FROM documents""")
def d14_records(spark, d):
    i = F.col("doc_id")
    tag = lambda c, k: F.concat(F.lit(c), _s(k))
    chunks = table(spark, d, "documents").select(tag("p", i % 50).alias("paper_id"), i.alias("ordinal"), F.when(i % 3 == 0, "abstract").otherwise("body").alias("section"), F.col("source").alias("text"))
    k = F.col("id")
    return P.assemble_records(chunks, spark.range(50).select(tag("p", k).alias("paper_id"), tag("t", k).alias("title"), tag("a", k).alias("abstract")))


@query("""SELECT 'k' || k AS canonical_key, list_sort(list_distinct(list_append(s, 'base'))) AS seen_sources FROM (SELECT doc_id % 40 AS k, list(DISTINCT source) AS s FROM documents GROUP BY 1)""")
def d30_seen_sources(spark, d):
    key = F.concat(F.lit("k"), _s(F.col("doc_id") % 40)).alias("canonical_key")
    docs = table(spark, d, "documents").select(key, "source")
    return P.record_duplicates(docs.select("canonical_key", _arr("base").alias("seen_sources")).distinct(), docs)


@query("SELECT 'p' || doc_id % 30 AS paper_id, max(doc_id % 12)::INT AS version FROM documents WHERE doc_id % 5 > 0 GROUP BY 1")
def src18_latest_versions(spark, d):
    """SRC16, SRC18."""
    i = F.col("doc_id")
    name = F.concat(F.lit("s3://b/docs/p"), _s(i % 30), F.lit("/v"), _s(i % 12), F.when(i % 5 > 0, ".json").otherwise(".tmp"))
    return P.latest_stored(table(spark, d, "documents").select(name.alias("path")))


@query("SELECT CASE WHEN lang <> 'en' THEN 'off_field' ELSE 'no_venue' END AS reason, count(*) AS n FROM documents WHERE doc_id > 10 AND doc_id <= 150 AND (lang <> 'en' OR doc_id % 3 = 0) GROUP BY 1")
def t6_rejections(spark, d):
    reason = F.when(F.col("lang") != "en", "off_field").when(F.col("doc_id") % 3 == 0, "no_venue")
    return P.queue_tally(table(spark, d, "documents"), reason, F.col("doc_id"), F.lit(10), F.lit(150))[1]


@query("SELECT doc_id, doc_id % 6 IN (0, 1) AS readable FROM documents")
def f20_readable_schemas(spark, d):
    return table(spark, d, "documents").select("doc_id", P.schema_readable(_pick_version(F.col("doc_id")), "1.2.0").alias("readable"))


def _pick_version(i):
    return F.element_at(_arr("1.2.0", "1.0.9", "1.2.1", "2.0.0", "1.x.0", "1.2"), (i % 6 + 1).cast("int"))


@query("SELECT user_id AS source, CASE WHEN user_id = 7 THEN TIMESTAMP '2000-01-01' ELSE max(ts) END AS ts FROM events GROUP BY user_id")
def t4_watermark_reset(spark, d):
    stored = table(spark, d, "events").groupBy(F.col("user_id").alias("source")).agg(F.max("ts").alias("ts"))
    return P.reset_watermark(stored, 7, F.lit("2000-01-01").cast("timestamp_ntz"))


@query("""SELECT doc_id AS chunk_id, length(CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END)::DOUBLE AS vector FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def snk5_reembed(spark, d):
    """SNK5, U3; the length of the text stands for a model's vector."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("chunk_id"), F.lit("body").alias("section"), F.col("lang").alias("abstract"), F.when(i % 2 == 0, F.col("source")).alias("lexical_terms"), F.lit("t").alias("title"))
    done = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return P.reembed(rows, done, lambda t: F.length(t).cast("double")).select("chunk_id", "vector")
