"""Cases of review findings: skewed keys, odd texts, sizes."""

import random
import re
import threading

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scholia_spark.functions import text
from scholia_spark.operators import gates as G
from scholia_spark.operators import refine as R
from scholia_spark.operators.ingest import html_to_text
from scholia_spark.operators import docmodel as M
from scholia_spark.operators import ingest
from scholia_spark.operators import retrieval
from scholia_spark.plans import registry


def within(spark, seconds, run):
    """The result of ``run``, whose jobs are cancelled after that time."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return run()
    finally:
        timer.cancel()


def test_lookup_does_not_pair_all_rows_of_a_key(spark):
    n = 100_000
    stored = spark.range(n).select(F.col("id").alias("state_id"), F.lit("k").alias("k"), ((F.col("id") + 3) % n).alias("b"))
    found = G.lookup_by_keys(spark.range(n).select(F.col("id").alias("request_id")), [F.lit("k"), F.lit(None).cast("string"), F.lit("none")], stored, "k", F.col("b"))
    got = within(spark, 60, lambda: found.groupBy("state_id").count().collect())
    assert [tuple(r) for r in got] == [(n - 3, n)]


def test_slots_of_a_long_text(spark):
    n = 60_000
    index = F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("w"), i.cast("string"))), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array(F.floor(i / 2))))
    df = spark.range(1).select(index.alias("index")).localCheckpoint()
    got = within(spark, 60, lambda: df.select(text.inverted_text_of_slots(F.col("index"))).head()[0])
    assert got.split(" ") == [f"w{i}" for i in range(1, n, 2)]


def test_inverted_abstract_shuffles_texts_once(spark, sf_dir):
    plan = registry.QUERIES["src19_inverted_abstract"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    prepared = registry.QUERIES["src19_inverted_abstract"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" in plan and prepared.count("Exchange hashpartitioning") == 1


def test_addresses_and_long_numbers_are_no_headings():
    body = "28.68.191.238 Den Haag.\n4355709550244650 Mentoi ment\n3.1 Method\n1.2.3.4 Deep heading\nend"
    assert [s["label"] for s in R.refine_text(body)["sections"]] == ["3.1 Method", "1.2.3.4 Deep heading"]


def test_chunks_are_not_cut_at_an_address(spark):
    text = "a" * 100 + "\n28.68.191.238 Den Haag.\n" + "b" * 1700
    got = R.map_reduce_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 400, 200).orderBy("ordinal").collect()
    assert [r.body for r in got] == [text[:1600], text[1400:]]


def test_violation_begins_above_2400_characters(spark, tmp_path):
    rows = [(i, "t", "en", "s", n) for i, n in enumerate([2399, 2400, 2401, 2409, 2410, None])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.violations for r in registry.QUERIES["f4_f16_metadata"](spark, str(tmp_path)).collect()}
    assert [len(got[i]) for i in range(6)] == [1, 1, 2, 2, 2, 1]


def test_references_without_semicolon_stay(spark):
    pages = spark.createDataFrame([(1, "<p>a&amp;&amp</p><p>b&lt;&#65;&am &nosuch; & &amp;amp;</p>")], "page_id long, html string")
    assert html_to_text(pages).head().text == "a&&amp\nb<A&am &nosuch; & &amp;"


def test_fallback_keeps_cut_references(spark, tmp_path):
    spark.createDataFrame([(1, "u", "<h1>x&amp;&amp</h1><p>y</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [r.text for r in registry.QUERIES["src7_html_or_text"](spark, str(tmp_path)).collect()] == ["x&&amp y"]


def test_python_workers_get_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        papers = spark.range(3000, numPartitions=1).select(F.col("id").cast("string").alias("paper_id"), F.lit("<p>x</p>").alias("html"), F.lit("a").alias("abstract"))
        M.parse_html(papers).count()
        sizes = papers.mapInPandas(lambda it: (pdf.head(1).assign(n=len(pdf))[["n"]] for pdf in it), "n long").collect()
        assert max(r.n for r in sizes) <= 500
    finally:
        spark.conf.set(name, before)


def test_pack_blocks_over_batches(spark):
    rows = [(f"p{p}", f"s{b // 3}", b, f"b{b}", None if b == 2 else "x" * 10) for p in range(40) for b in range(50)]
    blocks = spark.createDataFrame(rows, "paper_id string, section_id string, block_ord int, block_id string, text string")
    packed = ingest.pack_blocks(blocks, 21)
    assert "FlatMapGroups" not in packed._jdf.queryExecution().executedPlan().toString()  # no frame a paper
    got = sorted((r.paper_id, r.ordinal, r.section_id, r.chars, r.block_refs) for r in packed.collect())
    want = []
    for p in range(40):
        n = 0
        for s in range(17):
            refs = [b for b in range(3 * s, 3 * s + 3) if b < 50]
            for part in (refs[:2], refs[2:]):
                if part:
                    want.append((f"p{p}", n, f"s{s}", sum(0 if b == 2 else 10 for b in part) + len(part) - 1, [f"b{b}" for b in part]))
                    n += 1
    assert got == sorted(want)


def test_segment_batches_over_many_documents(spark):
    segments = spark.range(6000).select((F.col("id") / 4).cast("long").alias("doc_id"), (F.col("id") % 4).alias("ord"), F.repeat(F.lit("x"), 40).alias("text"))
    found = R.segment_batches(segments, 20)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()  # no frame a document
    assert {(r.ord, r.batch) for r in found.collect()} == {(0, 0), (1, 0), (2, 1), (3, 1)} and found.count() == 6000


def test_products_of_neighbours_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "KNN_ROWS", 64)
    monkeypatch.setattr(retrieval, "KNN_QUERIES", 7)
    seen = spark.sparkContext.accumulator(0)
    near = retrieval._near

    def counted(units, wanted, k, least):
        if len(wanted) > 7 or len(units) >= 2 * 500:
            seen.add(1)
        return near(units, wanted, k, least)

    monkeypatch.setattr(retrieval, "_near", counted)
    vectors = spark.range(1000, numPartitions=2).select(F.col("id"), F.array(F.cos("id"), F.sin("id")).alias("vector"))
    chunks = vectors.select(F.col("id").alias("chunk_id"), F.col("id").alias("paper_id"), "vector")
    got = retrieval.knn(vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), chunks, 3).collect()
    assert seen.value == 0 and len(got) == 60 and {r.query_id for r in got if r.chunk_id == r.query_id} == set(range(0, 1000, 50))


def test_hits_are_added_up_where_their_chunk_lies(spark, sf_dir):
    for name in ("q2_bm25", "q2_bm25_fields", "f10_bm25_of_years", "q12_grounding_verdict"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan
        assert not re.search(r"Exchange hashpartitioning\((query_id|request_id)#\w+, (paper_id|chunk_id)#\w+, (paper_id|chunk_id)#", plan), name


def test_conflicts_of_claims_make_no_pairs(spark):
    n = 40_000
    refs = spark.range(2 * n).select(F.lit(1).alias("answer_id"), F.col("id").alias("n"), F.when(F.col("id") < n, "conflict").otherwise("support").alias("side"), (F.col("id") % 20).alias("paper_id"))
    plan = G.conflict_map(refs)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner, \(+(NOT \()?\(?(n#\w+ = m#|m#\w+ = n#)", plan)  # no claim meets a claim
    got = within(spark, 60, lambda: G.conflict_map(refs).agg(F.count("*"), F.sum(F.size("conflicts_with")), F.min(F.get("conflicts_with", F.lit(0)) - F.lit(n) - F.col("n") % 20), F.max(F.get("conflicts_with", F.lit(0)) - F.lit(n) - F.col("n") % 20)).collect())
    assert [tuple(r) for r in got] == [(n, n * n // 20, 0, 0)]


def test_conflicts_over_several_papers(spark):
    rows = [(1, 1, "conflict", 5), (1, 1, "conflict", 6), (1, 1, "conflict", 6), (1, 2, "conflict", 5), (1, 3, "conflict", None), (1, None, "conflict", 5), (None, 1, "conflict", 5), (2, 9, "conflict", 5)]
    rows += [(1, 1, "support", 5), (1, 2, "support", 5), (1, 2, "support", 6), (1, 4, "support", 6), (1, None, "support", 5), (2, 9, "support", 5), (1, 7, None, 5), (1, 8, "support", None)]
    got = G.conflict_map(spark.createDataFrame(rows, "answer_id int, n int, side string, paper_id int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, [2, 4]), (1, 2, [1])]


def test_phrases_meet_texts_where_they_lie(spark, sf_dir):
    plan = registry.QUERIES["q3_phrase"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1  # texts are read once
    assert not re.search(r"Exchange hashpartitioning\([^)]*\b(chunk_id|pos|a|b)#", plan)  # neither postings nor places are shuffled


def test_phrases_of_frequent_words(spark):
    """Phrases that begin alike, and long texts of one word: each is met by a run that few phrases hold."""
    queries = spark.range(400).select(F.col("id").alias("query_id"), F.concat(F.array_repeat(F.lit("x"), 30), F.array(F.concat(F.lit("y"), F.col("id").cast("string")))).alias("phrase"))
    tail = F.array(F.concat(F.lit("y"), F.col("id").cast("string")))
    chunks = spark.range(100).select(F.col("id").alias("chunk_id"), F.col("id").alias("paper_id"), F.concat(F.array_repeat(F.lit("x"), 10_000), F.when(F.col("id") % 2 == 0, tail).otherwise(F.array(F.lit(None).cast("string")))).alias("tokens"))
    got = within(spark, 60, lambda: retrieval.phrase_match(queries, chunks).collect())
    assert {(r.query_id, r.chunk_id) for r in got} == {(i, i) for i in range(0, 100, 2)}


def test_terms_are_counted_where_their_chunk_lies(spark, sf_dir):
    plan = registry.QUERIES["q19_recall_at_10"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "REPARTITION_BY_COL" in line]
    assert len(dealt) == 1 and re.search(r"REPARTITION_BY_COL.*\n(.*Filter.*\n)?.*MapInArrow", plan)  # hits are dealt by paper, not texts


def test_counted_terms_equal_plain_lists(spark, monkeypatch):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    texts = [None if i == 5 else rnd.choices([*words, None, "", "other"], k=rnd.choice([0, 1, 5, 40])) for i in range(700)]
    asked = [rnd.choices([*words, None], k=rnd.choice([1, 2, 8])) for _ in range(20)] + [[], None, ["nowhere"]]
    chunks = spark.createDataFrame([(f"c{i}", f"p{i * 7 % 300}", t) for i, t in enumerate(texts)], "chunk_id string, paper_id string, tokens array<string>").repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, terms array<string>")
    want = set()
    for q, terms in enumerate(asked):
        best = {}
        for i, t in enumerate(texts):
            n = len({x for x in t or [] if x is not None} & {x for x in terms or [] if x is not None})
            if n:
                best[i * 7 % 300] = min(best.get(i * 7 % 300, (0, "")), (-n, f"c{i}"))
        want |= {(q, r, c, -n) for r, (n, c) in enumerate(sorted(best.values())[:15], 1)}
    assert {(r.query_id, r["rank"], r.chunk_id, r.score) for r in retrieval.term_overlap(queries, chunks, 15).collect()} == want
    assert retrieval.term_overlap(queries.where("query_id > 19"), chunks).collect() == [] == retrieval.term_overlap(queries.limit(0), chunks).collect()
    args = (pa.array([["a", "b", "a", None], None, [], ["c", "z"]]), pa.array(["a", "b", "c"]), np.array([0, 2, 3, 5]), np.array([0, 1, 1, 0, 2]), 3)
    for hits in (1, 2, 1 << 22):  # added up in parts
        monkeypatch.setattr(retrieval, "OVERLAP_HITS", hits)
        assert retrieval._overlap(*args).tolist() == [[1, 2, 0], [0, 0, 0], [0, 0, 0], [1, 0, 1]]


def test_addresses_of_small_numbers_are_no_headings(spark):
    body = "12.13.14.15 Den Haag.\n19.10.10.19\nTe Den\n1.12.13.14 Deep heading\n10.1.19.10 Deeper heading\n12.13.14 Third level\nend"
    assert [s["label"] for s in R.refine_text(body)["sections"]] == ["1.12.13.14 Deep heading", "10.1.19.10 Deeper heading", "12.13.14 Third level"]
    text = "a" * 100 + "\n15.17.16.18 Tioning to.\n" + "b" * 1700
    got = R.map_reduce_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 400, 200).orderBy("ordinal").collect()
    assert [r.body for r in got] == [text[:1600], text[1400:]]


def test_fallback_needs_no_join(spark, tmp_path):
    rows = [(1, "u", "<h1>x</h1><p>y</p>"), (None, "u", "<p>z</p>"), (3, "u", None), (4, "u", "<p> </p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = registry.QUERIES["src7_html_or_text"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1  # a page is read once and stays in its row
    want = duckdb.sql(registry.ORACLE_SQL["src7_html_or_text"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert {tuple(r) for r in found.collect()} == set(want) == {("1", "s1.p1", "paragraph", "x y"), (None, "s1.p1", "paragraph", "z")}


def test_preservation_of_texts_without_characters(spark, tmp_path):
    rows = [(1, "", "en", "s", 0), (2, None, "en", "s", 0), (3, "a b", "en", "s", 0), (4, "a b\n\nc d", "en", "s", 8), (5, "", None, "s", 0), (6, "a b c", None, "s", 5), (7, "a b c", "en", None, 5)]
    rows += [(8, "a", "e<b>", "a&amp;b", 1), (9, None, "en", "s", None), (9, "x", "en", "s", 1), (None, "a b", "en", "s", 3), (-10, "", "en", "s", -800)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.paper_id, r.coverage, tuple(r.violations)) for r in registry.QUERIES["a18_preservation"](spark, str(tmp_path)).collect()}
    want = duckdb.sql(registry.ORACLE_SQL["a18_preservation"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert got == {(i, c, tuple(v)) for i, c, v in want} and ("1", float("inf"), ("lost_figures",)) in got and len(want) == 11


def test_flat_text_needs_no_join(spark, tmp_path):
    rows = [(1, "a b\nc <d> & e\nf"), (2, None), (3, ""), (None, "x"), (4, "one\n\ntwo three"), (5, "\n".join(f"w{i} v" for i in range(3000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.QUERIES["src9_tei_blocks"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("FileScan") == 1  # a paper is parsed once and stays in its task
    want = duckdb.sql(registry.ORACLE_SQL["src9_tei_blocks"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = [(r.paper_id, r.ord, r.block_id, r.text, r.flat) for r in found.collect()]
    assert sorted(got) == sorted(want) and {r[0] for r in got} == {"1", "2", "3", "4", "5"}


def test_broken_tei_gives_its_abstract_without_text(spark):
    papers = spark.createDataFrame([("a", "<TEI>", "x"), ("b", None, None), ("c", "<TEI/>", "y")], "paper_id string, tei string, abstract string")
    assert sorted((r.paper_id, r.block_id, r.text, r.flat) for r in M.parse_tei_with_text(papers).collect()) == [("a", "s0.p1", "x", None), ("c", "s0.p1", "y", None)]
