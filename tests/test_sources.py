"""Published generations, ledgers, cursors and pages, numbers and endings on small tables."""

import pytest
from pyspark.sql import functions as F

from scholia_spark.functions import text
from scholia_spark.operators import activity as A
from scholia_spark.operators import ingest as I
from scholia_spark.sources import files


def test_publish_points_to_full_generations_only(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    df = lambda n: spark.range(n).withColumn("n", F.lit(n))
    with pytest.raises(Exception):
        files.current(spark, folder)
    assert files.publish(df(5), folder, "a", 3) and files.current(spark, folder).count() == 5
    assert not files.publish(df(2), folder, "b", 3) and files.current(spark, folder).count() == 5
    assert files.publish(df(7), folder, "c", 3) and {r["n"] for r in files.current(spark, folder).collect()} == {7}
    assert files.current(spark.newSession(), folder).count() == 7


def test_ledger_and_pending(spark, tmp_path):
    lines = ['{"id":"a","seq":1,"outcome":"failed:x:y:parse"}', "broken", '{"id":"a","seq":2,"outcome":"done"}', '{"id":"b","seq":3,"outcome":"failed:x:y:fetch"}', '{"seq":4}']
    (tmp_path / "ledger.jsonl").write_text("\n".join(lines))
    ledger = files.load_ledger(spark, f"{tmp_path}/ledger.jsonl")
    assert {r["id"]: r["outcome"] for r in ledger.collect()} == {"a": "done", "b": "failed:x:y:fetch"}
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    ids = lambda *args: {r["id"] for r in files.pending(rows, ledger, *args).collect()}
    assert ids([], False, []) == {"c"} and ids(["a"], True, []) == {"a", "b", "c"} and ids([], True, ["fetch"]) == {"c"}


def test_cursors_and_pages(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, None)], "ts long, id string")
    back = df.where("id IS NOT NULL").select("ts", "id", A.cursor_parts(A.cursor_code(F.col("ts"), F.col("id"))).alias("c")).collect()
    assert all((r["c"]["ts"], r["c"]["id"]) == (str(r["ts"]), r["id"]) for r in back)
    for bad in ("%%%", "bm8ganNvbg==", None):
        with pytest.raises(Exception, match="bad cursor"):
            spark.createDataFrame([(bad,)], "c string").select(A.cursor_parts(F.col("c"))).collect()
    rows = df.where("id IS NOT NULL")
    assert [r["id"] for r in A.page_after(rows, "ts", "id", 5, "z").collect()] == ["y", "x"]
    with pytest.raises(ValueError):
        A.page_after(rows, "ts", "id", 5, "unknown")


def test_redelivery_after_a_failed_ingest(spark):
    rows = [("p", 1, 1, "f", False), ("p", 2, 1, "f", False), ("p", 3, 1, "f", True), ("p", 4, 1, "f", False), ("p", 5, 1, "f", False), ("p", 6, 1, "g", None), ("p", 7, 1, "f", True), ("p", 8, 0, "f", True), ("p", 9, 1, "f", False), ("p", 10, 2, "f", True)]
    got = I.dedup_decisions(spark.createDataFrame(rows, "paper_id string, arrival int, version int, fingerprint string, indexed boolean"))
    assert [r["decision"] for r in got.orderBy("arrival").collect()] == ["NEW", "CHANGED", "CHANGED", "DUPLICATE", "DUPLICATE", "CHANGED", "CHANGED", "STALE", "DUPLICATE", "CHANGED"]


def test_nearest_rank(spark):
    values = [(k, float(v * v % 97 if k else 5)) for k in (0, 1) for v in range(200)] + [(2, 3.0), (3, None)]
    df = spark.createDataFrame(values, "k int, v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r["k"]: (r["n"], r["at"]) for r in A.nearest_rank(df, ["k"], "v", share, 7).collect()}
        want = {}
        for k in (0, 1, 2):
            own = sorted(v for x, v in values if x == k)
            want[k] = (len(own), own[min(int(len(own) * share), len(own) - 1)])
        assert got == want


def test_numbers_and_slots(spark):
    row = spark.createDataFrame([("CASP14 has 95.3% of 1,200 and 3.5x",)], "t string")
    assert row.select(text.evidence_numbers(F.col("t"))).head()[0] == ["95.3%", "1", "200", "3"]
    assert row.select(text.summary_numbers(F.col("t"))).head()[0] == ["14", "95.3", "1,200", "3.5"]
    index = F.expr("map('a', array(0, 1), 'b', array(1, 2))")
    assert row.select(text.inverted_text(index), text.inverted_text_of_slots(index)).head()[:] == ("a a b b", "a b b")


def test_small_text_tables_are_spread(spark, tmp_path, monkeypatch):
    from scholia_spark import session

    path = f"file://{tmp_path}/t.parquet"
    spark.range(100).coalesce(1).write.parquet(path)
    assert session.read_spread(spark, path).rdd.getNumPartitions() == 1
    monkeypatch.setattr(session, "SPREAD_FROM", 0)
    df = session.read_spread(spark, path)
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and df.count() == 100
    monkeypatch.setattr(session, "SPREAD_TO", 10)
    assert session.read_spread(spark, path).rdd.getNumPartitions() == 1


def test_raw_cache(spark, tmp_path):
    path = f"file://{tmp_path}/raw"
    schema = "paper_id string, version int, tier string, data binary, put_at int"
    files.put_raw(spark.createDataFrame([("a", 1, "pdf", b"old", 1), ("a", 2, "pdf", b"two", 1), ("b", 1, "html", b"h", 1)], schema), path)
    files.put_raw(spark.createDataFrame([("a", 1, "pdf", b"new", 2), ("c", 1, "pdf", b"", 2), ("c", 1, "pdf", b"", 2)], schema), path)
    wanted = spark.createDataFrame([("a", 1, "pdf"), ("a", 1, "pdf"), ("a", 1, "html"), ("c", 1, "pdf"), ("d", 1, "pdf")], "paper_id string, version int, tier string")
    got = {(r["paper_id"], r["tier"]): r["data"] for r in files.get_raw(spark, path, wanted).collect()}
    assert got == {("a", "pdf"): b"new", ("a", "html"): None, ("c", "pdf"): b"", ("d", "pdf"): None}


def test_loss_budget(spark):
    rows = lambda *o: spark.createDataFrame([(str(i), x) for i, x in enumerate(o)], "paper_id string, outcome string")
    assert files.loss_within(rows("indexed", "indexed", "failed", "excluded"), 0.5).head().asDict() == {"indexed": 2, "excluded": 1, "failed": 1, "bad_ratio": 0.5, "within": True}
    assert not files.loss_within(rows("indexed", "failed"), 0.4).head()["within"] and files.loss_within(rows(), 0.5).head()["bad_ratio"] == 1.0
