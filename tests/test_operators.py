"""Operators without SQL, against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scholia_spark.functions import text as T
from scholia_spark.functions import unicode as U
from scholia_spark.operators import activity as A
from scholia_spark.operators import ingest as I
from scholia_spark.sources import files
from scholia_spark.streaming import jobs


def calls(n=400):
    r = random.Random(3)
    return [(r.randrange(4), i, float(r.randrange(300))) for i in range(n)]


def test_sliding_limit(spark):
    rows = calls()
    got = {r["call_id"]: r["allowed"] for r in A.sliding_limit(spark.createDataFrame(rows, "key long, call_id long, t double"), 5, 30.0).collect()}
    passed = defaultdict(list)
    for key, call, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        ok = sum(t - p < 30 for p in passed[key]) < 5
        passed[key] += [t] * ok
        assert got[call] == ok


def test_fixed_limit(spark):
    rows = calls()
    got = {r["call_id"]: r["allowed"] for r in A.fixed_limit(spark.createDataFrame(rows, "key long, call_id long, t double"), 5, 30.0).collect()}
    state = {}
    for key, call, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        reset, n = state.get(key, (0.0, 0))
        if key not in state or t >= reset:
            reset, n = t + 30, 0
        state[key] = (reset, n + 1)
        assert got[call] == (n + 1 <= 5)


def test_split_text():
    body = "word " * 3000
    pieces = I.split_text(body, 2400, 240)
    assert all(len(p) <= 2400 for p in pieces) and pieces[0].startswith("word") and I.split_text("", 10, 2) == [] and I.split_text("a b", 10, 2) == ["a b"]
    with pytest.raises(ValueError):
        I.split_text("x", 5, 5)


def test_text_scalars(spark):
    df = spark.createDataFrame([("a 　 b ",)], "t string")
    assert df.select(T.normalize_text(F.col("t"))).first()[0] == "a b"
    assert df.select(T.evidence_numbers(F.lit("x1 2.5% (30) 4a 5."))).first()[0] == ["2.5%", "30", "5"]
    assert df.select(T.final_jamo(F.lit("한글"))).first()[0] == 8 and df.select(T.final_jamo(F.lit("ab"))).first()[0] is None
    assert df.select(U.number_forms(F.lit("1,200"))).first()[0] == ["12", "1200"]
    assert U.particle("을", 0) == "를" and U.particle("로", 8) == "로" and U.roman_value("XIV") == 14 and U.roman_value("AB") is None


def test_ledger_and_members(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id":"a","seq":1,"outcome":"failed:x:y:parse"}\n{"id":"a","seq":3,"outcome":"ok"}\nbroken\n{"id":"b","seq":2,"outcome":"failed:x:y:fetch"}\n')
    ledger = files.load_ledger(spark, str(tmp_path / "l.jsonl"))
    assert {r["id"]: r["outcome"] for r in ledger.collect()} == {"a": "ok", "b": "failed:x:y:fetch"}
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    left = lambda **k: {r["id"] for r in files.pending(rows, ledger, **k).collect()}
    assert left(redo=[], retry=False, skip_stages=[]) == {"c"} and left(redo=["a"], retry=True, skip_stages=[]) == {"a", "b", "c"} and left(redo=[], retry=True, skip_stages=["fetch"]) == {"c"}
    assert tuple(spark.range(1).select(files.member_id(F.lit("2101/2101.00001v2.pdf"))).first()[0]) == ("2101.00001", 2)


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in")).select(F.col("event_type").alias("source"), "ts")
    jobs.watermark_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    last = max((p for p in (tmp_path / "out").iterdir()), key=lambda p: int(p.name.split("=")[1]))
    got = {r["source"]: r["ts"] for r in spark.read.parquet(str(last)).collect()}
    assert got == {r[0]: r[1] for r in events.groupBy("event_type").agg(F.max("ts")).collect()}


def test_job_routes(spark):
    body = ['{"kind":"new","paper_id":"p","version":1}', '{"kind":"odd","paper_id":"p"}', "junk", '{"kind":"tick"}', '{"kind":"new","paper_id":"p","not_before":"2999-01-01T00:00:00Z"}', None]
    df = spark.createDataFrame(list(enumerate(body)), "message_id long, body string")
    assert [r["route"] for r in jobs.parse_jobs(df).orderBy("message_id").collect()] == ["ok", "dlq", "dlq", "ok", "retry", "dlq"]


def test_telemetry_sink_replays(spark, sf_dir, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).limit(50).write.parquet(str(src))
    for n in range(2):  # the second run has a new checkpoint, so it replays the batch
        jobs.telemetry_sink(jobs.event_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / f"c{n}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
