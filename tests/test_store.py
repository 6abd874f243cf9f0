"""The document store against a plain dictionary, and reparses that are killed, resumed and stopped."""

import random

import pytest
from pyspark.sql import functions as F

from scholia_spark.sources import store as S


def rows(spark, *items):
    return spark.createDataFrame(list(items), "paper_id string, version int, body string")


def held(store):
    return {(r.paper_id, r.version): r.body for r in store.live().collect()}


def test_store_equals_a_dictionary(spark, tmp_path):
    rnd, store, plain = random.Random(4), S.DocumentStore(spark, f"file://{tmp_path}/s"), {}
    assert held(store) == {} and store.mark() == 0
    for step in range(9):
        if step in (3, 6):
            gone = rnd.sample("abcdef", 2)
            store.remove(spark.createDataFrame([(g,) for g in [*gone, "zz"]] + [(None,)], "paper_id string"))
            plain = {k: v for k, v in plain.items() if k[0] not in gone}
        else:
            new = {(rnd.choice("abcdef"), rnd.randrange(1, 4)): f"body {step}" for _ in range(4)}
            store.put(rows(spark, *[(*k, v) for k, v in new.items()], (None, 1, "x"), ("a", None, "x")))
            plain |= new
        if step in (4, 7):
            before = held(store)
            mark = store.compact()
            assert store.mark() == mark == step + 1 and held(store) == before and store.compact() == mark
        assert held(store) == plain
    assert {r.paper_id: r.version for r in store.latest().collect()} == {p: max(v for q, v in plain if q == p) for p, _ in plain}
    deleted = store.vacuum(keep=0)
    assert "base/generation=5" in deleted and "log/at=8" in deleted and "log/at=9" not in deleted
    assert held(store) == plain


def test_get_and_misses(spark, tmp_path):
    store = S.DocumentStore(spark, f"file://{tmp_path}/s")
    store.put(rows(spark, ("a", 1, '{"schema": 2}'), ("a", 2, '{"schema": 1}'), ("b", 1, None)))
    wanted = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1)], "paper_id string, version int")
    got = {(r.paper_id, r.version): r.body for r in store.get(wanted, F.get_json_object("body", "$.schema") == "2").collect()}
    assert got == {("a", 1): '{"schema": 2}', ("a", 2): None, ("a", 3): None, ("b", 1): None, ("c", 1): None}


def test_a_batch_that_fails_is_not_seen(spark, tmp_path):
    store = S.DocumentStore(spark, f"file://{tmp_path}/s")
    store.put(rows(spark, ("a", 1, "one")))
    with pytest.raises(Exception):
        store.put(rows(spark, ("a", 1, "two")).withColumn("body", F.raise_error(F.lit("broken"))))
    assert held(store) == {("a", 1): "one"}
    store.put(rows(spark, ("a", 1, "three")))
    assert held(store) == {("a", 1): "three"}


PAPERS = [(f"p{i:03}", i) for i in range(90)]


def parser(spark, log, bad=None, die_at=None):
    seen = []

    def parse(todo):
        seen.append(todo.count())
        log.extend([r.paper_id for r in todo.select("paper_id").collect()])
        if die_at is not None and len(seen) == die_at:
            raise RuntimeError("killed")
        return todo.where("n % 45 <> 44").select("paper_id", F.when(F.lit(False) if bad is None else bad, "excluded").otherwise("indexed").alias("outcome"), (F.col("n") * 2).alias("made"))

    return parse


def test_a_killed_reparse_goes_on(spark, tmp_path):
    folder, papers, log = f"file://{tmp_path}/r", spark.createDataFrame(PAPERS + PAPERS[:3] + [(None, 1)], "paper_id string, n int"), []
    with pytest.raises(RuntimeError):
        S.reparse(papers, parser(spark, log, die_at=4), folder, slices=6)
    first = {r.paper_id for r in S.outcomes(spark, folder).collect()}
    assert 0 < len(first) < 90
    log.clear()
    found = S.reparse(papers, parser(spark, log), folder, slices=6)
    assert sorted(log) == sorted({p for p, _ in PAPERS} - first)  # nothing twice
    assert (found["indexed"], found["failed"], found["slices"], found["stopped"], found["within"]) == (88, 2, 3, False, True)
    assert {r.paper_id: r.made for r in S.results(spark, folder).collect()} == {p: None if n % 45 == 44 else 2 * n for p, n in PAPERS}
    log.clear()
    assert S.reparse(papers, parser(spark, log), folder, slices=6)["slices"] == 0 and log == []
    more = papers.union(spark.createDataFrame([("new", 1)], "paper_id string, n int"))
    S.reparse(more, parser(spark, log), folder, slices=6)
    assert log == ["new"]
    log.clear()
    S.reparse(papers, parser(spark, log), folder, slices=6, retry=True)
    assert sorted(log) == [p for p, n in PAPERS if n % 45 == 44]
    assert S.results(spark, folder).count() == 91


def test_the_loss_budget_stops_it(spark, tmp_path):
    papers, log = spark.createDataFrame(PAPERS, "paper_id string, n int"), []
    found = S.reparse(papers, parser(spark, log, bad=F.col("n") % 3 == 0), f"file://{tmp_path}/r", slices=6, most_loss=0.2, least=20)
    assert found["stopped"] and not found["within"] and found["slices"] < 6 and len(log) < 90
    assert S.reparse(papers.limit(0), parser(spark, log), f"file://{tmp_path}/empty")["within"] is False
