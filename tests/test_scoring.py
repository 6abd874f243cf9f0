"""Anchors, buckets and fields against plain loops and by hand."""

import random

from pyspark.sql import functions as F

from scholia_spark.operators import gates as G
from scholia_spark.operators import retrieval as R
from scholia_spark.operators import scoring as S


def plain_bucket(requests, rate, capacity):
    """The bucket as a loop: refill, take what there is up to the capacity, wait for the rest."""
    held, clock, out = capacity, 0.0, {}
    for at, seq, amount in sorted(requests):
        left, now = max(amount, 0.0), max(at, clock)
        if left == 0:
            out[seq] = at
            continue
        while left > 1e-12:
            part = min(left, capacity)
            held, clock = min(capacity, held + (now - clock) * rate), now
            if held < part:
                now += (part - held) / rate
                held, clock = part, now
            held, left = held - part, left - part
        out[seq] = now
    return out


def test_token_bucket(spark):
    rng = random.Random(5)
    rows = [(o, s, float(rng.randrange(60)), float(rng.choice([0, 1, 2, 5, 11]))) for o in "ab" for s in range(60)] + [("c", 0, 3.0, 25.0), ("d", 0, 1.0, -1.0)]
    got = S.token_bucket(spark.createDataFrame(rows, "owner_id string, seq int, at double, amount double"), 2.0, 4.0).collect()
    assert len(got) == len(rows)
    for owner in "abcd":
        want = plain_bucket([(at, s, n) for o, s, at, n in rows if o == owner], 2.0, 4.0)
        for r in got:
            if r["owner_id"] == owner:
                assert abs(r["granted_at"] - want[r["seq"]]) < 1e-9


def test_anchors(spark):
    anchors = [("p", 1, "f", "Section 2: Results", None), ("p", 2, "f", "the additional results of it", ""), ("p", 3, "f", None, "Table 2"), ("p", 4, "g", "nowhere", "none"), ("p", 5, "f", "results", ""), ("q", 1, "f", "kept as it is", None), ("p", 6, "f", "", None)]
    locations = [("p", 1, "Table 2"), ("p", 2, "2 Results"), ("p", 3, "Results"), ("p", 4, "Additional Results"), ("p", 5, "")]
    a = spark.createDataFrame(anchors, "id string, pos int, field string, label string, target string")
    loc = spark.createDataFrame(locations, "id string, ord int, label string")
    got = {(r["id"], r["pos"]): r["found"] for r in G.draft_anchors(a, loc).collect()}
    assert got == {("p", 1): "2 Results", ("p", 2): "Additional Results", ("p", 3): "Table 2", ("p", 4): None, ("p", 5): "Results", ("q", 1): "kept as it is", ("p", 6): None}
    drafts = spark.createDataFrame([("p", "t", "m", "95.3 of 7", False, {"code": "", "data": ""}, "95.34", ["7 x"]), ("q", None, "m", None, True, None, None, None)], "id string, tldr string, method string, results string, truncated boolean, reproducibility map<string,string>, body string, captions array<string>")
    rows = {r["id"]: r for r in G.summary_verdict(drafts, a, loc).collect()}
    assert rows["p"]["outcome"] == "pass" and rows["p"]["violations"] == ["anchor_missing"] * 2 and rows["p"]["kept"] == ["f:2 Results", "f:Additional Results", "f:Table 2", "f:Results"]
    assert rows["q"]["outcome"] == "abstain" and rows["q"]["violations"] == ["empty", "truncated", "schema_incomplete"] and rows["q"]["kept"] == ["f:kept as it is"]


def test_fields_without_tokens_do_not_count(spark):
    chunks = spark.createDataFrame([(1, 1, ["a", "b"], ["a"]), (2, 2, ["b"], []), (3, 3, ["a"], None)], "chunk_id int, paper_id int, body array<string>, title array<string>")
    queries = spark.createDataFrame([(9, ["a"])], "query_id int, terms array<string>")
    one = {r["paper_id"]: r["score"] for r in R.bm25(queries, chunks, fields=("title",)).collect()}
    both = {r["paper_id"]: r["score"] for r in R.bm25(queries, chunks, fields=("title", "body")).collect()}
    body = {r["paper_id"]: r["score"] for r in R.bm25(queries, chunks, fields=("body",)).collect()}
    assert set(one) == {1} and both == {1: max(one[1], body[1]), 3: body[3]}


def test_owned_and_keys(spark):
    items = spark.createDataFrame([("u", 1), ("u", 2), ("v", 3)], "owner_id string, item_id int")
    wanted = spark.createDataFrame([(1, "u", 3), (2, "u", 2), (3, "u", None), (4, None, None)], "request_id int, owner_id string, item_id int")
    assert {(r["request_id"], r["item_id"]) for r in S.owned(items, wanted).collect()} == {(2, 2), (3, 1), (3, 2)}
    row = spark.range(1).select(S.ordered_keys(F.lit("b"), F.lit(None).cast("string"), F.lit(""), F.lit("a"), F.lit("b")).alias("k")).head()
    assert row["k"] == ["b", "a"]
