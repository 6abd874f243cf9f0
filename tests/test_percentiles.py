"""Exact places of values however they are spread."""

import random

import pytest

from scholia_spark.operators import activity


def plain(rows, share):
    held = {}
    for k, v in rows:
        if v is not None:
            held.setdefault(k, []).append(v)
    order = lambda v: (v != v, v if v == v else 0.0)
    return {k: (len(vs), repr(sorted(vs, key=order)[min(int(len(vs) * share), len(vs) - 1)])) for k, vs in held.items()}


def found(spark, rows, share, most):
    df = spark.createDataFrame(rows, "k string, v double")
    return {r["k"]: (r["n"], repr(r["at"])) for r in activity.nearest_rank(df, ["k"], "v", share, most).collect()}


@pytest.mark.parametrize("most", [7, 10_000])
@pytest.mark.parametrize("share", [0.0, 0.95])
def test_heavy_tails_null_keys_and_ties(spark, most, share):
    rnd = random.Random(int(share * 100) + most)
    rows = [("tail", rnd.random()) for _ in range(900)] + [("tail", 1e9), ("tail", -1e300), ("tail", float("inf"))]
    rows += [("exp", 2.0 ** rnd.randrange(-900, 900)) for _ in range(700)] + [("same", 5.0)] * 400 + [("same", rnd.choice([4.0, 6.0])) for _ in range(50)]
    rows += [(None, rnd.gauss(0, 1)) for _ in range(300)] + [("nan", float("nan")), ("nan", 1.0), ("one", 3.0), ("none", None), ("null", None), ("null", 2.0)]
    rnd.shuffle(rows)
    assert found(spark, rows, share, most) == plain(rows, share)


def test_one_outlier_among_many(spark):
    """With an equal-width split all small values would share one cell; here no range above the bound is ranked."""
    n = 200_000
    df = spark.range(n).selectExpr("'a' AS k", "CASE WHEN id = 0 THEN 1e9 ELSE id / 1e6 END AS v")
    row = activity.nearest_rank(df, ["k"], "v", 0.95, most=1_000).head()
    assert row["n"] == n and row["at"] == sorted([1e9] + [i / 1e6 for i in range(1, n)])[int(n * 0.95)]


def test_dashboard_keeps_a_null_type(spark):
    df = spark.sql("SELECT cast(TIMESTAMP '2021-01-01' AS timestamp_ntz) AS ts, event_type, value FROM VALUES (null, 5.0D), ('a', 200.0D), ('a', 1.0D) AS t(event_type, value)")
    got = {r.event_type: (r.n, r.p95) for r in activity.dashboard(df, "2020-01-01", "2022-01-01").collect()}
    assert got == {None: (1, 5.0), "a": (2, 200.0)}
