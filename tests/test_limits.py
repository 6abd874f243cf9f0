"""Stream state in micro-batches against the batch forms and plain loops."""

import random
from collections import OrderedDict

import pytest

from scholia_spark.operators import activity
from scholia_spark.streaming import limits


def in_batches(spark, path, rows, schema, cuts):
    """A stream that gets a file of rows a batch."""
    for i, part in enumerate(cuts):
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.mode("append").parquet(f"{path}/in-{i:03}")
    return [f"{path}/in-{i:03}" for i in range(len(cuts))]


def run(spark, tmp_path, rows, schema, cuts, transform):
    """One query over folders that arrive one by one; what it gave, and the rows of its state at the end."""
    top = f"file://{tmp_path}"
    (tmp_path / "stream").mkdir()
    files = in_batches(spark, top, rows, schema, cuts)
    out, progress = [], None
    for f in files:
        for p in sorted((tmp_path / f.rsplit("/", 1)[1]).glob("*.parquet")):
            p.rename(tmp_path / "stream" / f"{f.rsplit('/', 1)[1]}-{p.name}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/stream")
        q = transform(stream).writeStream.outputMode("append").foreachBatch(lambda b, i: out.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        progress = q.lastProgress or progress
    return out, progress


CALLS = "key long, call_id long, t double"


def made(seed, n=120):
    """Calls out of order by less than ten seconds, in batches of files; a call far ahead flushes the rest."""
    rnd = random.Random(seed)
    calls = [(rnd.randrange(3), i, round(1_000 + i * 0.7 + rnd.choice([0, 0, rnd.random() * 5]), 3)) for i in range(n)]
    calls += [(k, n + k, 1_000_000.0) for k in range(3)] + [(9, n + 9, 2_000_000.0)]
    cuts = [range(0, 40), range(40, 90), range(90, n), range(n, n + 3), range(n + 3, n + 4)]
    return calls, cuts


@pytest.mark.parametrize("kind", ["sliding", "fixed"])
def test_batches_equal_the_whole(spark, tmp_path, kind):
    calls, cuts = made(3)
    limiter = limits.SlidingLimit(4, 12.0) if kind == "sliding" else limits.FixedLimit(4, 12.0)
    got, progress = run(spark, tmp_path, calls, CALLS, cuts, lambda s: limits.limited(s, limiter, "10 seconds"))
    whole = spark.createDataFrame(calls, CALLS)
    want = activity.sliding_limit(whole, 4, 12.0) if kind == "sliding" else activity.fixed_limit(whole, 4, 12.0)
    # the calls that flush are judged only when later ones come
    assert sorted(got) == sorted(tuple(r) for r in want.collect() if r.call_id < 120 + 3)
    assert {a for *_, a in got} == {True, False}


def test_late_calls_have_no_row(spark, tmp_path):
    calls = [(1, 0, 100.0), (1, 1, 500.0), (1, 2, 100.5), (1, 3, 501.0), (1, 4, 9_000.0), (1, 5, 19_000.0)]
    got, _ = run(spark, tmp_path, calls, CALLS, [range(0, 2), range(2, 4), range(4, 5), range(5, 6)], lambda s: limits.limited(s, limits.SlidingLimit(1, 50.0), "10 seconds"))
    assert sorted(got) == [(1, 0, True), (1, 1, True), (1, 3, False), (1, 4, True)]


def plain_seen(signals, most):
    held, out = {}, []
    for key, i, arrival in signals:
        seen = held.setdefault(key, OrderedDict())
        if i not in seen:
            seen[i] = None
            if len(seen) > most:
                seen.popitem(last=False)
            out.append((key, i, arrival))
    return out


def test_evicting_set(spark, tmp_path):
    rnd = random.Random(5)
    signals = [(rnd.randrange(2), f"s{rnd.randrange(12)}", n) for n in range(150)]
    got, _ = run(spark, tmp_path, signals, "key long, id string, arrival long", [range(0, 50), range(50, 51), range(51, 150)], lambda s: limits.first_deliveries(s, 5))
    assert sorted(got, key=lambda r: r[2]) == plain_seen(signals, 5)
    assert len(got) > len({(k, i) for k, i, _ in signals})  # some were evicted and came again
