"""Behaviour, usage and incident analytics: profiles, retention, keyset pages, spend, limits, dashboards, citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia_spark.operators.retrieval import rank_by, top
from scholia_spark.session import drop_table, shared_table, ship_package

#: Weights of signals by event type.
SEARCH_CATEGORY, SEARCH_KEYWORD, OPENED, ADDED, SUMMARY = 0.5, 0.25, 1.0, 3.0, 2.0


def bounded(weights: DataFrame, user: str, key: str, value: str) -> DataFrame:
    """Weights above 0, relative to the user's largest, rounded half to even at 4 places."""
    most = F.max(value).over(Window.partitionBy(user))
    return weights.withColumn("weight", F.bround(F.least(F.lit(1.0), F.col(value) / most), 4)).where(F.col(value) > 0).select(user, key, "weight")


def category_weights(events: DataFrame) -> DataFrame:
    """user_id, category, total of opened, added, summary and search events."""
    value = (
        F.when(F.col("event_type") == "opened", OPENED).when(F.col("event_type") == "added", ADDED)
        .when(F.col("event_type") == "summary", SUMMARY).when(F.col("event_type") == "search", SEARCH_CATEGORY).otherwise(0.0)
    )
    return events.where("category IS NOT NULL").groupBy("user_id", "category").agg(F.sum(value).alias("total")).where("total > 0")


def paper_signals(events: DataFrame) -> DataFrame:
    """user_id, paper_id, total; a removal deletes what the paper had gathered before it."""
    w = Window.partitionBy("user_id", "paper_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    removed = F.max(F.when(F.col("event_type") == "removed", 1)).over(w)
    value = F.when(F.col("event_type") == "opened", OPENED).when(F.col("event_type") == "added", ADDED).otherwise(0.0)
    alive = events.where("paper_id IS NOT NULL").withColumn("_gone", removed).where("_gone IS NULL")
    return alive.groupBy("user_id", "paper_id").agg(F.sum(value).alias("total")).where("total > 0")


def keyword_weights(events: DataFrame) -> DataFrame:
    """user_id, keyword, total over the keywords of searches."""
    found = events.where("event_type = 'search'").select("user_id", F.explode("keywords").alias("keyword")).where("keyword IS NOT NULL")
    return found.groupBy("user_id", "keyword").agg((F.count("*") * SEARCH_KEYWORD).alias("total"))


def last_choices(events: DataFrame) -> DataFrame:
    """user_id, persona, scope and glossary that were chosen last (by time, then event); empty choices don't count."""
    chosen = lambda c, kind: (F.col("event_type") == kind) & (F.coalesce(F.col(c), F.lit("")) != "")
    last = lambda c, kind: F.max_by(F.col(c), F.when(chosen(c, kind), F.struct("ts", "event_id"))).alias(c)
    return events.groupBy("user_id").agg(last("persona", "summary"), last("scope", "summary"), last("glossary", "glossary"))


def search_boosts(weights: DataFrame, ceiling: float = 0.1, total: float = 0.2) -> DataFrame:
    """Each weight times the ceiling, scaled down where a user's boosts exceed the total."""
    part = F.greatest(F.lit(-ceiling), F.least(F.lit(ceiling), F.col("weight") * ceiling))
    df = weights.withColumn("_b", part)
    all_ = F.sum(F.abs("_b")).over(Window.partitionBy("user_id"))
    return df.withColumn("boost", F.round(F.when(all_ > total, F.col("_b") * total / all_).otherwise(F.col("_b")), 9)).select("user_id", "category", "boost")


def keep_newest(df: DataFrame, owner: str, order: list[Column], n: int) -> DataFrame:
    """Rolling retention."""
    return top(df, [owner], order, n, "_n").drop("_n")


def quota_admit(df: DataFrame, owner: str, key: str, order: list[Column], quota: int) -> DataFrame:
    """The first row of each (owner, key), then the first ``quota`` of an owner."""
    first = top(df, [owner, key], order, 1, "_f").drop("_f")
    return top(first, [owner], order, quota, "_q").drop("_q")


def recent_papers(events: DataFrame, n: int = 50) -> DataFrame:
    """Newest open of each distinct paper, n a user."""
    last = events.where("event_type = 'opened'").groupBy("user_id", "paper_id").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    ranked = rank_by(last, ["user_id"], [F.desc("last"), F.col("paper_id")], "place")
    return ranked.where(F.col("place") <= n).select("user_id", "paper_id", F.col("last.ts").alias("ts"), "place")


def keyset_page(df: DataFrame, ts: str, key: str, limit: int, after: tuple | None = None) -> tuple[DataFrame, tuple | None]:
    """Newest first after a (ts, key) cursor; one row more tells whether another page follows. The page is bounded by limit."""
    if after is not None:
        t, k = (F.lit(v).cast(df.schema[c].dataType) for v, c in zip(after, (ts, key), strict=True))
        df = df.where((F.col(ts) < t) | ((F.col(ts) == t) & (F.col(key) < k)))
    rows = df.orderBy(F.desc(ts), F.desc(key)).limit(limit + 1)
    got = rows.collect()
    cursor = (got[limit - 1][ts], got[limit - 1][key]) if len(got) > limit else None
    return rows.limit(limit), cursor


def cursor_parts(code: Column) -> Column:
    """Struct (ts, id) of a cursor; an error where it is no base64url of such a JSON."""
    plain = F.translate(code, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    parts = F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "ts string, id string")
    fine = parts["ts"].isNotNull() & parts["id"].isNotNull()
    return F.when(fine, parts).otherwise(F.raise_error(F.concat(F.lit("bad cursor "), F.coalesce(code, F.lit("null")))).cast("struct<ts: string, id: string>"))


def page_after(df: DataFrame, ts: str, key: str, limit: int, cursor) -> DataFrame:
    """The page behind the row whose key is ``cursor``, newest first; a ValueError if there is no such row."""
    at = df.where(F.col(key) == F.lit(cursor)).select(ts).head()
    if at is None:
        raise ValueError(f"no row {cursor!r}")
    return keyset_page(df, ts, key, limit, (at[ts], cursor))[0]


def offset_page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows behind the first ``offset`` in the given order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def cursor_code(ts: Column, key: Column) -> Column:
    """base64url of the JSON of both parts."""
    return F.translate(F.base64(F.to_json(F.struct(ts.cast("string").alias("ts"), key.cast("string").alias("id"))).cast("binary")), "+/", "-_")


def running_spend(usage: DataFrame, cap: float) -> DataFrame:
    """Repeated event ids count once; running sum, ratio, tier and mode after each event of an owner."""
    first = top(usage, ["owner_id", "event_id"], [F.col("ts")], 1, "_f").drop("_f")
    total = F.sum("amount").over(Window.partitionBy("owner_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    df = first.withColumn("spend", F.round(total, 6)).withColumn("ratio", F.round(F.col("spend") / cap, 6))
    circuit = F.when(F.col("ratio") >= 1.0, "open").when(F.col("ratio") >= 0.8, "half_open").otherwise("closed")
    mode = F.when(F.col("ratio") >= 0.95, "lexical_only").when(F.col("ratio") >= 0.8, "rerank_off").otherwise("normal")
    return df.select("owner_id", "event_id", "spend", "ratio", circuit.alias("circuit"), mode.alias("mode"))


def cost_incidents(usage: DataFrame, cap: float) -> DataFrame:
    """Critical at a ratio of 1, or an amount of 20 % of the cap; warning at .8, an amount of 50, or 100 uses; once an event id."""
    once = usage.groupBy("event_id").agg(F.min(F.struct("ts", "amount", "uses")).alias("e")).select("event_id", "e.*")
    ratio = F.col("amount") / cap
    severity = F.when((ratio >= 1.0) | (F.col("amount") >= 0.2 * cap), "critical").when((ratio >= 0.8) | (F.col("amount") >= 50) | (F.col("uses") >= 100), "warning")
    return once.select("event_id", severity.alias("severity")).where("severity IS NOT NULL")


def collapsed(ledger: DataFrame) -> DataFrame:
    """After each outcome, whether the last 50 failed by more than 60 %, or the last 12 all failed."""
    w = Window.partitionBy("worker").orderBy("seq")
    last, short = w.rowsBetween(-49, 0), w.rowsBetween(-11, 0)
    share = (F.count("*").over(last) == 50) & (F.avg("failed").over(last) > 0.6)
    run = (F.count("*").over(short) == 12) & (F.min("failed").over(short) == 1)
    return ledger.select("worker", "seq", (share | run).alias("collapsed"))


def token_budget(turns: DataFrame, budget: int = 32_000) -> DataFrame:
    """Newest turns while their costs sum to at most the budget; the newest always stays."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn_id")).rowsBetween(Window.unboundedPreceding, 0)
    df = turns.withColumn("running", F.sum("cost").over(w)).withColumn("_n", F.count("*").over(w))
    return df.where((F.col("running") <= budget) | (F.col("_n") == 1)).drop("_n")


def beyond_newest(turns: DataFrame, keep: int) -> DataFrame:
    """Turns beyond the newest ``keep``, with their place from the oldest."""
    older = rank_by(turns, ["session_id"], [F.desc("turn_id")], "_n").where(F.col("_n") > keep).drop("_n")
    return rank_by(older, ["session_id"], [F.col("turn_id")], "place")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which null is one more value; ``right`` has the keys only once more."""
    named = right.select(*[F.col(k).alias(f"_same_{k}") if k in keys else F.col(k) for k in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(named, on).drop(*[f"_same_{k}" for k in keys])


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float, most: int = 100_000) -> DataFrame:
    """keys, n, at: the value at place min(int(n * share), n - 1) of the sorted values of each key, exactly.

    Repeated selection: the range of values that holds the place is cut by two approximate quantiles around it, exact counts say
    which part the place is in, and that part is the next range, until no key's range holds more than ``most`` values or it is
    one value. Only then values are counted one by one and ranked, so a task ranks ``most`` of a key at most, however the values
    are spread. Null keys are a key; null values are left out; NaN is the largest value.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    edges = rows.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    place = F.least(F.floor(F.col("n") * F.lit(share)), F.col("n") - 1)
    ranges = edges.select(*keys, "low", "high", "n", F.lit(0).cast("long").alias("before"), F.col("n").alias("held"), place.alias("place"))
    ranges = shared_table(ranges, "ranges")
    while not ranges.where((F.col("held") > most) & (F.col("low") < F.col("high"))).isEmpty():
        inside = _same(rows, ranges, keys).where(F.col("v").between(F.col("low"), F.col("high")))
        at = (F.col("place") - F.col("before")) / F.col("held")
        # the place is among the middle values of a sketch of a thousand; another place is a part of its own and costs a round
        sketch = inside.groupBy(*keys).agg(F.percentile_approx("v", F.array(*[F.lit(i / 512) for i in range(1, 512)]), 2000).alias("cuts"))
        near = F.floor(at * 512).cast("int")
        low, high = F.coalesce(F.get("cuts", near - 3), F.col("low")), F.coalesce(F.get("cuts", near + 2), F.col("high"))
        half = F.get("cuts", F.lit(255))
        halved = F.when(half < F.col("high"), half).otherwise(F.col("low"))  # below the last value, so both parts lose some
        whole = (low <= F.col("low")) & (high >= F.col("high"))
        cuts = _same(ranges, sketch, keys).select(*keys, low.alias("a"), F.when(whole, halved).otherwise(high).alias("b"))
        part = F.when(F.col("v") < F.col("a"), 0).when(F.col("v") <= F.col("b"), 1).otherwise(2)
        parts = _same(inside, cuts, keys).groupBy(*keys, "n", "before", "place", part.alias("part")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("held"))
        upto = F.sum("held").over(Window.partitionBy(*keys).orderBy("part"))  # three rows a key
        found = parts.withColumn("before", F.col("before") + upto - F.col("held")).where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("held")))
        then = shared_table(found.select(*ranges.columns), "ranges")
        drop_table(ranges)
        ranges = then
    ranked = _same(rows, ranges, keys).where(F.col("v").between(F.col("low"), F.col("high"))).groupBy(*keys, "n", "before", "place", "v").agg(F.count("*").alias("c"))
    reach = F.sum("c").over(Window.partitionBy(*keys).orderBy("v")) + F.col("before")
    return ranked.withColumn("reach", reach).where(F.col("reach") > F.col("place")).groupBy(*keys, "n").agg(F.min("v").alias("at"))


def dashboard(events: DataFrame, start: str, end: str) -> DataFrame:
    """A8 for a closed window: counts, error rate and p95 of each event type."""
    inside = events.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    sums = inside.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("large"))
    p95 = nearest_rank(inside, ["event_type"], "value", 0.95).select("event_type", F.col("at").alias("p95"))
    p95 = p95.withColumnRenamed("event_type", "_type")
    return sums.join(p95, F.col("event_type").eqNullSafe(F.col("_type")), "left").select("event_type", "n", "large", F.round(F.col("large") / F.col("n"), 6).alias("rate"), "p95")


def request_metrics(metrics: DataFrame, incidents: DataFrame, start, end) -> DataFrame:
    """One row of a closed window: incidents, throughput, errors, error_rate, p95 of latencies, and grounding verdicts.

    metrics: ts, name (latency, throughput, grounding), value, status, verdict; incidents: ts. Throughput counts its own rows
    only, and errors are latencies with a status of 5xx, so a request counts once.
    """
    within = lambda df: df.where(F.col("ts").between(start, end))
    m, name = within(metrics), F.col("name")
    verdict = lambda v: F.count_if((name == "grounding") & (F.coalesce("verdict", F.lit("unknown")) == v))
    sums = m.agg(
        F.count_if(name == "throughput").cast("double").alias("throughput"), F.count_if((name == "latency") & F.coalesce(F.col("status").startswith("5"), F.lit(False))).alias("errors"),
        *[verdict(v).alias(f"grounding_{v}") for v in ("pass", "block", "abstain", "unknown")],
    )
    p95 = nearest_rank(m.where("name = 'latency'").withColumn("one", F.lit(1)), ["one"], "value", 0.95).agg(F.round(F.max("at"), 6).alias("p95"))
    rate = F.when(F.col("throughput") > 0, F.round(F.col("errors") / F.col("throughput"), 6)).otherwise(F.when(F.col("errors") > 0, 1.0).otherwise(0.0))
    one = sums.crossJoin(p95).crossJoin(within(incidents).agg(F.count("*").alias("incidents")))  # one row each
    return one.withColumn("error_rate", rate)


def counts_by_class(events: DataFrame, classes: list[str], column: str) -> DataFrame:
    """Counts over a fixed list of classes, zero where none occurred."""
    spark = events.sparkSession
    every = spark.createDataFrame([(c,) for c in classes], f"{column} string")
    return every.join(events.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def advance_watermarks(stored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per source the later of the stored and all candidate times; a watermark never goes back."""
    return stored.unionByName(candidates).groupBy("source").agg(F.max("ts").alias("ts"))




def sliding_limit(calls: DataFrame, limit: int = 60, seconds: float = 60.0) -> DataFrame:
    """A call passes while fewer than ``limit`` calls passed in the last ``seconds``; rejected calls don't count.

    Keys stream in the order of time; the state of a key is at most ``limit`` times.
    """
    from collections import deque

    def run(it):
        now, passed = None, deque()
        for pdf in it:
            out = []
            for key, call, t in zip(pdf["key"], pdf["call_id"], pdf["t"], strict=True):
                if key != now:
                    now, passed = key, deque()
                while passed and t - passed[0] >= seconds:
                    passed.popleft()
                ok = len(passed) < limit
                if ok:
                    passed.append(t)
                out.append((key, call, ok))
            yield pd.DataFrame(out, columns=["key", "call_id", "allowed"])

    ship_package(calls.sparkSession)
    ordered = calls.select("key", "call_id", "t").repartition("key").sortWithinPartitions("key", "t", "call_id")
    return ordered.mapInPandas(run, "key long, call_id long, allowed boolean")


def fixed_limit(calls: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Windows begin at a key's first call, the next one at the first call after its end; all calls count."""

    def run(it):
        now, reset, n = None, 0.0, 0
        for pdf in it:
            out = []
            for key, call, t in zip(pdf["key"], pdf["call_id"], pdf["t"], strict=True):
                if key != now or t >= reset:
                    now, reset, n = key, t + seconds, 0
                n += 1
                out.append((key, call, n <= limit))
            yield pd.DataFrame(out, columns=["key", "call_id", "allowed"])

    ship_package(calls.sparkSession)
    ordered = calls.select("key", "call_id", "t").repartition("key").sortWithinPartitions("key", "t", "call_id")
    return ordered.mapInPandas(run, "key long, call_id long, allowed boolean")


def citation_tree(edges: DataFrame, visible: int = 30) -> DataFrame:
    """Per root the citations in the order of citations (0 counts as unknown), year, title; a node that is the
    root or came earlier is flagged; nodes without id or title are unresolved; ``visible`` nodes are shown.
    """
    cited = F.when(F.coalesce("citations", F.lit(0)) == 0, -1).otherwise(F.col("citations"))
    order = [cited.desc(), F.coalesce("year", F.lit(0)).desc(), F.col("title"), F.col("node_id")]
    resolved = edges.where("node_id IS NOT NULL AND title IS NOT NULL")
    ranked = rank_by(resolved, ["root"], order, "place")
    again = F.row_number().over(Window.partitionBy("root", "node_id").orderBy("place")) > 1
    return ranked.withColumn("already_shown", again | (F.col("node_id") == F.col("root"))).where(F.col("place") <= visible).select("root", "node_id", "place", "already_shown")


def citation_totals(edges: DataFrame, visible: int = 30) -> DataFrame:
    """Per root shown, unresolved and remaining counts, status and unresolved ratio."""
    bad = F.count_if(F.col("node_id").isNull() | F.col("title").isNull())
    df = edges.groupBy("root").agg(F.count("*").alias("total"), bad.alias("unresolved"))
    df = df.withColumn("shown", F.least(F.lit(visible), F.col("total") - F.col("unresolved")))
    remaining = F.greatest(F.lit(0), F.col("total") - F.col("shown") - F.col("unresolved"))
    status = F.when(F.col("unresolved") > 0, "partial").otherwise("complete")
    return df.select("root", "shown", "unresolved", remaining.alias("remaining"), status.alias("status"), F.round(F.col("unresolved") / F.greatest(F.lit(1), F.col("shown") + F.col("unresolved")), 6).alias("ratio"))


def contiguous_prefix(numbers: DataFrame) -> DataFrame:
    """Per key the largest N with 1..N all present."""
    d = numbers.select("key", "n").distinct()
    ranked = rank_by(d, ["key"], [F.col("n")], "place")
    return ranked.groupBy("key").agg(F.coalesce(F.max(F.when(F.col("n") == F.col("place"), F.col("n"))), F.lit(0)).alias("prefix"))


def backfill(events: DataFrame, resolver: DataFrame) -> DataFrame:
    """Events (paper_id, category) with the category that resolver (paper_id, found) knows where they have none; ``state`` says what happened."""
    df = events.join(resolver, "paper_id", "left")
    state = F.when(F.col("category").isNotNull(), "kept").when(F.col("found").isNotNull(), "updated").otherwise("unresolved")
    return df.withColumn("state", state).withColumn("category", F.coalesce("category", "found")).drop("found")


def backfill_counts(filled: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return filled.agg(F.count("*").alias("scanned"), count("updated"), count("unresolved"))
