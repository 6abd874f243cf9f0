"""Evaluation of turns, routing of incident signals, throttling, live candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia_spark.functions import ids
from scholia_spark.operators.activity import cost_incidents
from scholia_spark.operators.gates import first_by
from scholia_spark.operators.serving import hallucination_incidents

NEEDS_COUNTER = ("claim", "comparison")


def turn_scores(turns: DataFrame, trace: DataFrame, refs: DataFrame, segments: DataFrame, search_tools: list[str], top_k: int = 10) -> DataFrame:
    """Q20: metrics and violations of each turn (one row of ``turns`` a case).

    turns: case_id, expected_kind, expected_papers, abstained, claims, rejected, has_answer, fallback; trace: case_id, tool,
    stance, outcome; refs: case_id, claim (from 1), paper_id, record_ref; segments: case_id, kind, refs (claim numbers).
    Shares over nothing are null. An abstained turn has neither citations nor an answer to judge.
    """
    tool = F.col("tool").isin(*search_tools)
    searched = trace.groupBy("case_id").agg(F.count_if(tool).alias("searches"), F.count_if(tool & (F.col("stance") == "counter") & F.col("outcome").isin("ok", "empty")).alias("probes"))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    near = F.when((F.col("claim") <= top_k) & filled("paper_id"), ids.id_key(F.col("paper_id")))
    cited = refs.groupBy("case_id").agg(F.count("*").alias("refs"), F.count_if(filled("paper_id") & filled("record_ref")).alias("real"), F.collect_set(near).alias("cited"))
    claims = turns.select("case_id", "claims")
    stray = lambda: F.exists(F.col("refs"), lambda n: (n < 1) | (n > F.col("claims")))
    said = segments.join(claims, "case_id").groupBy("case_id").agg(F.count("*").alias("said"), F.count_if(F.col("kind") == "synthesis").alias("synthesis"), F.max(F.coalesce(stray(), F.lit(False))).alias("stray"))
    df = turns
    for part in (searched, cited, said):
        df = df.join(part, "case_id", "left")
    df = df.na.fill(0, ["searches", "probes", "refs", "real", "said", "synthesis"]).withColumn("stray", F.coalesce("stray", F.lit(False)))
    answers, kind = ~F.col("abstained"), F.col("expected_kind")
    spoken = answers & F.col("has_answer")
    expected = F.array_distinct(F.transform("expected_papers", ids.id_key))
    rules = {
        "searched_out_of_scope": (kind == "out_of_scope") & (F.col("searches") > 0), "answered_out_of_scope": (kind == "out_of_scope") & answers,
        "no_counter_probe": kind.isin(*NEEDS_COUNTER) & answers & (F.col("probes") == 0), "unreal_citation": answers & (F.col("real") < F.col("refs")), "no_answer": answers & ~F.col("has_answer"),
        "empty_answer": spoken & (F.col("said") == 0), "stray_reference": spoken & ~F.col("fallback") & F.col("stray"),
    }
    share = lambda on, a, b: F.when(on & (b > 0), a / b)
    judged = F.when(F.col("abstained"), 0).otherwise(F.col("claims"))
    met = F.size(F.array_intersect(expected, F.coalesce("cited", F.array().cast("array<string>"))))
    return df.select(
        "case_id", "searches", F.col("probes").alias("counter_probes"), share(F.lit(True), F.col("rejected"), F.col("rejected") + judged).alias("gate_rejection"),
        share(answers, F.col("real"), F.col("refs")).alias("citation_reality"), share(spoken, F.col("synthesis"), F.col("said")).alias("synthesis_ratio"), share(answers, met, F.size(expected)).alias("recall_at_k"),
        F.array_compact(F.array(*[F.when(on, F.lit(code)) for code, on in rules.items()])).alias("violations"),
    )


def routed_incidents(signals: DataFrame, cap: float) -> DataFrame:
    """Each signal goes to the detector of its kind; others give nothing.

    signals: event_id, kind (usage, grounding, partial_result), ts, amount, uses, request_id, verdict, reason (what a partial
    result lacks, null for none). Output: event_id, incident_class, severity.
    """
    of = lambda kind: signals.where(F.col("kind") == kind)
    cost = cost_incidents(of("usage").select("event_id", "ts", "amount", "uses"), cap)
    ground = hallucination_incidents(of("grounding").select(F.col("event_id").alias("signal_id"), "verdict", F.coalesce("request_id", "event_id").alias("request_id"))).withColumnRenamed("signal_id", "event_id")
    partial = of("partial_result").where("reason IS NOT NULL").withColumn("severity", F.when(F.contains("reason", F.lit("failure")), "critical").otherwise("warning"))
    named = lambda df, name: df.select("event_id", F.lit(name).alias("incident_class"), "severity")
    return named(cost, "cost_explosion").unionByName(named(ground, "hallucination")).unionByName(named(partial, "partial_result"))


def token_bucket(requests: DataFrame, rate: float, capacity: float) -> DataFrame:
    """When each request of an owner gets its tokens from a bucket that starts full, in the order of (at, seq).

    requests: owner_id, seq, at (seconds), amount. A request waits until the bucket holds its amount; one above the capacity
    takes it in parts; one of nothing doesn't wait. With ``w`` as work before a request in seconds, the bucket is full again at
    the largest (at - w) so far plus the work so far, so two running windows give what a loop over requests would.
    """
    if rate <= 0 or capacity <= 0:
        raise ValueError("rate and capacity must be positive")
    so_far = Window.partitionBy("owner_id").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    work = F.greatest(F.coalesce(F.col("amount").cast("double"), F.lit(0.0)), F.lit(0.0)) / rate
    df = requests.withColumn("_work", work).withColumn("_done", F.sum("_work").over(so_far))
    # a request of nothing starts no work, so it doesn't count for the start
    start = F.max(F.when(F.col("_work") > 0, F.col("at") - (F.col("_done") - F.col("_work")))).over(so_far)
    granted = F.when(F.col("_work") > 0, F.greatest(F.col("at").cast("double"), F.col("_done") + F.col("_start") - F.lit(capacity / rate))).otherwise(F.col("at").cast("double"))
    return df.withColumn("_start", start).withColumn("granted_at", granted).withColumn("waited", F.col("granted_at") - F.col("at")).drop("_work", "_done", "_start")


def count_page(chunks: DataFrame, size: int, after: str | None = None) -> DataFrame:
    """A3: chunks per paper, ``size`` papers in the order of their ids behind ``after``. Papers before it are not counted anew."""
    df = chunks if after is None else chunks.where(F.col("paper_id") > after)
    return df.where("paper_id IS NOT NULL").groupBy("paper_id").agg(F.count("*").alias("chunks")).orderBy("paper_id").limit(size)


def live_candidates(records: DataFrame) -> DataFrame:
    """Records (request_id, place, arxiv_id, doi, ...) of several sources once a paper: the first in place that can be cited.

    The key is the arXiv id, also one inside its own DOI, else the DOI; records with neither, or with a malformed arXiv id,
    can't be cited.
    """
    key = ids.live_key(F.col("arxiv_id"), F.col("doi"))
    named = F.substring(key, 7, 1_000)
    fit = F.when(F.startswith(key, F.lit("arxiv:")), ids.versioned_arxiv(named).isNotNull()).otherwise(F.length(key) > 4)
    return first_by(records.withColumn("key", key).where(F.coalesce(fit, F.lit(False))), ["request_id", "key"], [F.col("place")])


def registered_hits(hits: DataFrame) -> DataFrame:
    """Of a job's hits (job_id, seq, pos, paper_id, origin) the first of each paper, with the distinct papers seen up to it."""
    first = first_by(hits.where("paper_id IS NOT NULL"), ["job_id", "paper_id"], [F.col("seq"), F.col("pos")])
    order = Window.partitionBy("job_id").orderBy("seq", "pos", "paper_id")
    return first.withColumn("candidates", F.row_number().over(order))


def ordered_keys(*keys: Column) -> Column:
    """U4: distinct keys in their order, without nulls and empty strings."""
    return F.array_distinct(F.filter(F.array(*keys), lambda k: k != ""))


def owned(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """items (owner_id, item_id, ...) that a request (request_id, owner_id, item_id) names and owns; a null item_id asks for
    all of the owner's. Ids of another owner find nothing."""
    w = wanted.select("request_id", "owner_id", F.col("item_id").alias("_item"))
    one = items.join(w.where("_item IS NOT NULL"), (items["owner_id"] == w["owner_id"]) & (items["item_id"] == w["_item"])).select("request_id", *[items[c] for c in items.columns])
    every = items.join(w.where("_item IS NULL").drop("_item"), "owner_id").select("request_id", *items.columns)
    return one.unionByName(every)
