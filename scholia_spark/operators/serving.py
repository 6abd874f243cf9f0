"""Serving operators: scoped lists and pages, degraded modes, result assembly, turn and job state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia_spark.operators.retrieval import rank_by
from scholia_spark.session import ship_package


def scoped(chunks: DataFrame, years: tuple[int | None, int | None] = (None, None), abstract_only: bool = False) -> DataFrame:
    """bounds of the year (inclusive, null: open) and the abstract scope. Plain filters, so they reach the scan and leave scores alone."""
    if years[0] is not None:
        chunks = chunks.where(F.col("year") >= years[0])
    if years[1] is not None:
        chunks = chunks.where(F.col("year") <= years[1])
    return chunks.where("section = 'abstract'") if abstract_only else chunks


def listed_with_total(assets: DataFrame, limit: int) -> DataFrame:
    """Each paper's newest version, ordered by type and ordinal, at most ``limit`` rows, with the count before the limit."""
    newest = assets.groupBy("paper_id").agg(F.max("version").alias("version"))
    rows = assets.join(newest, ["paper_id", "version"])
    totals = rows.groupBy("paper_id").agg(F.count("*").alias("total"))
    return rank_by(rows, ["paper_id"], [F.col("type"), F.col("ordinal"), F.col("asset_id")], "_n").where(F.col("_n") <= limit).drop("_n").join(totals, "paper_id")


def ranked_candidates(candidates: DataFrame, top_n: int) -> DataFrame:
    """By descending score, then paper; one row number a query."""
    return rank_by(candidates, ["query_id"], [F.desc("ranking_score"), F.col("paper_id")], "rank").where(F.col("rank") <= top_n)


def messages_after(messages: DataFrame, after: tuple | None, limit: int) -> DataFrame:
    """Ascending page behind the key (created_at, id). The limit is the page; sort and limit run as one top-k."""
    if after:
        t, i = F.lit(after[0]), F.lit(after[1])
        messages = messages.where((F.col("created_at") > t) | ((F.col("created_at") == t) & (F.col("id") > i)))
    return messages.orderBy("created_at", "id").limit(limit)


def oldest(rows: DataFrame, states: list[str], before: Column, time: str, key: str, limit: int) -> DataFrame:
    """Rows in ``states`` older than ``before``, oldest first, one batch."""
    return rows.where(F.col("state").isin(*states) & (F.col(time) < before)).orderBy(time, key).limit(limit)


def trace_after(trace: DataFrame, after_seq: int) -> DataFrame:
    """Records behind a polling cursor."""
    return trace.where(F.col("seq") > after_seq)


def missing_ids(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't stored."""
    return wanted.join(stored.select(key).distinct(), key, "left_anti")


def references_known(refs: Column, known: Column) -> Column:
    """Every reference is known."""
    return F.size(F.array_except(refs, known)) == 0


def recall_of_sets(expected: Column, cited: Column) -> Column:
    """Share of the expected ids that are cited; null without expected ids."""
    want = F.array_distinct(expected)
    return F.try_divide(F.size(F.array_intersect(want, cited)).cast("double"), F.size(want).cast("double"))


def space_mismatch(stored: Column, reader: Column) -> Column:
    """Q9: provider, model or dimensions differ. Both are structs; a routing prefix of the model (``us.``) is left out, and null parts agree with all."""
    model = lambda c: F.regexp_replace(c["model"], r"^(?:us|eu|apac|global)\.", "")
    differs = lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)
    return differs(stored["provider"], reader["provider"]) | differs(model(stored), model(reader)) | differs(stored["dimensions"], reader["dimensions"])


def degrade_mode(raw: Column) -> Column:
    """Q10: lexical-only, rerank-off or normal (also for unknown modes)."""
    mode = F.replace(F.lower(raw), F.lit("_"), F.lit("-"))
    return F.when(mode.isin("lexical-only", "rerank-off"), mode).otherwise("normal")


def result_status(abstain: Column, linked: Column, mode: Column) -> Column:
    """Q11: abstain, empty page, page or degraded page by the number of linked cards."""
    return F.when(abstain, "abstain").when(linked == 0, "empty_page").when(mode == "normal", "page").otherwise("degraded_page")


def evidence_status(items: Column, reason: Column, candidates: Column) -> Column:
    """Q17: ok, or why there is no answer."""
    return (
        F.when(items > 0, "ok").when(reason == "fatal_error", "llm_failure").when(reason == "cancelled", "cancelled")
        .when(candidates == 0, "out_of_corpus").otherwise("insufficient")
    )


#: Keys that an artifact may not claim.
FORBIDDEN_CLAIMS = ("novelty_score", "noveltyScore", "novelty_certainty", "noveltyCertainty", "publishability", "publishability_verdict")
#: Kinds of artifacts whose references are checked.
REFERENCED_KINDS = ("similar_works", "gap_analysis", "novelty_candidates", "experiment_plan")


def artifact_rejection(kind: Column, payload: Column, refs: Column, known: Column, gap_status: Column, scope_note: Column) -> Column:
    """Q18: the first reason to refuse an artifact, else null. ``payload`` is its JSON text; a forbidden key counts at any depth."""
    keys = '"(?:' + "|".join(FORBIDDEN_CLAIMS) + ')"\\s*:'
    checked = kind.isin(*REFERENCED_KINDS)
    return (
        F.when(F.regexp_like(payload, F.lit(keys)), "forbidden_claim")
        .when(~kind.isin("evidence", "external_findings", *REFERENCED_KINDS), "unsupported_kind")
        .when(checked & (kind != "experiment_plan") & (F.size(refs) == 0), "missing_source_refs")
        .when(checked & ~references_known(refs, known), "unknown_source_ref")
        .when((kind == "gap_analysis") & (gap_status == "open_gap") & (F.coalesce(F.trim(scope_note), F.lit("")) == ""), "missing_scope_note")
    )


def report_means(reports: DataFrame) -> DataFrame:
    """Means that leave nulls out (zeros count); probes only over kinds that need them and turns that answered."""
    needs = F.col("expected_kind").isin("claim", "comparison") & ~F.col("abstained")
    share = lambda c: F.avg(c.cast("double"))
    return reports.agg(
        F.count("*").alias("cases"), share(F.col("abstained")).alias("abstain_rate"), F.avg("citation_reality").alias("citation_reality"), F.avg("synthesis_ratio").alias("synthesis_ratio"),
        share(F.when(needs, F.col("counter_probes") > 0)).alias("counter_probe_rate"), F.avg("recall_at_k").alias("recall_at_k"),
    )


def counter_probes(trace: DataFrame, tools: list[str]) -> DataFrame:
    """Searches for the other side that ran, per job."""
    counted = (F.col("stance") == "counter") & F.col("tool").isin(*tools) & F.col("outcome").isin("ok", "empty")
    return trace.groupBy("job_id").agg(F.count_if(counted).alias("probes"))


def lacks_counter_probe(kind: Column, probes: Column, affordable: Column) -> Column:
    """G3."""
    return kind.isin("claim", "comparison") & (probes == 0) & affordable


def tool_call_budget(calls: DataFrame, total: int, per_tool: dict[str, int], cost_cap: float) -> DataFrame:
    """Calls (job_id, seq, tool, cost) in order; refused ones use nothing. Checks: total, tool, cost.

    Jobs stream in the order of their calls; the state of a job is a count a tool and what it spent. Null jobs are one job.
    """
    import pandas as pd

    def run(it):
        now, used, spent = object(), {}, 0.0
        for pdf in it:
            out = []
            for job, seq, tool, cost in zip(pdf["job_id"], pdf["seq"], pdf["tool"], pdf["cost"], strict=True):
                job = None if pd.isna(job) else int(job)
                if job != now:
                    now, used, spent = job, {}, 0.0
                if sum(used.values()) >= total:
                    verdict = "tool_calls_exhausted"
                elif used.get(tool, 0) >= per_tool.get(tool, total):
                    verdict = "tool_cap_exhausted"
                elif spent >= cost_cap:
                    verdict = "cost_exhausted"
                else:
                    used[tool], spent, verdict = used.get(tool, 0) + 1, spent + cost, "ok"
                out.append((job, seq, verdict))
            yield pd.DataFrame(out, columns=["job_id", "seq", "verdict"]).astype({"job_id": "Int64"})

    ship_package(calls.sparkSession)
    ordered = calls.select("job_id", "seq", "tool", "cost").repartition("job_id").sortWithinPartitions("job_id", "seq")
    return ordered.mapInPandas(run, "job_id long, seq long, verdict string")


def last_observations(observations: DataFrame, keep: int = 6) -> DataFrame:
    """G7."""
    return rank_by(observations, ["job_id"], [F.desc("seq")], "_n").where(F.col("_n") <= keep).drop("_n")


def year_bound(value: Column) -> Column:
    """The year as a number; unreadable values are left out."""
    return F.trim(value).try_cast("int")


def fallback_sentence(statement: Column, supporting: Column, conflicting: Column, named: int = 3) -> Column:
    """The statement with at most ``named`` papers on each side; the rest are counted."""

    def listing(ids: Column) -> Column:
        ids = F.array_distinct(F.filter(ids, lambda x: x != ""))
        rest = F.size(ids) - named
        return F.concat(F.array_join(F.slice(ids, 1, named), ", "), F.when(rest > 0, F.concat(F.lit(" 외 "), rest.cast("string"), F.lit("편"))).otherwise(""))

    some = lambda ids: F.exists(ids, lambda x: x != "")
    base = F.regexp_replace(statement, "[.。 ]+$", "")
    agree = F.when(some(supporting), F.concat(F.lit(" ("), listing(supporting), F.lit("에서 확인됨)"))).otherwise("")
    differ = F.when(some(conflicting), F.concat(F.lit(". 다만 "), listing(conflicting), F.lit("는 다른 결과를 보고합니다"))).otherwise("")
    return F.concat(base, agree, differ, F.lit("."))


def cited_papers(claims: DataFrame) -> DataFrame:
    """Claims (turn_id, ord, refs) to the turn's papers, each once, in order of first mention. A turn's claims are bounded."""
    first = claims.select("turn_id", "ord", F.posexplode("refs").alias("pos", "paper_id")).groupBy("turn_id", "paper_id").agg(F.min(F.struct("ord", "pos")).alias("at"))
    listed = first.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("at", "paper_id"))).alias("l"))
    return listed.select("turn_id", F.transform("l", lambda s: s["paper_id"]).alias("paper_ids"))


def activity_feed(trace: DataFrame, phrases: dict[str, str], default: str) -> DataFrame:
    """Feed lines of the readable records."""
    names = F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair])
    good = trace.where(F.col("seq").isNotNull() & F.col("tool").isNotNull() & F.col("args").isNotNull())
    return good.select("job_id", "seq", F.coalesce(F.try_element_at(names, F.col("tool")), F.lit(default)).alias("text"), F.substring("args", 1, 200).alias("query_summary"))


def purge_owner(tables: dict[str, DataFrame], owners: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the owners."""
    return {name: t.join(owners.select("owner_id").distinct(), "owner_id", "left_anti") for name, t in tables.items()}


def due_deletions(accounts: DataFrame, now: Column, attempts: int = 5) -> DataFrame:
    """Accounts due by ``now`` with their action: delete, or give up once the attempts are used."""
    due = accounts.where((F.col("state") == "pending_deletion") & (F.col("due_at") <= now))
    return due.withColumn("action", F.when(F.col("attempts") < attempts, "delete").otherwise("give_up"))


def excluded(states: DataFrame, marks: DataFrame) -> DataFrame:
    """D3: a mark (paper_id, version) excludes the open claim of the same version: no fingerprint yet, still INDEXED."""
    m = marks.select("paper_id", F.col("version").alias("current_version"), F.lit(True).alias("_m")).distinct()
    hit = F.col("_m").isNotNull() & F.col("fingerprint").isNull() & (F.col("state") == "INDEXED")
    return states.join(m, ["paper_id", "current_version"], "left").withColumn("state", F.when(hit, "EXCLUDED").otherwise(F.col("state"))).select(*states.columns)


def tombstone_claims(states: DataFrame, claims: DataFrame) -> DataFrame:
    """A claim wins when the stored version isn't newer; new papers are added. Of several claims the highest counts."""
    c = claims.groupBy("paper_id").agg(F.max("version").alias("_v"))
    win = F.col("_v").isNotNull() & (F.col("current_version").isNull() | (F.col("current_version") <= F.col("_v")))
    both = states.join(c, "paper_id", "full")
    return both.select(
        "paper_id", F.when(win, F.col("_v")).otherwise(F.col("current_version")).alias("current_version"),
        F.when(~win, F.col("fingerprint")).alias("fingerprint"), F.when(win, "TOMBSTONED").otherwise(F.col("state")).alias("state"),
    )


def source_can_replace(winner: Column, candidate: Column) -> Column:
    """The candidate's source ranks no lower than the winner's tier (smaller is better)."""
    return candidate <= winner


def html_quality(body_chars: Column, full_chars: Column, source_chars: Column) -> Column:
    """A body under 500 characters, then a text under half of its source, are refused."""
    return F.when(body_chars < 500, "body_too_short").when(full_chars < F.lit(0.5) * source_chars, "truncated").otherwise("ok")


def live_events(events: DataFrame, resets: DataFrame, cutoff: Column) -> DataFrame:
    """Events from the cutoff on and, for users who reset their profile, after that instant."""
    kept = events.where(F.col("occurred_at") >= cutoff).join(resets.groupBy("user_id").agg(F.max("reset_at").alias("_r")), "user_id", "left")
    return kept.where(F.col("_r").isNull() | (F.col("occurred_at") > F.col("_r"))).select(*events.columns)


def hallucination_incidents(decisions: DataFrame) -> DataFrame:
    """Block is critical, other refusals warn; one incident a signal and verdict."""
    bad = decisions.where("verdict <> 'pass'").groupBy("signal_id", "verdict").agg(F.min("request_id").alias("request_id"))
    return bad.withColumn("severity", F.when(F.col("verdict") == "block", "critical").otherwise("warning"))


def stale_turn(state: Column, created: Column, heartbeat: Column, now: Column, limit_seconds: int, unpicked: int = 3) -> Column:
    """A pending turn without a sign of life; one that no worker took waits ``unpicked`` times as long."""
    age = now.cast("long") - F.coalesce(heartbeat, created).cast("long")
    return (state == "pending") & (age >= F.when(heartbeat.isNull(), limit_seconds * unpicked).otherwise(limit_seconds))


def index_health(last_write: Column, count: Column, expected: Column, now: Column, max_age_seconds: int) -> Column:
    """T22."""
    stale = now.cast("long") - last_write.cast("long") > max_age_seconds
    return F.when(last_write.isNull(), "unhealthy").when(stale | (count != expected), "degraded").otherwise("healthy")


def overlap_match(specs: DataFrame, regions: DataFrame) -> DataFrame:
    """Of the regions on a spec's page that with the largest shared area (> 0); ties to the smaller region id.

    Both have page_key (paper and page), x0, y0, x1, y1. The join is on the page, so it pairs only a page's floats.
    """
    a, b = specs.alias("a"), regions.alias("b")
    w = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    h = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    both = a.join(b, "page_key").where((w > 0) & (h > 0)).select("a.spec_id", F.struct((w * h).alias("area"), (-F.col("b.region_id")).alias("r")).alias("s"))
    return both.groupBy("spec_id").agg(F.max("s").alias("s")).select("spec_id", (-F.col("s.r")).alias("region_id"), F.col("s.area").alias("area"))


def duplicate_regions(regions: DataFrame, least: float = 0.9) -> DataFrame:
    """Regions whose intersection over union with an earlier one of their page is at least ``least``."""
    a, b = regions.alias("a"), regions.alias("b")
    w, h = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0"), F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    hit = (F.col("b.region_id") < F.col("a.region_id")) & (inter >= F.lit(least) * (area("a") + area("b") - inter))
    return a.join(b, (F.col("a.page_key") == F.col("b.page_key")) & hit, "left_semi")


def union_box(regions: DataFrame) -> DataFrame:
    """Regions (float_id, ord, page, box) to the box of those on the first one's page; none without area."""
    first = F.min_by("page", "ord").over(Window.partitionBy("float_id"))
    same = regions.withColumn("_p", first).where(F.col("page") == F.col("_p"))
    box = same.groupBy("float_id", "page").agg(*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])
    return box.where("x1 > x0 AND y1 > y0")


def anchor_location(anchors: DataFrame, locations: DataFrame) -> DataFrame:
    """Anchors (paper_id, anchor_id, tokens), locations (paper_id, loc, key as token arrays): the location with the same tokens, else the longest key that is a run of them; ties to the earlier."""
    pad = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    exact = F.col("key") == F.col("tokens")
    both = anchors.join(locations, "paper_id").where((F.size("key") > 0) & F.contains(pad(F.col("tokens")), pad(F.col("key"))))
    best = both.groupBy("paper_id", "anchor_id").agg(F.max_by("loc", F.struct(exact, F.size("key"), -F.col("loc"))).alias("loc"))
    return anchors.select("paper_id", "anchor_id").join(best, ["paper_id", "anchor_id"], "left")
