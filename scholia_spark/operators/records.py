"""Record-level operators: retraction-safe cards, trace and artifact bookkeeping, detectors, glossary, table repair checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia_spark.operators.ordering import places
from scholia_spark.operators.retrieval import rank_by


def web_url(url: Column) -> Column:
    """The address if it is http(s), else empty."""
    return F.when(F.regexp_like(F.coalesce(url, F.lit("")), F.lit("(?i)^https?://")), url).otherwise("")


def source_url(source: Column, arxiv_url: Column, own_url: Column, doi: Column) -> Column:
    """F9."""
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.when(source == "ARXIV", arxiv_url).otherwise(F.coalesce(empty(own_url), F.concat(F.lit("https://doi.org/"), empty(doi)), arxiv_url))


def metadata_problem(title: Column, authors: Column, abstract: Column, categories: Column) -> Column:
    """the first required field that is missing, else null."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    none = lambda c: c.isNull() | (F.size(c) == 0)
    return F.when(blank(title), "title").when(none(authors), "authors").when(blank(abstract), "abstract").when(none(categories), "categories")


def metadata_violations(tags: Column, allowed: list[str], most: int = 240) -> Column:
    """F16: keys that are not allowed or whose value is too long, sorted."""
    bad = F.filter(F.map_entries(tags), lambda e: ~e["key"].isin(*allowed) | (F.length(e["value"]) > most))
    return F.array_sort(F.transform(bad, lambda e: e["key"]))


def partial_reason(status: Column, failure: Column, result_count: Column, items: Column, mode: Column, degraded: Column) -> Column:
    """Ordered rules over a response."""
    quiet = status.isin("abstain", "fail_closed", "failed", "error") | ((status == "degraded") & degraded)
    ok = status == "success"
    return (
        F.when(quiet, F.lit(None)).when(ok & failure, "retrieval failure was reported as success").when(ok & (result_count == 0), "empty result was reported as success")
        .when(result_count.isNotNull() & (items != result_count), "result count does not match returned cards").when(ok & mode.isNotNull() & ~degraded, "degraded execution was reported as success")
    )


def ordinals(assets: DataFrame) -> DataFrame:
    """Ordinals per paper and type in document order."""
    return places(assets, ["paper_id", "type"], [F.col("ord"), F.col("asset_id")], "ordinal")


def next_sequence(trace: DataFrame) -> DataFrame:
    """W9."""
    return trace.groupBy("job_id").agg((F.max("seq") + 1).alias("next_seq"))


def evicted_topics(turns: DataFrame, keep: int, most: int = 120) -> DataFrame:
    """Topics of turns beyond the newest ``keep``, oldest first, cut and joined."""
    older = rank_by(turns, ["session_id"], [F.desc("turn_id")], "_n").where((F.col("_n") > keep) & (F.trim("topic") != ""))
    cut = older.select("session_id", "turn_id", F.substring(F.trim("topic"), 1, most).alias("t"))
    listed = cut.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "t"))).alias("l"))
    return listed.select("session_id", F.array_join(F.transform("l", lambda s: s["t"]), " / ").alias("summary"))


def cell_numbers(text: Column) -> Column:
    """Numbers of a cell after folding of minus signs and healing of split decimals."""
    healed = F.regexp_replace(F.translate(text, "−–", "--"), r"(\d)\s*\.\s+(\d)", "$1.$2")
    return F.regexp_extract_all(healed, F.lit(r"-?\d+(?:\.\d+)?"), 0)


def needs_repair(cells: Column) -> Column:
    """No cell with text, or a cell with three numbers or more."""
    return ~F.exists(cells, lambda c: F.trim(c) != "") | F.exists(cells, lambda c: F.size(cell_numbers(c)) >= 3)


def term_in_text(term: str, text: Column) -> Column:
    """The term between characters that are neither letters nor digits, in any case."""
    import re

    return F.regexp_like(text, F.lit(f"(?i)(?<![A-Za-z0-9]){re.escape(term)}(?![A-Za-z0-9])"))


def substitute(text: Column, terms: dict[str, str]) -> Column:
    """Glossary terms, longest first."""
    import re

    for term in sorted(terms, key=lambda t: (-len(t), t)):
        text = F.regexp_replace(text, rf"(?<![A-Za-z0-9]){re.escape(term)}(?![A-Za-z0-9])", terms[term].replace("\\", r"\\").replace("$", r"\$"))
    return text


def score_shift(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per field the losses, gains and totals of rows that both sides hold."""
    both = before.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]).join(after.select(key, *fields), key)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").cast("long").alias("b"), F.col(f).cast("long").alias("a")) for f in fields])).alias("p")
    df = both.select(pairs).select("p.*")
    return df.groupBy("field").agg(F.count_if(F.col("a") < F.col("b")).alias("losses"), F.count_if(F.col("a") > F.col("b")).alias("gains"), F.sum("b").alias("before"), F.sum("a").alias("after"))


def running_budget(calls: DataFrame, iterations: int, cost_cap: float) -> DataFrame:
    """An iteration may begin while fewer have begun and the costs before it stay below the cap."""
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    spent, done = F.coalesce(F.sum("cost").over(w), F.lit(0.0)), F.count("*").over(w)
    return calls.select("job_id", "seq", ((done < iterations) & (spent < cost_cap)).alias("allowed"))
