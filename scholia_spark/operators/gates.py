"""Grounding and answer checks, evaluation sweeps, lookups by several keys, selections, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia_spark.functions import text as T
from scholia_spark.operators.ordering import places
from scholia_spark.operators.retrieval import rank_by


def summary_grounding(drafts: DataFrame, limit: float = 0.4) -> DataFrame:
    """Q13: share of a draft's numbers that its source doesn't ground, and the verdict. drafts: id, draft, source."""
    values = F.transform(T.summary_numbers(F.col("source")), T.number_value)
    df = drafts.select("id", "draft", T.summary_numbers(F.col("draft")).alias("found"), values.alias("values"))
    bad = F.size(F.filter("found", lambda n: ~T.number_grounded(n, F.col("values"))))
    df = df.withColumn("numbers", F.size("found")).withColumn("ungrounded", bad)
    share = F.when(F.col("numbers") > 0, F.col("ungrounded") / F.col("numbers")).otherwise(F.lit(0.0))
    verdict = F.when(F.trim("draft") == "", "empty").when(share > limit, "numeric_mismatch").otherwise("pass")
    return df.select("id", "numbers", "ungrounded", F.round(share, 6).alias("share"), verdict.alias("verdict"))


def draft_anchors(anchors: DataFrame, locations: DataFrame) -> DataFrame:
    """Q13: anchors (id, pos, field, label, target) resolved to locations (id, ord, label): one whose tokens are those of the
    anchor's label or target, else the longest that is a run of either's tokens; ties to the earlier location.

    Adds ``found``: the location's label, null for an anchor that points at nothing. Where an id has no locations, anchors keep
    their own label.
    """
    tokens = lambda c: T.label_tokens(F.coalesce(F.col(c), F.lit("")))
    held = locations.select("id", "ord", F.col("label").alias("name"), tokens("label").alias("key")).where(F.size("key") > 0)
    a = anchors.withColumn("_label", tokens("label")).withColumn("_hint", tokens("target"))
    key, hay = F.col("key"), (F.col("_label"), F.col("_hint"))
    exact = (key == hay[0]) | (key == hay[1])
    both = a.select("id", "pos", "_label", "_hint").join(held, "id").where(T.contiguous(key, hay[0]) | T.contiguous(key, hay[1]))
    best = both.groupBy("id", "pos").agg(F.max_by("name", F.struct(exact, F.when(exact, 0).otherwise(F.size("key")), -F.col("ord"))).alias("name"))
    df = a.drop("_label", "_hint").join(best, ["id", "pos"], "left").join(held.select("id").distinct().withColumn("_has", F.lit(True)), "id", "left")
    return df.withColumn("found", F.when(F.col("_has"), F.col("name")).otherwise(F.coalesce("label", F.lit("")))).drop("name", "_has")


def summary_verdict(drafts: DataFrame, anchors: DataFrame, locations: DataFrame, limit: float = 0.4) -> DataFrame:
    """Q13 whole: outcome, violations in order (hard ones, then anchor_missing an anchor), and the kept anchors once a field and label.

    drafts: id, tldr, method, results, truncated, reproducibility (map), body, captions (array). A hard violation abstains:
    empty, truncated, schema_incomplete, numeric_mismatch. Numbers are those of the results, held against body and captions.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    source = F.concat_ws("\n", "body", F.array_join(F.coalesce("captions", F.array().cast("array<string>")), "\n"))
    numbers = drafts.select("id", F.coalesce("results", F.lit("")).alias("draft"), source.alias("source"))
    share = summary_grounding(numbers, limit).select("id", F.when(F.col("numbers") > 0, F.col("ungrounded") / F.col("numbers")).otherwise(0.0).alias("share"))
    told = lambda k: F.coalesce(F.map_contains_key("reproducibility", F.lit(k)), F.lit(False))
    resolved = draft_anchors(anchors, locations)
    missing = resolved.where("found IS NULL").groupBy("id").agg(F.count("*").cast("int").alias("missing"))
    once = resolved.where("found IS NOT NULL").groupBy("id", "field", "found").agg(F.min("pos").alias("pos"))
    kept = once.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "field", "found"))), lambda a: F.concat_ws(":", a["field"], a["found"])).alias("kept"))
    df = drafts.join(share, "id").join(missing, "id", "left").join(kept, "id", "left")
    hard = F.array_compact(F.array(
        F.when(blank("tldr") | blank("method"), "empty"), F.when(F.col("truncated"), "truncated"), F.when(~(told("code") & told("data")), "schema_incomplete"), F.when(F.col("share") > limit, "numeric_mismatch"),
    ))
    soft = F.array_repeat(F.lit("anchor_missing"), F.coalesce("missing", F.lit(0)))
    return df.select("id", F.when(F.size(hard) > 0, "abstain").otherwise("pass").alias("outcome"), F.concat(hard, soft).alias("violations"), F.coalesce("kept", F.array().cast("array<string>")).alias("kept"))


def threshold_sweep(cases: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion counts for each threshold (a short fixed list). cases: expected ('pass' or 'block'), share."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    df = cases.select("expected", "share", each).withColumn("got", F.when(F.col("share") > F.col("threshold"), "block").otherwise("pass"))
    return df.groupBy("threshold").agg(
        F.count_if((F.col("expected") == "pass") & (F.col("got") == "pass")).alias("true_pass"), F.count_if((F.col("expected") == "block") & (F.col("got") == "pass")).alias("false_pass"),
        F.count_if((F.col("expected") == "block") & (F.col("got") == "block")).alias("true_block"), F.count_if((F.col("expected") == "pass") & (F.col("got") == "block")).alias("false_block"),
    )


def answer_checks(sentences: DataFrame) -> DataFrame:
    """Q16 per answer: unknown papers reject; bad references and ungrounded numbers demote a sentence to synthesis; an answer
    without cited sentences, or with more than half synthesis, is rejected.

    sentences: answer_id, refs_ok, papers_known, numbers_ok, cited.
    """
    cited = F.col("cited") & F.col("refs_ok") & F.col("numbers_ok")
    df = sentences.groupBy("answer_id").agg(
        F.count("*").alias("n"), F.count_if(cited).alias("kept"), F.count_if(F.col("cited") & ~cited).alias("demoted"), F.count_if(~F.col("papers_known")).alias("unknown")
    )
    code = F.when(F.col("unknown") > 0, "A3").when(F.col("kept") == 0, "A4").when((F.col("n") - F.col("kept")) / F.col("n") > 0.5, "A5").otherwise("ok")
    return df.select("answer_id", "n", "kept", "demoted", code.alias("code"))


def scope_clamp(claimed: Column, obtained: Column) -> Column:
    """Q15: a reference can't claim more than was read of its source."""
    rank = lambda c: F.when(c == "full_text", 2).when(c == "abstract", 1).otherwise(0)
    return F.when(rank(claimed) > rank(obtained), obtained).otherwise(claimed)


def lookup_by_keys(requests: DataFrame, keys: list[Column], stored: DataFrame, key: str, best: Column) -> DataFrame:
    """A row with several keys meets the stored rows by equality on any; the best one stays. requests: request_id.

    The best row of a key is the same for all that ask by it, so stored rows are reduced to one a key before they meet."""
    each = requests.select("request_id", F.explode(F.array_compact(F.array(*keys))).alias(key))
    first = stored.withColumn("_best", best).groupBy(key).agg(F.min(F.struct("_best", "state_id")).alias("_first")).select(key, "_first.*")
    hits = each.join(first, key)
    return hits.groupBy("request_id").agg(F.min_by("state_id", F.struct("_best", "state_id")).alias("state_id"))


def mark_retracted(items: DataFrame, papers: DataFrame) -> DataFrame:
    """items of a paper, whatever version they name, are marked."""
    base = lambda c: F.regexp_replace(c, r"v\d+$", "")
    hit = papers.select(base(F.col("paper_id")).alias("_base")).distinct().withColumn("_hit", F.lit(True))
    return items.withColumn("_base", base(F.col("paper_id"))).join(hit, "_base", "left").withColumn("retracted", F.coalesce("_hit", F.lit(False))).drop("_base", "_hit")


def redact(value: Column) -> Column:
    """e-mail addresses."""
    return F.regexp_replace(value, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]")


def redact_keys(tags: Column, sensitive: str = "(?i)token|secret|password|authorization|api_?key") -> Column:
    """values of sensitive keys."""
    return F.transform_values(tags, lambda k, v: F.when(F.regexp_like(k, F.lit(sensitive)), F.lit("[REDACTED]")).otherwise(redact(v)))


def interleave(lists: DataFrame) -> DataFrame:
    """Round robin over source lists; ``out`` is the place in the merged list. lists: query_id, source, pos, id."""
    return places(lists, ["query_id"], [F.col("pos"), F.col("source")], "out")


def conflict_first(claims: DataFrame) -> DataFrame:
    """Claims with conflicting references first, each part in its order."""
    return rank_by(claims, ["answer_id"], [(F.col("conflicts") == 0).cast("int"), F.col("ord")], "place")


def foundational_score(citations: Column, surveys: Column) -> Column:
    """S9."""
    return F.log10(citations + 10) + surveys * 1.5


def capped_selection(candidates: DataFrame, target: int, share: float = 0.15) -> DataFrame:
    """Best first with at most a share of the target a category; deferred rows fill what is left. candidates: id, category, score."""
    cap = max(1, int(target * share))
    order = [F.desc("score"), F.col("id")]
    ranked = rank_by(candidates, ["category"], order, "_c").withColumn("tier", F.when(F.col("_c") <= cap, 0).otherwise(1)).drop("_c")
    chosen = ranked.orderBy("tier", *order).limit(target)  # top-k: each task keeps ``target`` rows
    return chosen.select("id", "category", "score", "tier")


def conflict_map(refs: DataFrame) -> DataFrame:
    """G1: claim n conflicts with the other claims whose supporting papers it names as conflicting. refs: answer_id, n, side, paper_id.

    Claims of an answer that name the same papers have the same list, so a list is gathered once a set of papers and only then
    given to its claims: no pair of claims is made or shuffled. What is left to grow with the square is the lists themselves.
    """
    refs = refs.where("answer_id IS NOT NULL AND n IS NOT NULL AND paper_id IS NOT NULL")
    named = F.array_sort(F.collect_set("paper_id")).alias("papers")
    con = refs.where("side = 'conflict'").groupBy("answer_id", "n").agg(named)
    pro = refs.where("side = 'support'").select("answer_id", F.col("n").alias("m"), "paper_id")
    sets = con.select("answer_id", "papers").distinct().withColumn("paper_id", F.explode("papers"))
    lists = sets.join(pro, ["answer_id", "paper_id"]).groupBy("answer_id", "papers").agg(F.array_sort(F.collect_set("m")).alias("all"))
    # few bytes go in and long lists come out, so the number of tasks stays as set and neither side is sent to all
    dealt = con.repartition(int(con.sparkSession.conf.get("spark.sql.shuffle.partitions")), "answer_id", "papers")
    hits = dealt.join(lists.hint("merge"), ["answer_id", "papers"]).where((F.size("all") > 1) | (F.get("all", F.lit(0)) != F.col("n")))
    return hits.select("answer_id", "n", F.array_remove("all", F.col("n")).alias("conflicts_with"))


def stale_chunks(indexed: DataFrame, expected: DataFrame) -> DataFrame:
    """Papers whose indexed and expected chunk counts differ, or that are missing on the index's side."""
    a = indexed.groupBy("paper_id").agg(F.count("*").alias("indexed"))
    b = expected.groupBy("paper_id").agg(F.count("*").alias("expected"))
    df = b.join(a, "paper_id", "left").withColumn("missing", F.col("indexed").isNull())
    return df.where(F.col("missing") | (F.col("indexed") != F.col("expected")))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One representative row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def eval_roll_up(cases: DataFrame) -> DataFrame:
    """Passed, fabrications and abstentions of an evaluation set. cases: expected, got ('pass', 'block' or 'abstain')."""
    right = F.col("expected") == F.col("got")
    fabricated = (F.col("expected") != "pass") & (F.col("got") == "pass")
    return cases.agg(F.count("*").alias("cases"), F.count_if(right).alias("passed"), F.count_if(fabricated).alias("fabrications"), F.count_if(F.col("got") == "abstain").alias("abstained"))


def survey_votes(citations: DataFrame) -> DataFrame:
    """Number of distinct surveys that cite each paper. citations: survey_id, paper_id."""
    return citations.where("paper_id IS NOT NULL AND survey_id IS NOT NULL").distinct().groupBy("paper_id").agg(F.count("*").alias("votes"))


def record_refs(payloads: DataFrame) -> DataFrame:
    """Id, record_ref: every non-empty string under a ``recordRef`` key at any depth of a JSON payload, once a payload."""
    value = F.try_parse_json("payload")
    quoted = F.regexp_extract_all(F.to_json(value), F.lit(r'"recordRef":("(?:[^"\\]|\\.)+")'), 1)  # that form has no blanks, and quotes inside strings are escaped
    found = payloads.where(value.isNotNull()).select("id", F.explode(F.array_distinct(quoted)).alias("q"))
    return found.select("id", F.from_json(F.concat(F.lit('{"v":'), F.col("q"), F.lit("}")), "v string")["v"].alias("record_ref")).distinct()
