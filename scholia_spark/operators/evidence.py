"""The evidence gate: every reference of a proposed claim is checked against the papers at hand, then the claim itself.

Everything is joins and column expressions over all claims at once. References meet papers by id (first as written, then by
a key without prefix and version), and blocks by paper and anchor; a claim's numbers meet those of its valid quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia_spark.functions import text as T

#: Rejection codes, in the order in which a reference and then a claim is checked.
REF_CODES = (
    "malformed_ref", "unknown_paper", "figure_anchor_required", "anchor_missing", "anchor_not_found", "anchor_type_mismatch",
    "anchor_on_abstract", "missing_quote", "quote_too_short", "quote_not_verbatim", "quote_outside_anchor",
)
CLAIM_CODES = ("empty_statement", "no_supporting", "number_not_grounded")
MIN_QUOTE_CHARS = 20
#: White space of any script.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def squeeze(text: Column) -> Column:
    """White space as single blanks, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "))


def id_key(paper_id: Column) -> Column:
    """Lower case, without the arXiv prefix and the version at the end."""
    value = F.regexp_replace(F.lower(F.trim(paper_id)), "^arxiv:", "")
    return F.regexp_replace(value, r"^(.+)v\d+$", "$1")


def numbers_in(text: Column) -> Column:
    return F.array_distinct(T.evidence_numbers(text))


def _forms(value: Column) -> Column:
    """The value and its hundredth (of values over 1) or hundredfold, at six significant digits."""
    digits = lambda x: F.format_string("%.5e", x)
    return F.array(digits(value), digits(F.when(value > 1, value / 100).otherwise(value * 100)))


def grounded(tokens: Column, pool: Column) -> Column:
    """Whether each number of ``tokens`` is one of ``pool`` in another notation, or within half a unit of its last decimal."""
    values = F.transform(pool, T.number_value)
    forms = F.flatten(F.transform(values, _forms))

    def one(token: Column) -> Column:
        v = T.number_value(token)
        band = 0.5 * F.pow(F.lit(10.0), -F.length(F.regexp_extract(token, r"\.(\d+)", 1)).cast("double")) + F.lit(1e-9)
        return F.arrays_overlap(_forms(v), forms) | F.exists(values, lambda x: F.abs(x - v) <= band)

    return F.forall(tokens, one)


def _resolved(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """refs with ``paper``: the source's id as written, else the first source of the same key."""
    ids = sources.select("paper_id")
    exact = ids.select(F.col("paper_id").alias("paper"))
    alike = ids.groupBy(id_key(F.col("paper_id")).alias("key")).agg(F.min("paper_id").alias("like"))
    refs = refs.withColumn("wanted", F.trim(F.coalesce("paper_id", F.lit("")))).withColumn("key", id_key(F.col("wanted")))
    refs = refs.join(exact, F.col("wanted") == F.col("paper"), "left").join(alike, "key", "left")
    return refs.withColumn("paper", F.when(F.col("wanted") != "", F.coalesce("paper", "like"))).drop("key", "like", "wanted")


def judge_refs(refs: DataFrame, sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """item_id, side, ref_no, paper, scope, quote, reason (the first check that fails, null if none), numbers.

    refs: item_id, side, ref_no, paper_id, quote, anchor, scope, malformed; sources: paper_id, scope, text (squeezed);
    blocks: paper_id, anchor, anchor_type, block_text. ``numbers`` is what a claim may build on: those of the quote, and for a
    reading of a figure those of the whole paper.
    """
    texts = sources.select(F.col("paper_id").alias("paper"), F.col("scope").alias("has"), "text")
    places = blocks.select(F.col("paper_id").alias("paper"), F.col("anchor").alias("at"), "anchor_type", squeeze(F.col("block_text")).alias("block"))
    df = _resolved(refs, sources).join(texts, "paper", "left")
    anchor = F.trim(F.coalesce("anchor", F.lit("")))
    declared = F.trim(F.coalesce("scope", F.lit("")))
    scope = F.when(declared == "figure", "figure").when(F.col("has") == "abstract", "abstract").when(declared.isin("fulltext", "abstract"), declared).otherwise("fulltext")
    df = df.withColumns({"anchor": anchor, "scope": scope, "quote": squeeze(F.col("quote"))})
    df = df.join(places.withColumnRenamed("at", "anchor"), ["paper", "anchor"], "left")
    figure, abstract, quote = F.col("scope") == "figure", F.col("scope") == "abstract", F.col("quote")
    reason = (
        F.when(F.coalesce("malformed", F.lit(False)), "malformed_ref")
        .when(F.col("paper").isNull(), "unknown_paper")
        .when(figure & (F.col("anchor") == ""), "figure_anchor_required")
        .when(~abstract & (F.col("anchor") == ""), "anchor_missing")
        .when(~abstract & F.col("anchor_type").isNull(), "anchor_not_found")
        .when(figure & (F.col("anchor_type") != "figure"), "anchor_type_mismatch")
        .when(abstract & (F.col("anchor") != ""), "anchor_on_abstract")
        .when(~figure & (quote == ""), "missing_quote")
        .when(~figure & (F.length(quote) < MIN_QUOTE_CHARS), "quote_too_short")
        .when(~figure & ~F.contains("text", "quote"), "quote_not_verbatim")
        .when((F.col("scope") == "fulltext") & ~F.contains("block", "quote"), "quote_outside_anchor")
    )
    df = df.withColumn("reason", reason)
    numbers = F.when(F.col("reason").isNull(), F.when(figure, F.array_union(numbers_in(quote), numbers_in(F.col("text")))).otherwise(numbers_in(quote)))
    return df.select("item_id", "side", "ref_no", "paper", "scope", "quote", "reason", numbers.alias("numbers"))


def evidence_gate(items: DataFrame, judged: DataFrame) -> DataFrame:
    """item_id, supporting, conflicting (valid references), rejected (codes of the others, sorted), reason (of the claim, null if kept), kept.

    items: item_id, statement. A claim stays with one valid supporting reference and all of its numbers grounded in such ones.
    """
    good, support = F.col("reason").isNull(), F.col("side") == "supporting"
    per = judged.groupBy("item_id").agg(
        F.count_if(good & support).alias("supporting"), F.count_if(good & ~support).alias("conflicting"),
        F.array_sort(F.collect_list("reason")).alias("rejected"), F.array_distinct(F.flatten(F.collect_list(F.when(good & support, F.col("numbers"))))).alias("pool"),
    )
    df = items.select("item_id", squeeze(F.col("statement")).alias("statement")).join(per, "item_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    empty = F.col("statement") == ""
    reason = F.when(empty, "empty_statement").when(zero(F.col("supporting")) == 0, "no_supporting").when(~grounded(numbers_in(F.col("statement")), F.col("pool")), "number_not_grounded")
    # references of an empty claim aren't looked at
    seen = lambda c, none: F.when(empty, none).otherwise(F.coalesce(c, none))
    df = df.withColumn("reason", reason)
    return df.select(
        "item_id", seen(F.col("supporting"), F.lit(0)).alias("supporting"), seen(F.col("conflicting"), F.lit(0)).alias("conflicting"),
        seen(F.col("rejected"), F.expr("cast(array() as array<string>)")).alias("rejected"), "reason", F.col("reason").isNull().alias("kept"),
    )


def rejection_counts(gated: DataFrame) -> DataFrame:
    """Code and how often it occurred, over references and claims."""
    codes = gated.select(F.explode(F.concat("rejected", F.when(F.col("reason").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array("reason")))).alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("n"))
