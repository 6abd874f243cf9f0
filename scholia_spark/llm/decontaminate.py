"""Benchmark decontamination by template canonicalisation, in DataFrame and SQL functions only.

Numbers (with grouped digits and decimals), units behind numbers, and names (runs of capitalised words anywhere, but for
``FUNCTION_WORDS``) become typed placeholders that keep their value as a slot; the rest is lower-cased words. Windows of ``WINDOW`` canonical tokens
are hashed and joined with those of the benchmark. A document that covers at least ``COVERAGE`` of the windows of an item
along one offset, or along offsets at most ``DRIFT`` apart (words put in or left out), is a copy or a re-parameterised copy, unless a slot value of the item would stand for two values in the
matched windows, which tells a chance match of templates apart. Every such offset is checked; the best consistent one counts.

Windows with fewer than ``LITERALS`` literal tokens are too general and don't count. Items without a window that counts
(short ones, or hardly more than numbers and names) are found as they stand: all their words and values, one after the other.
The benchmark side is broadcast up to ``BROADCAST_WINDOWS`` windows (about 40 bytes each); beyond that its distinct hashes
are broadcast up to ``BROADCAST_HASHES`` to thin the documents' windows out before both sides are shuffled.

Defined cases: null and empty texts match nothing; items of fewer than ``LEAST`` words never match; rows are told apart by
doc_id and text, so repeated rows give one pair and a leak under a repeated doc_id doesn't take other texts of that id along;
a null doc_id is reported as null; ties between offsets go to the smallest; extra columns are ignored (and kept by
``clean``); an empty table or benchmark gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia_spark.llm import shared

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
BROADCAST_WINDOWS = 500_000
BROADCAST_HASHES = 2_000_000
#: Fewest words of an item that is matched as it stands.
LEAST = 4
KEY = ["_id", "_h"]
#: Unit words that may follow a number.
UNITS = "km|cm|mm|m|kg|mg|g|l|ml|s|ms|min|h|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|percent|dollars|dollar|euros|euro|cents|miles|mile|feet|inches|meters|metres|pounds|ounces|grams|liters|litres"
#: Words that start sentences and are no names.
FUNCTION_WORDS = "a|about|after|all|also|although|an|and|another|any|are|as|assume|at|be|because|before|both|but|by|calculate|can|compute|consider|could|did|do|does|during|each|either|every|few|find|for|from|given|had|has|have|he|her|here|his|how|however|i|if|in|into|is|it|its|let|many|may|more|most|much|must|my|neither|no|not|now|of|on|once|one|only|or|other|our|over|she|should|show|since|so|solve|some|such|suppose|that|the|their|then|there|these|they|this|those|though|through|thus|to|under|until|was|we|were|what|when|where|which|while|who|whom|whose|why|will|with|without|would|yes|yet|you|your"
_PLAIN = "|".join(w.capitalize() for w in FUNCTION_WORDS.split("|"))
DRIFT = 8
#: U+0002 joins the parts of a number or of a name.
NUMBER = rf"([0-9]+(?:\u0002[0-9]+)*)(?: ?({UNITS})\b)?"
GROUPING = r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))"
POINT = r"(?<=[0-9])\.(?=[0-9])"
#: The blank or hyphen between two capitalised words (and the apostrophe of O'Neill), and a run of them.
_START = r"(?<![\p{L}\p{M}\p{N}])"
JOIN = rf"[ '’-](?=\p{{Lu}}(?:['’]\p{{Lu}})?\p{{Ll}})(?!(?:{_PLAIN})(?![\p{{L}}\p{{M}}]))(?<={_START}\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}]{{0,30}}[ -]|{_START}\p{{Lu}}['’])(?<!{_START}(?:{_PLAIN})[ -])"
NAME = rf"(?=\p{{Lu}}(?:\u0002\p{{Lu}})?\p{{Ll}}){_START}(?!(?:{_PLAIN})(?![\p{{L}}\p{{M}}\u0002]))(\p{{Lu}}[\p{{L}}\p{{M}}\u0002]*)"
SPLIT = "[^\\p{L}\\p{M}\\p{N}\u0001\u0002]+"


#: An item is read with every name as a slot, with names behind lower case only, and without names (copies in other case).
READINGS = (NAME, rf"(?<=[\p{{Ll}},;] ){NAME}", None)


def raw_tokens(text: Column, name: str | None = NAME) -> Column:
    """Words in lower case; a slot is U+0001, its type (a name, n number, u unit) and its value."""
    t = F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002", "  ")
    if name:
        t = F.regexp_replace(F.regexp_replace(t, JOIN, "\u0002"), name, " \u0001a$1 ")
    t = F.regexp_replace(F.regexp_replace(t, GROUPING, ""), POINT, "\u0002")
    t = F.regexp_replace(t, NUMBER, " \u0001n$1 \u0001u$2 ")
    return F.array_remove(F.array_remove(F.split(F.lower(t), SPLIT), ""), "\u0001u")


def canonical(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.when(F.startswith(w, F.lit("\u0001")), F.substring(w, 1, 2)).otherwise(w))


def windows(tokens: Column, n_tokens: Column) -> Column:
    """Hash of each window of 8 tokens: pairs, pairs of pairs, pairs of those."""
    h = F.transform(tokens, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        h = F.zip_with(h, F.slice(h, step + 1, F.greatest(n_tokens, F.lit(1))), lambda x, y: F.xxhash64(x, y))
    return F.slice(h, 1, F.greatest(n_tokens - (WINDOW - 1), F.lit(0)))


def _tokenised(df: DataFrame) -> DataFrame:
    return df.select(*KEY, raw_tokens(F.col("text")).alias("raw")).withColumn("n", F.size("raw"))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, reading, raw, n: the distinct readings of each item."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).distinct()
    read = F.array(*[F.struct(F.lit(k).alias("reading"), raw_tokens(F.col("text"), name).alias("raw")) for k, name in enumerate(READINGS)])
    read = items.select("item_id", F.explode(read).alias("r")).groupBy("item_id", "r.raw").agg(F.min("r.reading").alias("reading"))
    return read.withColumn("n", F.size("raw"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """h, item_id, reading, ipos, n_windows (those that count) of the benchmark."""
    items = _items(benchmark)
    items = items.withColumn("canon", canonical(F.col("raw")))
    at = items.select("item_id", "reading", "canon", F.posexplode(windows(F.col("canon"), F.col("n"))).alias("ipos", "h"))
    literal = F.size(F.filter(F.slice("canon", F.col("ipos") + 1, F.lit(WINDOW)), lambda w: ~F.startswith(w, F.lit("\u0001"))))
    at = at.where(literal >= LITERALS).select("item_id", "reading", "ipos", "h").distinct()
    total = at.groupBy("item_id", "reading").agg(F.countDistinct("ipos").alias("n_windows"))
    return at.join(total, ["item_id", "reading"])


def exact_windows(tokens: Column, size: int) -> Column:
    """Hash of each run of ``size`` words and values."""
    h = F.transform(tokens, lambda w: F.xxhash64(w, F.lit(size)))
    out = h
    for k in range(1, size):
        out = F.zip_with(out, F.slice(h, k + 1, F.greatest(F.size(h), F.lit(1))), lambda x, y: F.xxhash64(x, y))
    return F.slice(out, 1, F.greatest(F.size(h) - (size - 1), F.lit(0)))


def exact_items(benchmark: DataFrame, items: DataFrame) -> DataFrame:
    """h, item_id, size, ipos, n_windows of the items that have no row in ``items``: runs of min(words, WINDOW) words."""
    bare = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    bare = bare.join(items.select("item_id").distinct(), "item_id", "left_anti").select("item_id", raw_tokens(F.col("text"), None).alias("raw"))
    bare = bare.withColumn("size", F.least(F.size("raw"), F.lit(WINDOW))).where(F.col("size") >= LEAST)
    at = F.lit(None).cast("array<bigint>")
    for size in range(LEAST, WINDOW + 1):
        at = F.when(F.col("size") == size, exact_windows(F.col("raw"), size)).otherwise(at)
    return bare.select("item_id", "size", F.size(at).alias("n_windows"), F.posexplode(at).alias("ipos", "h"))


def _exact_pairs(keyed: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """Documents that hold all windows of an item of ``exact_items`` at one offset."""
    raw = keyed.select(*KEY, "doc_id", raw_tokens(F.col("text"), None).alias("raw"))
    at = F.concat(*[F.transform(exact_windows(F.col("raw"), s), lambda h, i: F.struct(h.alias("h"), i.alias("pos"), F.lit(s).alias("size"))) for s in sizes])  # noqa: B023
    hits = raw.select(*KEY, "doc_id", F.inline(at)).join(items, ["h", "size"])
    hits = hits.groupBy(*KEY, "doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"))
    hits = hits.agg(F.countDistinct("ipos").alias("matched_windows"), F.max("n_windows").cast("int").alias("n_windows")).where("matched_windows = n_windows")
    none = F.lit(0).alias("n_slots")
    return hits.select(*KEY, "doc_id", "item_id", "matched_windows", "n_windows", none, F.lit(0).alias("new_slots")).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """_id, _h, doc_id, text: the key is the id (0 for null) and a hash of the text that tells null ids apart from 0."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("_id"), F.xxhash64(text, doc_id.isNull()).alias("_h"), doc_id.alias("doc_id"), text.alias("text"))


def alignments(hits: DataFrame, coverage: float) -> DataFrame:
    """key, item_id, reading, n_windows, windows (shift, ipos): every offset, or group of near offsets, with enough of the item's windows. hits: by shift, ``at`` is a set of ipos."""
    placed = lambda at, shift: F.transform(at, lambda i: F.struct(shift.alias("shift"), i.alias("ipos")))
    enough = lambda at: F.size(at) >= coverage * F.col("n_windows")
    straight = hits.where(enough("at")).select(*KEY, "item_id", "reading", "n_windows", placed(F.col("at"), F.col("shift")).alias("windows"))
    part = F.struct(F.size("at").alias("n"), (-F.col("shift")).alias("back"), "at")
    step = F.floor(F.col("shift") / DRIFT)  # offsets at most DRIFT apart share a group
    near = hits.select(*KEY, "item_id", "reading", "n_windows", F.explode(F.array(step - 1, step)).alias("group"), part.alias("part"))
    near = near.groupBy(*KEY, "item_id", "reading", "group").agg(F.max("n_windows").alias("n_windows"), F.collect_list("part").alias("parts"))
    near = near.where((F.size("parts") > 1) & enough(F.array_distinct(F.flatten("parts.at"))))
    # a window counts at the offset that holds the most of them
    fresh = lambda got, p: F.array_except(p["at"], F.transform(got, lambda g: g["ipos"]))
    start = F.expr("cast(array() as array<struct<shift: int, ipos: int>>)")
    windows = F.aggregate(F.sort_array("parts", asc=False), start, lambda got, p: F.concat(got, placed(fresh(got, p), -p["back"])))
    return straight.union(near.select(*KEY, "item_id", "reading", "n_windows", windows.alias("windows")))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """key, doc_id, item_id, matched_windows, n_windows, n_slots, new_slots of each pair of document and item that it leaks."""
    items = shared.keep(item_windows(benchmark), "decontaminate-items")
    n_windows = items.count()
    side = F.broadcast(items) if n_windows <= BROADCAST_WINDOWS else items
    keyed = _keyed(docs)
    tokens = _tokenised(keyed).withColumn("canon", canonical(F.col("raw")))
    at = tokens.select(*KEY, F.posexplode(windows(F.col("canon"), F.col("n"))).alias("pos", "h"))
    if BROADCAST_WINDOWS < n_windows:
        hashes = shared.keep(items.select("h").distinct(), "decontaminate-hashes")
        at = at.join(F.broadcast(hashes), "h", "left_semi") if hashes.count() <= BROADCAST_HASHES else at
    hits = at.join(side, "h").groupBy(*KEY, "item_id", "reading", (F.col("pos") - F.col("ipos")).alias("shift"))
    hits = hits.agg(F.collect_set("ipos").alias("at"), F.max("n_windows").alias("n_windows"))
    hits = shared.keep(alignments(hits, coverage), "decontaminate-hits")

    ids = shared.keep(hits.select(*KEY).distinct(), "decontaminate-keys")
    texts = shared.keep_only(keyed, ids, KEY, ids.count())
    raw_items = _items(benchmark).select("item_id", "reading", F.col("raw").alias("item_raw"))
    both = texts.select(*KEY, "doc_id", raw_tokens(F.col("text")).alias("raw")).join(hits, KEY).join(raw_items, ["item_id", "reading"])
    inside = lambda m: F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.struct(m["shift"].alias("shift"), (m["ipos"] + k).alias("ipos")))
    facing = F.array_distinct(F.flatten(F.transform("windows", inside)))
    facing = F.transform(facing, lambda p: F.struct(F.get("item_raw", p["ipos"]).alias("i"), F.get("raw", p["ipos"] + p["shift"]).alias("d")))
    slot = lambda w: F.coalesce(F.startswith(w, F.lit("\u0001")), F.lit(False))
    both = both.withColumn("slots", F.array_distinct(F.filter(facing, lambda p: slot(p["i"]) & slot(p["d"]))))
    consistent = F.size(F.array_distinct(F.transform("slots", lambda p: p["i"]))) == F.size("slots")
    both = both.where(consistent).withColumn("changed", F.size(F.filter("slots", lambda p: p["i"] != p["d"])))
    best = F.max(F.struct(F.size("windows").cast("long").alias("matched_windows"), (-F.array_min("windows.shift")).alias("back"), "n_windows", F.size("slots").alias("n_slots"), F.col("changed").alias("new_slots")))
    best = both.groupBy(*KEY, "doc_id", "item_id").agg(best.alias("best"))
    best = best.select(*KEY, "doc_id", "item_id", *[f"best.{c}" for c in ("matched_windows", "n_windows", "n_slots", "new_slots")])
    exact = shared.keep(exact_items(benchmark, items), "decontaminate-exact")
    sizes = sorted(r["size"] for r in exact.select("size").distinct().collect())  # at most WINDOW - LEAST + 1
    if sizes:
        best = best.unionByName(_exact_pairs(keyed, F.broadcast(exact) if exact.count() <= BROADCAST_WINDOWS else exact, sizes))
    found = shared.keep(best, "decontaminate-pairs")
    for used in (items, hits, ids, exact):
        shared.forget(used)
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, matched_windows, n_windows, n_slots, new_slots."""
    return contaminated_pairs(docs, benchmark, coverage).drop(*KEY)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that leak an item."""
    names = [shared.fresh(docs, k) for k in KEY]
    bad = contaminated_pairs(docs, benchmark, coverage).select(*[F.col(k).alias(n) for k, n in zip(KEY, names, strict=True)]).distinct()
    bad = shared.keep(bad, "decontaminate-bad")
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    keyed = docs.withColumn(names[0], F.coalesce(doc_id, F.lit(0))).withColumn(names[1], F.xxhash64(text, doc_id.isNull()))
    return shared.keep_only(keyed, bad, names, bad.count(), "left_anti").select(*docs.columns)
