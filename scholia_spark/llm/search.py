"""Ranked lexical search of a stated query set against all documents, by bag deduplication.

Documents are restricted to the items' vocabulary: a document is its number of terms and its bag, the sorted (term, count)
pairs of vocabulary terms. Documents of one length norm m and one bag score alike against every item, so they are one
class: rows meet by a 64-bit hash of both and are verified by m and bag themselves, as these are keys of the grouping too.
Each class is scored once; a class is one number of documents and its smallest doc_id, so the best k classes of an item,
ordered by score and smallest doc_id, hold its best k documents. Only classes with fewer than k documents above them are
expanded, each to its k smallest doc_ids, and then cut to k.

Passes: one over texts (terms counted, bags written to the shared folder), one over bags (N, L and df), one grouping by class,
one over classes. Rows leave a scoring task as k an item at most, whatever its share of classes. Nothing is approximate:
scores are 64-bit integers.

Bounds: items are taken in blocks of ``MOST_ITEMS`` items and ``MOST_BYTES`` of text; a block's vocabulary and postings are
broadcast, and a larger item set costs a pass for each block.

Defined cases: null texts and texts without a term count for no statistic and are never found; rows without a doc_id count
for the statistics and are never found; repeated rows are documents of their own; an item without terms, or whose terms no
document holds, gives no row; rows of one item_id are one item with all their terms, and rows without an item_id are no
items; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia_spark.llm import shared

TOP_K = 50
MOST_ITEMS, MOST_BYTES = 5_000, 8 << 20
#: Bytes of a text that are split into terms at once, and score cells held at once.
PIECE, CELLS = 1 << 20, 4 << 20
#: A term: ASCII letters and digits, and everything beyond ASCII. On UTF-8 bytes this equals the pattern on characters.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9a-zA-Z\x80-\xff]")
_PAIR = np.dtype([("term", "<u4"), ("tf", "<u4")])


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """Lists of the terms of a whole text, in order; pieces end between terms, so no more than one piece is split at a time."""
    data = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while at < len(data):
        found = _BREAK.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = found.start() if found else len(data)
        yield _TERM.findall(data[at:end].lower())  # bytes.lower() changes A-Z only
        at = end


@dataclass
class Block:
    """Items of one pass: the vocabulary, and for term t the items ``items[starts[t]:starts[t + 1]]`` that hold it."""

    ids: list[int]
    vocabulary: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Block:
        terms = sorted({t for r in rows for t in r["terms"]})
        number = {t: i for i, t in enumerate(terms)}
        pairs = sorted({(number[t], i) for i, r in enumerate(rows) for t in r["terms"]})
        counts = np.bincount(np.array([t for t, _ in pairs], np.int64), minlength=len(terms)) if pairs else np.zeros(0, np.int64)
        return cls([r["item_id"] for r in rows], {bytes(t): i for t, i in number.items()}, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), np.array([i for _, i in pairs], np.int64))


def _item_terms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        terms = [sorted({t for part in terms_of(x) for t in part}) for x in pdf["text"]]
        yield pd.DataFrame({"item_id": pdf["item_id"], "terms": pd.Series(terms, dtype=object)})


def item_blocks(items: DataFrame, most_items: int = MOST_ITEMS, most_bytes: int = MOST_BYTES) -> Iterator[Block]:
    """The items in blocks that a worker may hold; what is collected at once is one block."""
    shared.bound_batches(items.sparkSession)
    items = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = 1
    while True:
        dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
        sizes = dealt.groupBy("part").agg(F.countDistinct("item_id").alias("items"), F.sum(F.octet_length("text")).alias("bytes"))
        if sizes.where(F.col("items") > 1).where((F.col("items") > most_items) | (F.col("bytes") > most_bytes)).isEmpty():
            break
        parts *= 2
    for part in range(parts):
        found = dealt.where(F.col("part") == part).select("item_id", "text").mapInPandas(_item_terms, "item_id long, terms array<binary>")
        rows = found.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).orderBy("item_id").collect()
        if rows:
            yield Block.of(rows)


def bags(docs: DataFrame, block: Block) -> DataFrame:
    """doc_id, n (terms with repeats), bag (sorted pairs of term and count, of vocabulary terms) of every document."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    held = spark.sparkContext.broadcast(block.vocabulary)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = held.value.get
        for pdf in it:
            sizes, found = [], []
            for text in pdf["text"]:
                counts: Counter = Counter()
                n = 0
                for part in terms_of(text):
                    n += len(part)
                    counts.update(map(get, part))
                counts.pop(None, None)
                sizes.append(n)
                found.append(np.array(sorted(counts.items()), np.uint32).tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": sizes, "bag": pd.Series(found, dtype=object)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, n long, bag binary")


def _pairs(found: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of some bags, and which bag each is of."""
    sizes = np.array([len(b) for b in found], np.int64) // _PAIR.itemsize
    return np.frombuffer(b"".join(found), _PAIR), np.repeat(np.arange(sizes.size), sizes)


@dataclass
class Statistics:
    """N documents with a term, L terms in all, and by vocabulary term the documents that hold it."""

    docs: int
    length: int
    df: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.docs + 2) / (2 * d + 1))) for d in self.df.tolist()], np.int64)

    def norm(self, n: Column) -> Column:
        """m of a document with n terms."""
        return F.lit(50) + F.call_function("div", F.lit(50 * self.docs).cast("long") * n, F.lit(max(self.length, 1)).cast("long"))


def statistics(kept: DataFrame, terms: int) -> Statistics:
    """One pass over bags; what comes back is a number a vocabulary term."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, docs, length = np.zeros(terms, np.int64), 0, 0
        for pdf in it:
            docs += int((pdf["n"] > 0).sum())
            length += int(pdf["n"].sum())
            df += np.bincount(_pairs(pdf["bag"])[0]["term"], minlength=terms)
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.concatenate([[-2, -1], some]), "n": np.concatenate([[docs, length], df[some]])})

    rows = kept.select("n", "bag").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return Statistics(found.get(-2, 0), found.get(-1, 0), np.array([found.get(t, 0) for t in range(terms)], np.int64))


def classes_of(kept: DataFrame, stats: Statistics) -> DataFrame:
    """h, m, bag, docs, first of every class of documents with one m and one bag; copies are counted before they are shuffled.

    h is a hash of both that deals the rows; m and bag are keys too, so rows of one hash with other bags stay apart.
    """
    found = with_class(kept, stats).where("octet_length(bag) > 0 AND doc_id IS NOT NULL")
    return found.groupBy("h", "m", "bag").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))


def with_class(kept: DataFrame, stats: Statistics) -> DataFrame:
    m = stats.norm(F.col("n"))
    return kept.withColumn("m", m).withColumn("h", F.xxhash64("m", "bag"))


def score_block(bag: pd.Series, m: np.ndarray, weights: np.ndarray, block: Block) -> np.ndarray:
    """Scores of some classes (rows) against all items of the block (columns), as 64-bit integers."""
    n_items = len(block.ids)
    pairs, row = _pairs(bag)
    term, tf = pairs["term"].astype(np.int64), pairs["tf"].astype(np.int64)
    part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
    many = np.diff(block.starts)[term]
    ends = np.cumsum(many)
    # no item gets more than a million times the weight of all its terms; sums of doubles are exact below 2**53
    exact = float(weights.sum()) * 1e6 < 2.0**53
    out = np.zeros((len(bag), n_items), np.float64 if exact else np.int64)
    flat, start = out.reshape(-1), 0
    while start < term.size:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CELLS, "right")))
        n = many[start:stop]
        where = np.repeat(block.starts[term[start:stop]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        cell = np.repeat(row[start:stop] * n_items, n) + block.items[where]
        value = np.repeat(part[start:stop], n)
        if exact:
            low = int(row[start]) * n_items
            got = np.bincount(cell - low, weights=value)
            flat[low : low + got.size] += got
        else:
            np.add.at(flat, cell, value)
        start = stop
    return out.astype(np.int64)


def _best(held: np.ndarray, k: int) -> np.ndarray:
    """The k best classes of each item: highest score, then smallest doc_id."""
    held = held[np.lexsort((held["first"], -held["score"], held["item"]))]
    item = held["item"]
    first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if item.size else np.empty(0, np.int64)
    place = np.arange(item.size) - np.repeat(first, np.diff(np.append(first, item.size)))
    return held[place < k]


_HIT = np.dtype([("item", "<i8"), ("score", "<i8"), ("first", "<i8"), ("docs", "<i8"), ("class_id", "<i8")])


def best_classes(classes: DataFrame, block: Block, weights: np.ndarray, k: int) -> DataFrame:
    """item_id, score, first, docs, class_id: at most k classes an item out of each task, whose best are carried over its batches."""
    held = classes.sparkSession.sparkContext.broadcast((block, weights))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, weights = held.value
        best, least = np.empty(0, _HIT), np.ones(len(block.ids), np.int64)  # scores above 0 only
        rows = max(1, CELLS // max(1, len(block.ids)))
        for pdf, at in ((p, a) for p in it for a in range(0, len(p), rows)):
            part = pdf.iloc[at : at + rows]
            scores = score_block(part["bag"], part["m"].to_numpy(np.int64), weights, block)
            row, item = np.nonzero(scores >= least)
            new = np.empty(row.size, _HIT)
            new["item"], new["score"] = item, scores[row, item]
            for c in ("first", "docs", "class_id"):
                new[c] = part[c].to_numpy(np.int64)[row]
            best = _best(np.concatenate([best, new]), k)
            full = np.bincount(best["item"], minlength=least.size) >= k
            worst = np.full(least.size, np.iinfo(np.int64).max)
            np.minimum.at(worst, best["item"], best["score"])
            least[full] = worst[full]
        ids = np.array(block.ids, np.int64)
        yield pd.DataFrame({"item_id": ids[best["item"]]} | {c: best[c] for c in ("score", "first", "docs", "class_id")})

    return classes.select("bag", "m", "docs", "first", "class_id").mapInPandas(run, "item_id long, score long, first long, docs long, class_id long")


def _search(docs: DataFrame, block: Block, k: int) -> tuple[DataFrame, list[DataFrame]]:
    kept = shared.keep(bags(docs, block), "search-bags")
    stats = statistics(kept, len(block.vocabulary))
    # numbers of rows of a table that is written hold for all its readers
    classes = shared.keep(classes_of(kept, stats).withColumn("class_id", F.monotonically_increasing_id()), "search-classes")
    hits = best_classes(classes, block, stats.weights, k)
    by_item = Window.partitionBy("item_id")
    hits = hits.withColumn("place", F.row_number().over(by_item.orderBy(F.desc("score"), "first"))).where(F.col("place") <= k)
    above = F.sum("docs").over(by_item.orderBy(F.desc("score"))) - F.sum("docs").over(Window.partitionBy("item_id", "score"))
    hits = shared.keep(hits.withColumn("above", above).where(F.col("above") < k).select("item_id", "score", "class_id"), "search-hits")
    # at most k classes an item of the block: MOST_ITEMS * TOP_K rows of two numbers
    wanted = classes.join(F.broadcast(hits.select("class_id").distinct()), "class_id").select("class_id", "h", "m", "bag")
    keys = wanted.select("h", "m").distinct()
    members = with_class(kept, stats).where("doc_id IS NOT NULL").join(F.broadcast(keys), ["h", "m"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("h", "m", "bag").orderBy("doc_id"))
    members = members.withColumn("nth", nth).where(F.col("nth") <= k).select("h", "m", "bag", "doc_id")  # k a class out of each task
    members = members.join(wanted, ["h", "m", "bag"]).select("class_id", "doc_id")
    found = hits.join(members, "class_id").withColumn("rank", F.row_number().over(by_item.orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    out = shared.keep(found.select("item_id", "rank", "doc_id", "score"), "search-found")
    return out, [kept, classes, hits]


def search(docs: DataFrame, items: DataFrame, k: int = TOP_K, most_items: int = MOST_ITEMS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 of each item, equal scores by ascending doc_id."""
    out = None
    for block in item_blocks(items, most_items, most_bytes):
        found, used = _search(docs, block, k)
        for table in used:
            shared.forget(table)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
