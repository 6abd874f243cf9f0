"""Toxicity by multiple-instance learning: a text is a bag of sentences, and only texts have labels.

A sentence ends at a line feed, or at ``.``, ``!`` or ``?`` before white space. Its features are its distinct words (runs of ASCII
letters and digits and of bytes beyond ASCII, A-Z lower-cased) and their first 4 to 7 bytes, hashed to 2**HASH_BITS numbers. A
sentence's probability is the logistic of a bias and its features' weights, and a text's is the noisy-or of its sentences:
1 - prod(1 - p). As 1 - p is exp(-softplus(z)), that is 1 - exp(-sum of softplus(z)). The likelihood of the texts' labels
trains the weights; blame thus goes to the sentences that explain a label, and scores of sentences locate them.

Bounds: fitted by one task on at most ``max_rows`` labelled texts (half of each class at most, those with the smallest hash of
their id; a class weighs the square root of its labels, between its true share and an equal one) of at most ``max_chars`` characters; features of fewer than ``least`` such texts
get no weight. Scoring is a map over all whole texts, a few MB of them at a time.

Defined cases: null and empty texts have no sentence and score 0; null labels are left out, a repeated id counts once with its
smallest label; without labels of both classes every score is below 1e-15; repeated rows score alike; other columns
of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia_spark.llm import shared
from scholia_spark.llm.quality import fold
from scholia_spark.llm.textkit import batches, mix

HASH_BITS = 18
PREFIXES = (4, 5, 6, 7)
MAX_ROWS, MAX_CHARS, LEAST = 8_000, 1 << 20, 3
FOLDS, THRESHOLD = 5, 0.5
BIAS = -6.0

_RNG = np.random.default_rng(12)
_PLACE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_VALUE = _VALUE[_LOW]
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_END = np.zeros(256, bool)
_END[[0x21, 0x2E, 0x3F]] = True


@dataclass
class Bags:
    """Some texts: features (a row for each distinct word of a sentence, -1 where the word is no longer than the prefix), the
    sentence of each row, and for each sentence its text and its bytes ``start`` to ``end`` within all of ``data``."""

    features: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    text_start: np.ndarray


def bags(texts: list[str | None]) -> Bags:
    """The sentences of whole texts that hold a word."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    text_start = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
    none = np.empty(0, np.int64)
    inside = np.flatnonzero(_WORD[data])
    if not inside.size:
        return Bags(np.empty((0, 1 + len(PREFIXES)), np.int32), none, none, none, none, data, text_start)
    ends = data == 0x0A
    ends[:-1] |= _END[data[:-1]] & _SPACE[data[1:]]
    ends = np.flatnonzero(ends)
    first = np.flatnonzero(np.concatenate([[True], np.diff(inside) > 1]))
    lengths = np.diff(np.append(first, inside.size))
    place = np.arange(inside.size) - np.repeat(first, lengths)
    value = _VALUE[data[inside]] * _PLACE[place & 255]
    hashes = [np.add.reduceat(value, first) + lengths.astype(np.uint64)]
    hashes += [np.where(lengths > k, np.add.reduceat(np.where(place < k, value, np.uint64(0)), first) + np.uint64(1000 + k), np.uint64(0)) for k in PREFIXES]
    where = np.searchsorted(ends, inside[first])  # the sentence of each word, of all that end somewhere
    key = mix(mix(hashes[0]) + where.astype(np.uint64))
    one = np.unique(key, return_index=True)[1]
    one = one[np.argsort(where[one], kind="stable")]
    features = np.stack([np.where(h[one] == 0, np.int32(-1), (mix(h[one]) >> np.uint64(64 - HASH_BITS)).astype(np.int32)) for h in hashes], axis=1)
    held, sentence = np.unique(where[one], return_inverse=True)
    start = np.where(held > 0, ends[held - 1] + 1, 0)
    text = np.searchsorted(text_start, start, "right") - 1
    return Bags(features, sentence, text, start, np.minimum(ends[held] + 1, text_start[text + 1] - 1), data, text_start)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def logits(found: Bags, weights: np.ndarray, bias: float) -> np.ndarray:
    """z of every sentence. ``weights`` has a last entry 0 for feature -1."""
    by_word = weights[found.features].sum(axis=1, dtype=np.float64)
    return bias + np.bincount(found.sentence, weights=by_word, minlength=found.start.size)


def first_weights(rows: list[np.ndarray], y: np.ndarray, start: float) -> np.ndarray:
    """``start`` times the log ratio of the shares of toxic and other texts that hold a feature, where it is above 0; two standard
    deviations are taken off the count of toxic texts, so that rare features start at 0."""
    n = 1 << HASH_BITS
    held = np.zeros((2, n + 1))
    for r, label in zip(rows, y):
        held[int(label > 0)][np.unique(r)] += 1
    sure = np.maximum(held[1] - 2 * np.sqrt(held[1]), 1e-9) / (1 + (y > 0).sum())
    w = start * np.maximum(np.log(sure) - np.log((held[0] + 2 * np.sqrt(held[0]) + 1) / (1 + (y <= 0).sum())), 0.0)
    w[n] = 0.0
    return w


def train(sizes: list[np.ndarray], rows: list[np.ndarray], y: np.ndarray, share: np.ndarray, least: int = LEAST, epochs: int = 25, batch: int = 64, rate: float = 0.3, l1: float = 5e-4, start: float = 0.4, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias that fit the noisy-or of the sentences to the labels: AdaGrad over batches of texts, with soft thresholds.

    sizes: of each text the words by sentence; rows: the words' features; y: 0 or 1; share: the weight of each text.
    """
    n = 1 << HASH_BITS
    seen = np.zeros(n + 1, np.int32)
    for r in rows:
        seen[np.unique(r)] += 1
    kept = seen >= least
    kept[n] = False
    rows = [np.where(kept[r], r, n) for r in rows]
    w, bias = first_weights(rows, y, start), BIAS
    g2, b2 = np.full(n + 1, 1e-2), 1e-2
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            words = np.concatenate([rows[i] for i in some])
            per = np.concatenate([sizes[i] for i in some])
            text = np.repeat(np.arange(some.size), [sizes[i].size for i in some])
            sentence = np.repeat(np.arange(per.size), per)
            z = bias + np.bincount(sentence, weights=w[words].sum(axis=1), minlength=per.size)
            total = np.bincount(text, weights=_softplus(z), minlength=some.size)
            # of a text with label 0 the loss is total, of one with label 1 it is -log(1 - exp(-total))
            slope = np.where(y[some] > 0, -1.0 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) * share[some] / some.size
            gz = slope[text] / (1.0 + np.exp(-np.clip(z, -50, 50)))
            g = np.bincount(words.ravel(), weights=np.repeat(gz[sentence], words.shape[1]), minlength=n + 1)
            g[n] = 0
            touched = np.flatnonzero(g)
            gt = g[touched]
            g2[touched] += gt * gt
            step = rate / np.sqrt(g2[touched])
            moved = w[touched] - step * gt
            w[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0.0)
            gb = gz.sum()
            b2 += gb * gb
            bias -= rate / np.sqrt(b2) * gb
    w[n] = 0.0
    return w.astype(np.float32), float(bias)


def _features(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        words, sizes = [], []
        for t in pdf["text"]:
            found = bags([t])
            words.append(found.features.tobytes())
            sizes.append(np.bincount(found.sentence, minlength=found.start.size).astype(np.int32).tobytes())
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "share": pdf["share"], "words": pd.Series(words, dtype=object), "sizes": pd.Series(sizes, dtype=object)})


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "words"])
    y = (pdf["toxic"].to_numpy() > 0).astype(int)
    w, bias = np.zeros((1 << HASH_BITS) + 1, np.float32), -50.0
    if len(set(y)) == 2:
        rows = [np.frombuffer(b, np.int32).reshape(-1, 1 + len(PREFIXES)) for b in pdf["words"]]
        w, bias = train([np.frombuffer(b, np.int32) for b in pdf["sizes"]], rows, y, pdf["share"].to_numpy(float))
    return pd.DataFrame({"weights": [w.tobytes()], "bias": [bias]})


Model = tuple[np.ndarray, float]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = FOLDS, max_chars: int = MAX_CHARS) -> Model:
    """Weights and bias from labelled rows outside the held-out fold."""
    shared.bound_batches(docs.sparkSession)
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id"), folds) != 0)
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    none = np.zeros((1 << HASH_BITS) + 1, np.float32), -50.0
    if len(counts) < 2:
        return none
    picked = {k: min(n, max_rows // 2) for k, n in counts.items()}
    weights = {k: counts[k] ** 0.5 / picked[k] for k in counts}
    mean = sum(counts[k] ** 0.5 for k in counts) / sum(picked.values())
    parts = [
        usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(picked[k])
        .withColumn("share", F.lit(weights[k] / mean))
        for k in (0, 1)
    ]
    chosen = F.broadcast(parts[0].union(parts[1]))  # max_rows bounds it
    text = F.col("text").cast("string")
    rows = docs.where(F.length(text) <= max_chars).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(chosen, "doc_id")
    rows = rows.mapInPandas(_features, "doc_id long, toxic int, share double, words binary, sizes binary")
    got = rows.groupBy(F.lit(0).alias("one")).applyInPandas(_fit, "weights binary, bias double").collect()
    return (np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"]) if got else none


def score_texts(texts: list[str | None], model: Model) -> pd.DataFrame:
    """Of each text its score, sentences, and number, start, end (in characters) and score of its worst sentence (nulls without one)."""
    found = bags(texts)
    z = logits(found, *model)
    n = len(texts)
    total = np.bincount(found.text, weights=_softplus(z), minlength=n)
    first = np.searchsorted(found.text, np.arange(n + 1))
    out = pd.DataFrame({"score": -np.expm1(-total), "n_sentences": np.diff(first)})
    has = np.flatnonzero(np.diff(first))
    order = np.lexsort((np.arange(z.size), -z, found.text))
    worst = order[first[has]]  # the first of the highest in each text
    chars = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])
    at = lambda b: chars[b] - chars[found.text_start[has]]
    worst_ = pd.DataFrame({"worst_start": at(found.start[worst]), "worst_end": at(found.end[worst]), "worst_score": 1 / (1 + np.exp(-z[worst]))}, index=has)
    return out.join(worst_.astype({"worst_start": "Int64", "worst_end": "Int64"}))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_sentences, worst_start, worst_end (characters of the worst sentence), worst_score of every row."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    held = spark.sparkContext.broadcast(model)  # 2**HASH_BITS float32

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = list(pdf["text"])
            for a, b in batches(texts):
                yield pd.concat([pdf[["doc_id"]].iloc[a:b].reset_index(drop=True), score_texts(texts[a:b], held.value)], axis=1)

    schema = "doc_id string, score double, n_sentences long, worst_start long, worst_end long, worst_score double"
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "worst_start", "worst_end", "worst_score")


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (from 0, of those with a word), start, end (characters), score, text of every sentence of that score at least."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ids, texts = list(pdf["doc_id"]), list(pdf["text"])
            for a, b in batches(texts):
                found = bags(texts[a:b])
                p = 1 / (1 + np.exp(-logits(found, *held.value)))
                first = np.searchsorted(found.text, np.arange(b - a))
                chars = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])
                rows = []
                for s in np.flatnonzero(p >= least):
                    t = int(found.text[s])
                    start, end = (int(chars[x] - chars[found.text_start[t]]) for x in (found.start[s], found.end[s]))
                    rows.append((ids[a + t], int(s - first[t]), start, end, float(p[s]), texts[a + t][start:end]))
                yield pd.DataFrame(rows, columns=["doc_id", "sentence", "start", "end", "score", "text"])

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return found.mapInPandas(run, "doc_id string, sentence long, start long, end long, score double, text string").withColumn("doc_id", F.col("doc_id").cast("long"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and the worst sentence of every row."""
    out = classify(docs, fit(docs, labels, max_rows, folds))
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", "predicted", "n_sentences", "worst_start", "worst_end", "worst_score")
