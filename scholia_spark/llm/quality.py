"""Quality classifier: Naive Bayes support vectors.

Every text becomes a set of hashed n-gram indicators: word 1- and 2-grams, and 1- to 3-grams of word shapes (runs of
letters, capitals, digits and each punctuation mark, with a mark on words that repeat the one before or on three words
seen earlier in the text). Indicators are scaled by the log ratio of their smoothed class frequencies, and a linear
hinge-loss model over the scaled indicators is fitted by dual coordinate descent (L1 loss, bias as a feature).

Bounds: 2**HASH_BITS indicators, and the model is fitted on at most ``max_rows`` labelled rows (those with the smallest
hash of their id), by one task. Scoring is a map over all rows.

Defined cases: a null text is the empty text, which has no indicator and gets the bias alone; null, repeated or
contradictory labels: nulls are left out, a repeated id counts once with its smallest label; without rows of both classes
every score is 0.5; other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia_spark.llm import shared
from scholia_spark.llm.textkit import batches, mix, ngram_hashes, word_hashes

HASH_BITS = 18
MAX_ROWS = 12_000
FOLDS = 5
THRESHOLD = 0.3
_U = np.uint64

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = ord("a")
_CLASS[65:91] = ord("Z")  # lower-cased by the word hash; Z and a stay apart
_CLASS[48:58] = ord("0")
_CLASS[128:] = ord("a")


def _unseen(h: np.ndarray) -> np.ndarray:
    """True where the value occurs for the first time."""
    first = np.zeros(h.size, bool)
    first[np.unique(h, return_index=True)[1]] = True
    return first


def indicators(text: str | None) -> np.ndarray:
    """Sorted distinct indicator numbers of a whole text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    words, starts = word_hashes(data)
    if not words.size:
        return np.empty(0, np.int32)
    kind = _CLASS[data]
    keep = np.ones(data.size, bool)
    keep[1:] = (kind[1:] != kind[:-1]) | (kind[1:] != ord("a"))
    keep[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] != ord("Z"))
    keep[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] != ord("0"))
    shapes = word_hashes(kind[keep])[0]
    marked = shapes.copy()
    marked[1:] ^= np.where(words[1:] == words[:-1], _U(0x5BF03635), _U(0))
    three = ngram_hashes(words, 3)
    if three.size:
        marked[: three.size] ^= np.where(_unseen(three), _U(0), _U(0x2545F491))
    grams = [mix(words ^ _U(1)), ngram_hashes(words, 2)] + [mix(ngram_hashes(marked, n) ^ _U(7 + n)) if n > 1 else mix(marked ^ _U(3)) for n in (1, 2, 3)]
    return np.unique((np.concatenate(grams) >> _U(64 - HASH_BITS)).astype(np.int32))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the ratio of the smoothed, normalised indicator counts of the two classes."""
    size = 1 << HASH_BITS
    count = [np.full(size, alpha), np.full(size, alpha)]
    for x, label in zip(rows, y):
        count[int(label > 0)][x] += 1
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 0.1, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + c * sum of hinge losses over the scaled indicators; returns the weights times the scale, and the bias."""
    w, bias = np.zeros(scale.size), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[x] for x in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            x, v, t = rows[i], values[i], y[i]
            gradient = t * (w[x] @ v + bias) - 1.0
            if (alpha[i] == 0 and gradient >= 0) or (alpha[i] == c and gradient <= 0):
                continue
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c)
            step = (new - alpha[i]) * t
            alpha[i] = new
            w[x] += step * v
            bias += step
            most = max(most, abs(gradient))
        if most < 1e-3:
            break
    return w * scale, bias


def _fit_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "text"], na_position="first")
    y = np.where(pdf["quality"].to_numpy() > 0, 1.0, -1.0)
    weights, bias = np.zeros(1 << HASH_BITS), 0.0
    if len(set(y)) == 2:
        rows = [np.frombuffer(b, np.int32) for b in pdf["x"]]
        weights, bias = dual_coordinate_descent(rows, y, log_count_ratios(rows, y))
    return pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "bias": [float(bias)]})


def _sample_features(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "text": pd.Series([str(len(t or "")) for t in pdf["text"]], dtype=object), "x": pd.Series([indicators(t).tobytes() for t in pdf["text"]], dtype=object)})


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key is the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = FOLDS) -> tuple[np.ndarray, float]:
    """The model from at most ``max_rows`` labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold(F.col("doc_id"), folds) != 0)
        .groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows bounds the broadcast
    rows = rows.mapInPandas(_sample_features, "doc_id long, quality long, text string, x binary")
    got = rows.groupBy(F.lit(0).alias("one")).applyInPandas(_fit_rows, "weights binary, bias double").collect()
    if not got:
        return np.zeros(1 << HASH_BITS, np.float32), 0.0
    return np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"]


def score_texts(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """Logistic link (slope 2) over the margin: margins -1 and 1 give 0.12 and 0.88."""
    margins = np.array([float(weights[indicators(t)].sum(dtype=np.float64)) + bias for t in texts])
    return 1.0 / (1.0 + np.exp(-2.0 * np.clip(margins, -40, 40)))


def classify(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with score and predicted (1 if score >= threshold) under the names given; columns of these names are replaced."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    shipped = spark.sparkContext.broadcast(model)  # 2**HASH_BITS float32

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        texts, out = list(text), []
        for a, b in batches(texts):
            out.append(score_texts(texts[a:b], *shipped.value))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    out = docs.withColumn(score, scored(F.col("text").cast("string")))
    return out.withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = classify(docs.select("doc_id", "text"), fit(docs, labels, max_rows, folds))
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", "predicted")
