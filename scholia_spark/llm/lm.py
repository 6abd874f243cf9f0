"""LM scoring: an interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark, stored as sorted hash arrays.

1. Words: maps count the 64-bit word hashes of a chunk; hash buckets merge them into sorted arrays, whose places number the
   words. A word's number is its bucket's offset plus its place, so grams are shuffled as numbers of as few bytes as they need.
2. Grams are dealt by their context's last word, except that words with more than a bucket's share of all tokens (fewer
   than there are buckets) are spread by the next word outward. A bucket's arrays (sorted 64-bit keys and counts; for words also
   continuation counts and the numbers of followers seen once, twice and more often) are files in the shared folder.
3. Scoring maps these files into memory and looks up the sorted distinct keys of a chunk, so pages are touched in order.

p(w | v) = max(c(vw) - D, 0) / c(v) + g(v) * p(w), with p(w) from continuation counts, itself interpolated with 1 / (V + 1);
probabilities of all words and the unknown word sum to 1. Each D comes from counts of counts (Chen and Goodman).

At order 3, p(w | uv) is of the same form over p(w | v). A task sees each context uv whole and adds up how many words
precede vw; these continuation counts stand for c(vw) below, but for the first word of a text, which nothing precedes: it is
scored at order 2 with its count. A context seen once is known by its bigram; the others have rows of their own.

Bounds: the number of buckets follows the bytes of text (``BUCKET_BYTES`` each), so a task's share stays the same.

Defined cases: null texts are empty and consist of the end token; without training rows every probability is 1 / (V + 1);
repeated rows count and are scored each time; a null id hashes as the empty text; an empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia_spark.llm import shared
from scholia_spark.llm.quality import fold
from scholia_spark.llm.textkit import batches, mix, tokenise

_U = np.uint64
_LOW, _HALF = _U(0xFFFFFFFF), _U(32)
END, START = _U(0xE0D0E0D0E0D0E0D1), _U(0x5747A27B5747A27B)
#: Tokens counted at once, and characters scored at once: what a worker holds.
CHUNK = 1_500_000
SCORE_CHARS = 3_000_000
#: Bytes of text that a bucket stands for, and the most buckets.
BUCKET_BYTES = 12 << 20
MAX_BUCKETS = 1 << 20


def token_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text followed by its end token, and the place where each text starts."""
    words, counts = tokenise(texts)
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(words.size + counts.size, _U)
    inner = np.ones(out.size, bool)
    inner[ends] = False
    out[inner], out[ends] = words, END
    return out, ends - counts


def _before(values: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """What stands before each token; ``start`` before the first of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first] = start
    return out


def _chunks(it: Iterator[pd.DataFrame], size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, places where texts start) of about ``size`` tokens."""
    tokens, first, held = [], [], 0
    for pdf in it:
        texts = list(pdf["text"])
        for a, b in batches(texts):
            t, starts = token_stream(texts[a:b])
            tokens.append(t)
            first.append(starts + held)
            held += t.size
            if held >= size:
                yield np.concatenate(tokens), np.concatenate(first)
                tokens, first, held = [], [], 0
    if held:
        yield np.concatenate(tokens), np.concatenate(first)


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, as many as the largest needs: the upper ones compress well."""
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + planes.tobytes()


def _unpack(parts) -> np.ndarray:
    """The numbers of several ``_pack``, one after the other."""
    out = np.zeros((sum((len(p) - 1) // p[0] for p in parts), 8), np.uint8)
    at = 0
    for p in parts:
        planes = np.frombuffer(p, np.uint8, offset=1).reshape(p[0], -1)
        out[at : at + planes.shape[1], : p[0]] = planes.T
        at += planes.shape[1]
    return out.reshape(-1).view("<u8")


def _cuts(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of equal values."""
    at = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if buckets.size else np.empty(0, np.int64)
    return at, np.append(at[1:], buckets.size)


def _packed(bucket: np.ndarray, columns: list[np.ndarray], runs: list[np.ndarray] = ()) -> pd.DataFrame:
    """One row a bucket: its slice of each column, and of each of ``runs`` the values of its runs and their lengths. Rows come sorted by bucket."""
    low, high = _cuts(bucket)
    out: dict = {"bucket": bucket[low].astype(np.int64)}
    for i, c in enumerate(columns):
        out[f"c{i}"] = [_pack(c[a:b]) for a, b in zip(low, high, strict=True)]
    for i, c in enumerate(runs):
        cut = [_cuts(c[a:b]) for a, b in zip(low, high, strict=True)]
        k = len(columns) + 2 * i
        out[f"c{k}"] = [_pack(c[a:b][x]) for (a, b), (x, _) in zip(zip(low, high, strict=True), cut, strict=True)]
        out[f"c{k + 1}"] = [_pack(y - x) for x, y in cut]
    return pd.DataFrame(out)


def _schema(columns: int) -> str:
    return "bucket int" + "".join(f", c{i} binary" for i in range(columns))


def word_bucket(words: np.ndarray, n: int) -> np.ndarray:
    return ((words >> _U(40)) % _U(n)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")


def _write(path: str, array: np.ndarray) -> None:
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def _read(path: str):
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


@dataclass
class Words:
    """The numbered words: files of sorted hashes by bucket, and the number of each bucket's first word."""

    folder: str
    offsets: np.ndarray

    @property
    def buckets(self) -> int:
        return self.offsets.size - 1

    def find(self, words: np.ndarray):
        """(bucket, places in ``words``, places in the bucket's arrays) of the known ones among sorted distinct words."""
        b = word_bucket(words, self.buckets)
        o = _by_bucket(b, self.buckets)
        for low, high in zip(*_cuts(b[o]), strict=True):
            at = o[low:high]
            k = int(b[at[0]])
            have = _read(f"{self.folder}/w{k}.npy")
            if have is not None and have.size:
                p = np.minimum(np.searchsorted(have, words[at]), have.size - 1)
                ok = np.asarray(have[p]) == words[at]
                yield k, at[ok], p[ok]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct words; unknown ones share the number after the last."""
        out = np.full(words.size, self.offsets[-1], _U)
        for k, at, place in self.find(words):
            out[at] = (place + self.offsets[k]).astype(_U)
        return out


@dataclass
class Dealing:
    """How grams are dealt to buckets: by the context's last word v, and by the next word outward too where v is hot."""

    buckets: int
    hot: np.ndarray  # sorted numbers, that of START among them
    start: int

    def bucket(self, v: np.ndarray, outward: np.ndarray) -> np.ndarray:
        h = mix(v + _U(1))
        if self.hot.size:
            at = np.minimum(np.searchsorted(self.hot, v), self.hot.size - 1)
            h = np.where(self.hot[at] == v, mix(h ^ outward), h)
        return ((h >> _U(8)) % _U(self.buckets)).astype(np.int64)

    def of_triples(self, u, v, w) -> np.ndarray:
        return self.bucket(v, np.where(v == _U(self.start), w, u))


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v + _U(1)) * _U(0x9DDFEA08EB382D69) + w)


def triple_keys(pairs: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``pairs``: pair_keys of the middle word and the first."""
    return mix(pairs * _U(0x9DDFEA08EB382D69) + w)


def _dense(*columns: np.ndarray) -> tuple[np.ndarray | None, list[np.ndarray]]:
    """Columns below 2**32 as they are (names None), else as places in ``names``."""
    if all(int(c.max(initial=0)) < 1 << 32 for c in columns):
        return None, list(columns)
    names, place = np.unique(np.concatenate(columns), return_inverse=True)
    return names, np.split(place.astype(_U), np.cumsum([c.size for c in columns])[:-1])


def _named(names: np.ndarray | None, column: np.ndarray) -> np.ndarray:
    return column if names is None else names[column.astype(np.int64)]


def _count_words(n: int):
    def run(it):
        for tokens, _ in _chunks(it):
            words, counts = np.unique(np.append(tokens, START), return_counts=True)
            counts[np.searchsorted(words, START)] -= 1
            b = word_bucket(words, n)
            o = _by_bucket(b, n)
            yield _packed(b[o], [words[o], counts[o]])

    return run


def _merge_words(folder: str):
    """Writes a bucket's words and counts."""

    def run(pdf):
        bucket = int(pdf["bucket"].iloc[0])
        words, place = np.unique(_unpack(pdf["c0"]), return_inverse=True)
        total = np.bincount(place, _unpack(pdf["c1"]).astype(np.float64), words.size).astype(np.int64)
        _write(f"{folder}/w{bucket}.npy", words)
        _write(f"{folder}/c{bucket}.npy", total)
        return pd.DataFrame({"bucket": [bucket], "names": [words.size], "words": [int((total > 0).sum())], "tokens": [int(total.sum())]})

    return run


def _chunk_numbers(tokens: np.ndarray, first: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the chunk's words, START's at the end; places of w and of v among them)."""
    names, w = np.unique(tokens, return_inverse=True)
    w = w.astype(_U)
    numbers = np.append(words.numbers(names), words.numbers(np.array([START])))
    return numbers, w, _before(w, first, _U(names.size))


def _count_pairs(words: Words, deal: Dealing):
    def run(it):
        for tokens, first in _chunks(it):
            numbers, w, v = _chunk_numbers(tokens, first, words)
            pairs, counts = np.unique(v << _HALF | w, return_counts=True)
            v, w = numbers[pairs >> _HALF], numbers[pairs & _LOW]
            b = deal.bucket(v, w)
            o = _by_bucket(b, deal.buckets)
            yield _packed(b[o], [w[o], counts[o]], [v[o]])

    return run


def _count_triples(words: Words, deal: Dealing):
    def run(it):
        for tokens, first in _chunks(it):
            numbers, w, v = _chunk_numbers(tokens, first, words)
            u = _before(v, first, _U(numbers.size - 1))
            pairs, at = np.unique(v << _HALF | u, return_inverse=True)
            triples, counts = np.unique(at.astype(_U) << _HALF | w, return_counts=True)
            pairs = pairs[triples >> _HALF]
            u, v, w = numbers[pairs & _LOW], numbers[pairs >> _HALF], numbers[triples & _LOW]
            b = deal.of_triples(u, v, w)
            o = _by_bucket(b, deal.buckets)
            yield _packed(b[o], [w[o], counts[o]], [u[o], v[o]])

    return run


def _write_counts(folder: str, names: str, bucket: int, keys: np.ndarray, total: np.ndarray) -> pd.DataFrame:
    """Writes keys, sorted, and their counts; returns the counts of counts."""
    o = np.argsort(keys)
    total = total[o]
    _write(f"{folder}/{names}k{bucket}.npy", keys[o])
    big = np.flatnonzero(total >= 255)
    _write(f"{folder}/{names}n{bucket}.npy", np.minimum(total, 255).astype(np.uint8))
    _write(f"{folder}/{names}o{bucket}.npy", np.stack([big, total[big]]))
    return pd.DataFrame({"bucket": [-1], "c0": [np.array([(total == k).sum() for k in (1, 2, 3, 4)]).tobytes()]})


def _by_group(place: np.ndarray, total: np.ndarray, groups: int) -> np.ndarray:
    """Sum of the counts of each group, and how many are 1, 2, more."""
    kinds = [np.bincount(place, total == k if k < 3 else total >= 3, groups) for k in (1, 2, 3)]
    return np.stack([np.bincount(place, total, groups), *kinds], axis=1).astype(np.int64)


def _merge_triples(folder: str, deal: Dealing):
    """Writes the trigrams of a bucket and its contexts; returns counts of counts, and the counts of their last two words."""

    def run(pdf):
        bucket = int(pdf["bucket"].iloc[0])
        w, counts = _unpack(pdf["c0"]), _unpack(pdf["c1"])
        u, v = (np.repeat(_unpack(pdf[a]), _unpack(pdf[b]).astype(np.int64)) for a, b in (("c2", "c3"), ("c4", "c5")))
        del pdf
        names, (u, v, w) = _dense(u, v, w)
        pairs, at = np.unique(v << _HALF | u, return_inverse=True)
        del u, v
        triples, place = np.unique(at.astype(_U) << _HALF | w, return_inverse=True)
        total = np.bincount(place, counts.astype(np.float64)).astype(np.int64)
        del at, w, place, counts
        at, w = (triples >> _HALF).astype(np.int64), triples & _LOW
        del triples
        full_v, full_u = _named(names, pairs >> _HALF), _named(names, pairs & _LOW)
        context = pair_keys(full_v, full_u)
        inner = full_v != _U(deal.start)
        kept = inner[at]
        out = _write_counts(folder, "t", bucket, triple_keys(context[at], _named(names, w))[kept], total[kept])
        facts = _by_group(at, total, pairs.size)
        more = np.flatnonzero(inner & (facts[:, 0] > 1))
        more = more[np.argsort(context[more])]
        _write(f"{folder}/xk{bucket}.npy", context[more])
        _write(f"{folder}/xf{bucket}.npy", facts[more].astype(np.uint32 if facts.max(initial=0) < 1 << 32 else np.int64))
        del context, facts, more, full_u, full_v
        ends, place = np.unique((pairs >> _HALF)[at] << _HALF | w, return_inverse=True)
        adds = np.bincount(place, np.where(kept, 1, total)).astype(np.int64)
        v, w = _named(names, ends >> _HALF), _named(names, ends & _LOW)
        b = deal.bucket(v, w)
        o = _by_bucket(b, deal.buckets)
        return pd.concat([out, _packed(b[o], [w[o], adds[o]], [v[o]])], ignore_index=True).reindex(columns=["bucket", "c0", "c1", "c2", "c3"])

    return run


def _merge_pairs(folder: str, words: Words):
    """Writes the arrays of a bucket; returns its counts of counts, and what its words and contexts add, by word bucket."""

    def run(pdf):
        bucket = int(pdf["bucket"].iloc[0])
        w, counts = _unpack(pdf["c0"]), _unpack(pdf["c1"])
        v = np.repeat(_unpack(pdf["c2"]), _unpack(pdf["c3"]).astype(np.int64))
        del pdf
        names, (v, w) = _dense(v, w)
        pairs, place = np.unique(v << _HALF | w, return_inverse=True)
        total = np.bincount(place, counts.astype(np.float64)).astype(np.int64)
        v, w = _named(names, pairs >> _HALF), _named(names, pairs & _LOW)
        del place, counts, pairs
        out = _write_counts(folder, "", bucket, pair_keys(v, w), total)
        after, times = np.unique(w, return_counts=True)
        ahead, place = np.unique(v, return_inverse=True)
        sums = _by_group(place, total, ahead.size)
        facts = np.zeros((after.size + ahead.size, 5), np.int64)
        facts[: after.size, 0] = times
        facts[after.size :, 1:4], facts[after.size :, 4] = sums[:, 1:], sums[:, 0]
        number = np.concatenate([after, ahead])
        o = np.argsort(number, kind="stable")
        b = np.searchsorted(words.offsets, number[o].astype(np.int64), "right") - 1
        return pd.concat([out, _packed(b, [number[o], *facts[o].T])], ignore_index=True).reindex(columns=["bucket", *[f"c{i}" for i in range(6)]])

    return run


def _merge_facts(folder: str, words: Words):
    """Writes the facts of a bucket's words (continuations; followers seen once, twice, more often; sum of the followers' counts); returns counts of continuations."""

    def run(pdf):
        bucket = int(pdf["bucket"].iloc[0])
        at = _unpack(pdf["c0"]).astype(np.int64) - words.offsets[bucket]
        size = int(words.offsets[bucket + 1] - words.offsets[bucket])
        f = np.stack([np.bincount(at, _unpack(pdf[f"c{k}"]).astype(np.float64), size) for k in range(1, 6)], axis=1).astype(np.int64)
        _write(f"{folder}/f{bucket}.npy", f)
        got = {f"m{k}": [int((f[:, 0] == k).sum())] for k in (1, 2, 3, 4)}
        return pd.DataFrame({"bucket": [bucket]} | got | {"types": [int(f[:, 0].sum())], "seen": [int((f[:, 0] > 0).sum())]})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D of counts 0, 1, 2 and 3 or more; plain halves where the counts of counts don't allow the estimate."""
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.75, 1.0])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0] + [min(max(x, 0.05), k) for k, x in enumerate(d, 1)])


@dataclass
class Model:
    folder: str
    names: Words
    deal: Dealing
    tokens: int
    words: int
    types: int
    d_pair: np.ndarray
    d_word: np.ndarray
    rest: float  # mass that the word level leaves to the uniform distribution
    d_triple: np.ndarray | None = None  # of order 3

    def word_facts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, counts and facts of sorted distinct words (zero where unknown)."""
        number = np.full(words.size, self.names.offsets[-1], _U)
        count, facts = np.zeros(words.size, np.int64), np.zeros((words.size, 5), np.int64)
        for k, at, place in self.names.find(words):
            number[at] = (place + self.names.offsets[k]).astype(_U)
            count[at] = _read(f"{self.folder}/c{k}.npy")[place]
            got = _read(f"{self.folder}/f{k}.npy")
            if got is not None:
                facts[at] = got[place]
        return number, count, facts

    def _found(self, names: str, keys: np.ndarray, bucket: np.ndarray):
        """(bucket, places in ``keys``, places in the bucket's arrays) of the keys that are there."""
        o = np.lexsort((keys, bucket))
        for low, high in zip(*_cuts(bucket[o]), strict=True):
            at = o[low:high]
            k = int(bucket[at[0]])
            have = _read(f"{self.folder}/{names}k{k}.npy")
            if have is not None and have.size:
                p = np.minimum(np.searchsorted(have, keys[at]), have.size - 1)
                ok = np.asarray(have[p]) == keys[at]
                yield k, at[ok], p[ok]

    def gram_counts(self, names: str, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Counts of distinct keys."""
        out = np.zeros(keys.size, np.int64)
        for k, at, place in self._found(names, keys, bucket):
            n = _read(f"{self.folder}/{names}n{k}.npy")[place].astype(np.int64)
            big = np.flatnonzero(n == 255)
            if big.size:
                places, values = _read(f"{self.folder}/{names}o{k}.npy")
                n[big] = values[np.searchsorted(places, place[big])]
            out[at] = n
        return out

    def third(self, w: np.ndarray, v: np.ndarray, u: np.ndarray, seen: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Probabilities of order 3 over those of order 2. ``seen``: whether each token's bigram was seen."""
        p = low.copy()
        at = np.flatnonzero((v != _U(self.deal.start)) & np.append(False, seen[:-1])) if w.size else np.empty(0, np.int64)
        if not at.size:
            return p
        w, v, u = w[at], v[at], u[at]
        context = pair_keys(v, u)
        bucket = self.deal.of_triples(u, v, w)
        keys, first, place = np.unique(triple_keys(context, w), return_index=True, return_inverse=True)
        n = self.gram_counts("t", keys, bucket[first])[place]
        keys, first, place = np.unique(context, return_index=True, return_inverse=True)
        facts = np.tile(np.array([1, 1, 0, 0]), (keys.size, 1))  # as if each were seen once at least
        for k, found, where in self._found("x", keys, bucket[first]):
            facts[found] = _read(f"{self.folder}/xf{k}.npy")[where]
        back = (facts[:, 1:] * self.d_triple[1:]).sum(axis=1) / facts[:, 0]
        p[at] = np.maximum(n - self.d_triple[np.minimum(n, 3)], 0) / facts[place, 0] + back[place] * low[at]
        return p

    def score(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: its training count, base log10 probability, model log10 probability."""
        words, place = np.unique(np.append(tokens, START), return_inverse=True)
        number, count, facts = self.word_facts(words)
        at, begin = place[:-1], place[-1]
        before = _before(at, first, begin)
        low = np.maximum(facts[:, 0] - self.d_word[np.minimum(facts[:, 0], 3)], 0) / max(self.types, 1) + self.rest / (self.words + 1)
        w, v = number[at], number[before]
        pairs, one, place = np.unique(pair_keys(v, w), return_index=True, return_inverse=True)
        n = self.gram_counts("", pairs, self.deal.bucket(v[one], w[one]))[place]
        total = np.maximum(facts[:, 4], 1)
        back = np.where(facts[:, 4] > 0, (facts[:, 1:4] * self.d_pair[1:]).sum(axis=1) / total, 1.0)
        p = np.maximum(n - self.d_pair[np.minimum(n, 3)], 0) / total[before] + back[before] * low[at]
        if self.d_triple is not None:
            p = self.third(w, v, _before(v, first, number[begin]), n > 0, p)
        base = np.log10((count + 1) / (self.tokens + (self.words + 1)))
        return count[at], base[at], np.log10(p)


def local_folder(path: str) -> str:
    """The folder as workers open it. Stores that are not mounted need a mounted spark.checkpoint.dir for the model."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"workers map the model's files into memory: mount {path} and name it as file://")
    return path


def _sum_of_counts(df: DataFrame) -> list[int]:
    n_of = np.zeros(4, np.int64)
    for r in df.where("bucket = -1").select("c0").collect():  # four numbers a bucket
        n_of += np.frombuffer(r["c0"], np.int64)
    return [int(x) for x in n_of]


def bucket_count(docs: DataFrame) -> int:
    """Buckets for the bytes of text in ``docs``."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return min(MAX_BUCKETS, max(8, -(-size // BUCKET_BYTES)))


def _hot_words(spark: SparkSession, names: Words, tokens: int) -> np.ndarray:
    """Sorted numbers of the words with more than a bucket's share of all tokens: fewer than there are buckets."""
    folder, offsets, most = names.folder, names.offsets, tokens / names.buckets

    def run(it):
        for pdf in it:
            for k in pdf["id"]:
                count = _read(f"{folder}/c{k}.npy")
                if count is not None:
                    yield pd.DataFrame({"number": np.flatnonzero(count > most) + offsets[k]})

    found = spark.range(names.buckets).mapInPandas(run, "number long").toPandas()["number"]
    return np.sort(found.to_numpy(np.int64)).astype(_U)


def train(docs: DataFrame, buckets: int | None = None, order: int = 2) -> Model:
    """The model of all rows of ``docs`` (text)."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: 2 and 3 are built")
    spark = docs.sparkSession
    shared.bound_batches(spark)
    n = buckets or bucket_count(docs)
    tasks = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = local_folder(shared.new_path(spark, "lm-model"))
    os.makedirs(folder)
    texts = docs.select(F.col("text").cast("string").alias("text"))

    def merged(rows, merge, schema, name):
        return shared.keep(rows.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(merge, schema), name)

    words = merged(texts.mapInPandas(_count_words(n), _schema(2)), _merge_words(folder), "bucket int, names long, words long, tokens long", "lm-words")
    sizes, n_words, n_tokens = np.zeros(n, np.int64), 0, 0
    for r in words.collect():  # four numbers a bucket
        sizes[r["bucket"]] = r["names"]
        n_words, n_tokens = n_words + r["words"], n_tokens + r["tokens"]
    names = Words(folder, np.append(0, np.cumsum(sizes)))
    start = int(names.numbers(np.array([START]))[0])
    deal = Dealing(n, np.union1d(_hot_words(spark, names, n_tokens), np.array([start], _U)), start)

    triples, d_triple = None, None
    if order == 3:
        triples = merged(texts.mapInPandas(_count_triples(names, deal), _schema(6)), _merge_triples(folder, deal), _schema(4), "lm-triples")
        d_triple = discounts(*_sum_of_counts(triples))
    pairs = triples.where("bucket >= 0") if triples is not None else texts.mapInPandas(_count_pairs(names, deal), _schema(4))
    pairs = merged(pairs, _merge_pairs(folder, names), _schema(6), "lm-facts")
    d_pair = discounts(*_sum_of_counts(pairs))
    facts = merged(pairs.where("bucket >= 0"), _merge_facts(folder, names), "bucket int, m1 long, m2 long, m3 long, m4 long, types long, seen long", "lm-continuations")
    r = facts.agg(*[F.sum(c).alias(c) for c in ("m1", "m2", "m3", "m4", "types", "seen")]).first()
    for used in (words, triples, pairs, facts):
        shared.forget(used)
    m = [int(r[f"m{k}"] or 0) for k in (1, 2, 3, 4)]
    types, seen = int(r["types"] or 0), int(r["seen"] or 0)
    d_word = discounts(*m)
    rest = (d_word[1] * m[0] + d_word[2] * m[1] + d_word[3] * (seen - m[0] - m[1])) / types if types else 1.0
    return Model(folder, names, deal, n_tokens, n_words, types, d_pair, d_word, float(rest), d_triple)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""
    shared.bound_batches(docs.sparkSession)

    def run(it):
        held, size = [], 0

        def scored():
            ids, texts = [x[0] for x in held], [x[1] for x in held]
            tokens, starts = token_stream(texts)
            count, base, p = model.score(tokens, starts)
            n = np.diff(np.append(starts, tokens.size))
            s = np.add.reduceat(p, starts)
            return pd.DataFrame(
                {"doc_id": pd.array(ids, "Int64"), "n_tokens": n, "n_known": np.add.reduceat((count > 0).astype(np.int64), starts), "train_tokens": model.tokens, "base_score": np.add.reduceat(base, starts), "score": s, "perplexity": 10.0 ** np.minimum(-s / n, 300)}
            )

        for pdf in it:
            for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                held.append((None if pd.isna(i) else int(i), t))
                size += len(t or "")
                if size >= SCORE_CHARS:
                    yield scored()
                    held, size = [], 0
        if held:
            yield scored()

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema)


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, order: int = 3) -> DataFrame:
    """``score`` of every row and held_out, by the model of the rows whose id's crc32 modulo ``folds`` is not ``held``."""
    model = train(docs.where(fold(F.col("doc_id"), folds) != held), order=order)
    out = score(docs, model)
    return out.withColumn("held_out", fold(F.col("doc_id"), folds) == held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
