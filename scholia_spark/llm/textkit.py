"""Vectorised tokenising shared by the operators: UTF-8 bytes in, 64-bit word hashes out.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z; those separators are ASCII, so
working on UTF-8 bytes equals working on characters. Everything is NumPy over one Arrow batch, never a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_RNG = np.random.default_rng(20240229)
#: Fixed random odd multipliers by position in the word, and random values by byte; beyond the table positions wrap with a twist.
_POS = _RNG.integers(1, 2**63, size=4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_LOW = _BYTE[_LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` (uint8, separators between words) and the offset at which each starts."""
    if data.size == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = ~_IS_SEP[data]
    edge = np.empty(data.size, bool)
    edge[0] = word[0]
    np.logical_and(word[1:], ~word[:-1], out=edge[1:])
    starts = np.flatnonzero(edge)
    if starts.size == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = np.flatnonzero(word)
    first = np.flatnonzero(edge[inside])  # index into inside of each word's first byte
    lengths = np.diff(np.append(first, inside.size))
    pos = np.arange(inside.size) - np.repeat(first, lengths)
    value = _BYTE_LOW[data[inside]]
    if pos.size and pos.max() >= _POS.size:
        turn = (pos // _POS.size).astype(np.uint64)
        value = (value + turn * np.uint64(0xD6E8FEB86659FD93)) * _POS[pos % _POS.size]
    else:
        value *= _POS[pos]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64)), starts


def tokenise(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of a batch of texts, and per text the number of words. Null is the empty text."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    if not raw:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    hashes, starts = word_hashes(data)
    ends = np.cumsum([len(x) + 1 for x in raw])
    return hashes, np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))


def batches(texts: list[str | None], most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` with about ``most_bytes`` characters each; one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most_bytes:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each place; the last n - 1 places are left out."""
    if words.size < n:
        return np.empty(0, np.uint64)
    out = words[: words.size - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x9DDFEA08EB382D69)
        out ^= out >> np.uint64(33)
        out += words[k : words.size - n + 1 + k]
    return mix(out)
