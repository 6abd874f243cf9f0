"""License scans: winnowed template fingerprints in an inverted index pick candidates, banded alignment reports matches.

Texts and templates are words of letters and digits in lower case. Hashes of ``K`` words are winnowed over ``W`` places
(any shared run of K + W - 1 words shares a fingerprint); the index maps a fingerprint to templates and places. Hits whose
offsets lie within the band of each other make a candidate, and an alignment within the band (match, insertion, deletion,
substitution) around their most frequent offset gives the covered template words and the span in characters of the text.
Whole long licences (over ``LONG`` words) are aligned in parts of ``PART`` words, each with ``PART_HITS`` hits at least (any
shared run of K + W * PART_HITS - 1 words is enough), so common phrases start nothing; parts that follow each other in the
text are added up, so paragraphs may be lost or put in between, and template words between and around the parts of a chain are
aligned with the text there. A match needs a coverage of ``COVERAGE`` (of ``SHORT_COVERAGE`` for templates below ``SHORT``
words), or ``PARTIAL`` matched words of a long licence, and the words in braces of its template, in the text as in the
template: version 2.0 is no version 3.0, BY-NC-SA no BY-SA. A long licence is refused where a word that names another one is
put in before a word of its name, or where the number behind "Version" in its title differs.

Defined cases: null and empty texts match nothing; several matches of a template in one text are rows of their own; a part of a
long licence is a row with its low coverage; where spans of templates overlap, that with more matched words stays, then that with more coverage, then the first name; repeated
rows repeat their matches; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia_spark.llm import license_texts, shared
from scholia_spark.llm.textkit import ngram_hashes, word_hashes

K = 3
W = 2
BAND = 6
LONG = 300
PART = 100
PART_HITS = 8
PART_BAND = 16
COVERAGE = 0.7
SHORT = 25
SHORT_COVERAGE = 0.8
#: Matched words of a long licence that make a row whatever its coverage.
PARTIAL = 150
#: Of the text from start to end of such a part, the share of matched words at least.
SPAN_SHARE = 0.5
#: Of template words between two parts, the share that must be found there; text words that are looked at there.
GAP_SHARE, GAP = 0.6, 600
#: Words at the start of a long licence that hold its title.
TITLE = 20

_KEEP = np.full(256, 0x20, np.uint8)
for _b in [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]:
    _KEEP[_b] = _b


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and the byte offsets where words begin and end."""
    data = _KEEP[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    hashes, starts = word_hashes(data)
    gaps = np.append(np.flatnonzero(data == 0x20), data.size)
    return hashes, starts, gaps[np.searchsorted(gaps, starts)] if starts.size else starts


def winnow(grams: np.ndarray, w: int = W) -> np.ndarray:
    """Places of the smallest hash of each window of ``w`` places, the rightmost of equals."""
    if grams.size <= w:
        return np.array([grams.size - 1 - int(np.argmin(grams[::-1]))]) if grams.size else np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, w)
    return np.unique(np.arange(len(view)) + w - 1 - np.argmin(view[:, ::-1], axis=1))


def marked(template: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a template, and the places of those in braces."""
    words, ends, at = [], [], 0
    for part in re.split(r"[{}]", template):
        words.append(words_of(part)[0])
        at += words[-1].size
        ends.append(at)
    inside = [np.arange(ends[k - 1], ends[k]) for k in range(1, len(ends), 2)]
    return np.concatenate(words), np.concatenate([np.empty(0, np.int64), *inside])


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names, self.words, self.telling, self.part, self.total = [], [], [], [], []
        self.whole: dict[str, np.ndarray] = {}
        hash_of = lambda *x: np.concatenate([words_of(w)[0] for w in x])
        self.naming, self.named, self.version = hash_of(*license_texts.NAMING), hash_of("General", "Public", "License"), hash_of("Version")[0]
        for name in sorted(templates):
            words, telling = marked(templates[name])
            cut = words.size > LONG and not telling.size
            for part, piece in enumerate(np.split(words, range(PART, words.size - PART // 2, PART)) if cut else [words]):
                self.names.append(name)
                self.words.append(piece)
                self.telling.append(telling)
                self.part.append(part if cut else None)
                self.total.append(words.size)
            if cut:
                self.whole[name] = words
        self.every_telling = np.unique(np.concatenate([np.empty(0, np.uint64), *[w[p] for w, p in zip(self.words, self.telling, strict=True)]]))
        # templates too short to share a winnowed place with every text that holds them
        few = [ngram_hashes(w, K) for w in self.words if w.size < K + W - 1]
        self.few = np.unique(np.concatenate([np.empty(0, np.uint64), *few]))
        keys, which, at = [], [], []
        for t, words in enumerate(self.words):
            grams = ngram_hashes(words, K)
            places = winnow(grams)
            keys.append(grams[places])
            which.append(np.full(places.size, t))
            at.append(places)
        keys, which, at = (np.concatenate([np.empty(0, kind), *x]) for x, kind in ((keys, np.uint64), (which, np.int64), (at, np.int64)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.which, self.at = keys[order], which[order], at[order]

    def needed(self, t: int, coverage: float) -> float:
        return max(coverage, SHORT_COVERAGE) if self.words[t].size < SHORT else coverage

    def tells(self, t: int, words: np.ndarray, pairs: list[tuple[int, int]]) -> bool:
        """Whether the telling words of the template are matched, and the text has no other such word among them."""
        text_of = dict(pairs)
        at = [text_of.get(int(p), -1) for p in self.telling[t]]
        if not at:
            return True
        return min(at) >= 0 and int(np.isin(words[min(at) : max(at) + 1], self.every_telling).sum()) == len(at)

    def band(self, t: int) -> int:
        """Words that an alignment may drift: less for short templates, whose matches may follow each other closely."""
        return PART_BAND if self.part[t] is not None else min(BAND, max(1, self.words[t].size // 4))

    def candidates(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(template, offset of its first word in the text), one for each cluster of offsets within the band."""
        grams = ngram_hashes(words, K)
        if not grams.size or not self.keys.size:
            return []
        places = np.union1d(winnow(grams), np.flatnonzero(np.isin(grams, self.few)))
        grams = grams[places]
        low, high = np.searchsorted(self.keys, grams), np.searchsorted(self.keys, grams, "right")
        hit = np.flatnonzero(high > low)
        counts = Counter((int(self.which[k]), int(places[i]) - int(self.at[k])) for i in hit for k in range(low[i], high[i]))
        clusters: list[list[tuple[int, int]]] = []
        for t, shift in sorted(counts):
            if clusters and clusters[-1][0][0] == t and shift - clusters[-1][0][1] <= self.band(t):
                clusters[-1].append((t, shift))
            else:
                clusters.append([(t, shift)])
        strong = (c for c in clusters if self.part[c[0][0]] is None or sum(counts[x] for x in c) >= PART_HITS)
        return [max(c, key=lambda x: counts[x]) for c in strong]


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int = BAND) -> list[tuple[int, int]]:
    """(template place, text place) of the words that match in the best alignment near ``shift``."""
    n, width = template.size, 2 * band + 1
    at = np.arange(n)[:, None] + shift + np.arange(width) - band
    same = (at >= 0) & (at < words.size)
    same &= words[np.clip(at, 0, words.size - 1)] == template[:, None]
    score = np.zeros((n + 1, width), np.int64)
    for i in range(n):
        now = score[i] + same[i]
        now[:-1] = np.maximum(now[:-1], score[i, 1:])  # a template word without partner
        score[i + 1] = np.maximum.accumulate(now)  # text words without partner
    i, d, pairs = n, int(score[n].argmax()), []
    while i > 0:
        if same[i - 1, d] and score[i, d] == score[i - 1, d] + 1:
            pairs.append((i - 1, int(at[i - 1, d])))
            i -= 1
        elif score[i, d] == score[i - 1, d]:
            i -= 1
        elif d + 1 < width and score[i, d] == score[i - 1, d + 1]:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return pairs[::-1]


def chains(parts: list[tuple[int, int, int, int]], total: int, needed: float) -> list[tuple[int, list[int]]]:
    """Parts (start, end, part, matched words) of a long template to its matches (matched words, indexes of their parts): parts
    in order whose gaps are shorter than the template, the chain of most matched words first, later ones beside it."""
    order, out = sorted(range(len(parts)), key=lambda i: parts[i]), []
    while order:
        best, before = {i: parts[i][3] for i in order}, dict.fromkeys(order)
        for k, i in enumerate(order):
            start, _, part, n = parts[i]
            for j in reversed(order[:k]):
                if start - parts[j][0] > 2 * total:
                    break
                if parts[j][2] < part and 0 < start - parts[j][1] <= total and best[j] + n > best[i]:
                    best[i], before[i] = best[j] + n, j
        last = max(order, key=best.__getitem__)
        if best[last] < needed:
            break
        chain = [last]
        while before[chain[-1]] is not None:
            chain.append(before[chain[-1]])
        first, end = parts[chain[-1]][0], parts[last][1]
        out.append((best[last], chain[::-1]))
        order = [i for i in order if parts[i][1] < first or parts[i][0] > end]
    return out


def _filled(template: np.ndarray, words: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``pairs`` of a chain, with those of template words that lie between its parts or around them and are found in the text there."""
    ends = [(-1, max(-1, pairs[0][1] - pairs[0][0] - PART_BAND - 1)), *pairs, (template.size, min(words.size, pairs[-1][1] + template.size - pairs[-1][0] + PART_BAND))]
    out = []
    for (t, x), (u, y) in zip(ends, ends[1:]):
        if t >= 0:
            out.append((t, x))
        if u - t > 4 and y - x > 1:
            # a long stretch of other text may lie between: what is behind the part before, and what is before the part behind
            for a, b in [(x + 1, y)] if y - x - 1 <= u - t - 1 + GAP else [(x + 1, x + u - t + GAP // 2), (y - (u - t) - GAP // 2, y)]:
                piece, text = template[t + 1 : u], words[a:b]
                low, high = min(0, text.size - piece.size), max(0, text.size - piece.size)
                found = align(piece, text, (low + high) // 2, (high - low) // 2 + PART_BAND)
                if len(found) >= GAP_SHARE * piece.size:
                    out += [(i + t + 1, j + a) for i, j in found]
                    break
    return out


def _another(index: Index, template: np.ndarray, words: np.ndarray, pairs: list[tuple[int, int]]) -> bool:
    """Whether the text names another licence where the template has its own name or its version."""
    text_of = dict(pairs)
    at, place = np.array([j for _, j in pairs], np.int64), [i for i, _ in pairs]
    # put in within what is aligned, before a word of the name that is matched: once in the title, or at a quarter of all names
    step, names = np.diff(at), max(1, int((words[at] == index.named[0]).sum()))
    inserted = 0
    for k in np.flatnonzero((step > 1) & (step <= 3)):
        if np.isin(words[at[k + 1]], index.named) and np.isin(words[at[k] + 1 : at[k + 1]], index.naming).any():
            inserted += names if place[k] < TITLE else 1
    if 4 * inserted > names:
        return True
    for p in np.flatnonzero(template[:TITLE] == index.version):
        if int(p) in text_of and int(p) + 1 not in text_of and text_of[int(p)] + 1 < words.size and np.isin(words[text_of[int(p)] + 1], index.every_telling):
            return True
    return False


Match = tuple[str, float, int, int, int, float]


def scan_text(text: str | None, index: Index, coverage: float = COVERAGE) -> list[Match]:
    """(template, coverage, matched words, start, end in characters, coverage of the span) of each match in a whole text, by starts."""
    words, starts, ends = words_of(text)
    found, parts, aligned = [], {}, {}
    for t, shift in index.candidates(words):
        pairs = align(index.words[t], words, shift, index.band(t))
        if not pairs:
            continue
        a, b = pairs[0][1], pairs[-1][1]
        if index.part[t] is not None:
            name = index.names[t]
            parts.setdefault(name, []).append((a, b, index.part[t], len(pairs)))
            aligned.setdefault(name, []).append([(i + index.part[t] * PART, j) for i, j in pairs])
        elif len(pairs) / index.total[t] >= index.needed(t, coverage) and index.tells(t, words, pairs):
            found.append((-len(pairs), -len(pairs) / index.total[t], index.names[t], a, b))
    for name, some in parts.items():
        template = index.whole[name]
        for _, chain in chains(some, template.size, min(coverage * template.size, PARTIAL) / 2):
            pairs = _filled(template, words, [p for i in chain for p in aligned[name][i]])
            dense = len(pairs) >= coverage * template.size or len(pairs) >= SPAN_SHARE * (pairs[-1][1] - pairs[0][1] + 1)
            if dense and len(pairs) >= min(coverage * template.size, PARTIAL) and not _another(index, template, words, pairs):
                found.append((-len(pairs), -len(pairs) / template.size, name, pairs[0][1], pairs[-1][1]))
    kept: list[tuple] = []
    for m in sorted(found):
        if all(m[4] < k[3] or m[3] > k[4] for k in kept):
            kept.append(m)
    if not kept:
        return []
    raw = (text or "").encode("utf-8", "surrogatepass")
    chars = lambda b: len(raw[:b].decode("utf-8", "surrogatepass"))
    return [(name, -share, -m, chars(starts[a]), chars(ends[b]), -m / (b - a + 1)) for m, share, name, a, b in sorted(kept, key=lambda k: k[3])]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license (the template), license_id, coverage (of the template), matched_words, start, end, span_coverage (of the
    words from start to end) of every match; ``templates``: name -> text, telling words in braces."""
    shared.bound_batches(docs.sparkSession)
    index = Index(license_texts.templates() if templates is None else templates)

    def run(it):
        for pdf in it:
            out = [(i, m[0], license_texts.identifier(m[0]), *m[1:]) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for m in scan_text(t, index, coverage)]
            yield pd.DataFrame(out, columns=["doc_id", "license", "license_id", "coverage", "matched_words", "start", "end", "span_coverage"])

    schema = "doc_id string, license string, license_id string, coverage double, matched_words long, start long, end long, span_coverage double"
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))  # as text on the way: a null would make numbers of others inexact
