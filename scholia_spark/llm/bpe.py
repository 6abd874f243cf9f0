"""BPE encoding and decoding with a public vocabulary file (tokenizers JSON of the word-end kind).

Encoding of a word: its byte symbols stand in a doubly linked list; a heap holds (merge rank, place) of adjacent pairs;
entries whose pair has changed meanwhile are stale and skipped. Decoding concatenates vocabulary strings (with the blank
that the format's missing decoder puts between tokens). Words repeat, so a worker keeps a bounded table of encoded words.

Defined cases: a null text is the empty text (no ids, empty decoding); special tokens that stand in a text are encoded as
themselves, as the library does by default; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia_spark.llm import shared

CACHE_WORDS = 120_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Bpe:
    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + self.suffix) for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.strings = {i: s for s, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.strings.update({i: s for s, i in special.items()})
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.word_re = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.words: dict[str, tuple[int, str, str]] = {}

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        n, merges = len(ids), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] is None or j < 0 or merges.get((ids[i], ids[j]), (-1, -1))[0] != rank:
                continue  # stale: one of the two symbols has been merged away or changed
            ids[i], ids[j] = new, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return [x for x in ids if x is not None]

    def decode(self, ids: list[int]) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in ids])

    def _word(self, word: str) -> tuple[int, str, str]:
        ids = self.encode_word(word)
        got = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        self.words[word] = got
        return got

    def _segments(self, text: str):
        if self.special_re is None or "<|" not in text:
            yield text, False
            return
        for k, part in enumerate(self.special_re.split(text)):
            if part:
                yield part, bool(k % 2)

    def pieces(self, text: str | None) -> list[tuple[int, str, str]]:
        """(tokens, ids as text, decoded) of each word of a whole text."""
        out, words = [], self.words
        for part, special in self._segments(text or ""):
            if special:
                out.append((1, str(self.special[part]), part))
                continue
            part = part if part.isascii() else unicodedata.normalize("NFC", part)
            if "Σ" in part:  # lower-cased character by character: no final sigma
                part = part.replace("Σ", "σ")
            for w in self.word_re.findall(part.lower()):
                out.append(words.get(w) or self._word(w))
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for p in self.pieces(text) for i in p[1].split(" ")]


_LOADED: dict[str, Bpe] = {}


def load(content: bytes) -> Bpe:
    """The vocabulary of a file's content, once a worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(json.loads(content))
    return _LOADED[key]


def _shipped(docs: DataFrame, path: str):
    """The vocabulary file (a few MB), read by the driver and broadcast: workers need no path of their own."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every row (general interface)."""
    shared.bound_batches(docs.sparkSession)
    shipped = _shipped(docs, path)

    def run(it):
        bpe = load(shipped.value)
        for pdf in it:
            ids = [bpe.encode(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": pd.Series(ids, dtype=object), "decoded": [bpe.decode(x) for x in ids]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str, with_ids: bool = False, keep_words: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; ``with_ids`` adds ids array<int>. Without ``keep_words`` a worker
    drops its table of encoded words at the end of a task, for jobs whose other stages need the memory."""
    shared.bound_batches(docs.sparkSession)
    shipped = _shipped(docs, path)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]

    def digest(text):
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(it):
        bpe = load(shipped.value)
        for pdf in it:
            rows, ids = [], []
            for t in pdf["text"]:
                p = bpe.pieces(t)
                said = " ".join([x[1] for x in p])
                rows.append((sum([x[0] for x in p]), digest(said), digest(" ".join([x[2] for x in p]))))
                if with_ids:
                    ids.append(np.array(said.split(" ") if said else [], np.int32))
            out = pd.DataFrame({"doc_id": pdf["doc_id"]}).assign(**{c: [r[k] for r in rows] for k, c in enumerate(names)})
            yield out.assign(ids=pd.Series(ids, dtype=object)) if with_ids else out
        if not keep_words:
            bpe.words.clear()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema)
