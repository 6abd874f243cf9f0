"""Ranked lexical search against a plain loop over documents and items."""

import math
import random
import re
from collections import Counter

import pytest

from scholia_spark.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, terms in wanted.items():
        found = []
        for doc, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // length if length else 50
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0 and doc is not None:
                found.append((-score, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def run(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in search.search(d, i, **how).collect())


def made(seed, n):
    rnd = random.Random(seed)
    words = ["a", "B", "c3", "é", "É", "näh", "x_y", "中文", "w\0z", "k9"] + [f"w{i}" for i in range(30)]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 3, 9, 40]))) for _ in range(n // 3)]
    docs = [(i if rnd.random() < 0.97 else None, rnd.choice([None, "", "!?", *texts])) for i in range(n)]
    rnd.shuffle(docs)
    items = [(j, rnd.choice(texts + ["", "...", "never here"])) for j in range(12)] + [(3, "w1 w2"), (None, "w1"), (99, None)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_loop(spark, seed):
    docs, items = made(seed, 300)
    assert run(spark, docs, items, k=7) == plain_search(docs, items, 7)


def test_items_in_blocks(spark):
    docs, items = made(3, 120)
    assert run(spark, docs, items, k=5, most_items=4, most_bytes=200) == plain_search(docs, items, 5)


def test_a_large_class_and_ties(spark):
    """A third of the rows are copies of one text, and other texts tie with them."""
    docs = [(i, "alpha beta" if i % 3 == 0 else "alpha gamma" if i % 3 == 1 else f"delta {i}") for i in range(600)]
    items = [(1, "alpha"), (2, "beta delta"), (3, "alpha alpha beta 5")]
    assert run(spark, docs, items) == plain_search(docs, items, 50)


def test_pieces_of_long_texts():
    text = "ab " * 900_000 + "Zé9" * 700_000 + " end"
    assert [t.decode() for part in search.terms_of(text) for t in part] == plain_terms(text)


def test_classes_of_one_hash_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs, items = made(4, 200)
    real = search.with_class
    monkeypatch.setattr(search, "with_class", lambda kept, stats: real(kept, stats).withColumn("h", F.lit(7).cast("long")))
    assert run(spark, docs, items, k=5) == plain_search(docs, items, 5)


def test_scores_beyond_exact_doubles(monkeypatch):
    import numpy as np
    import pandas as pd

    block = search.Block.of([{"item_id": 1, "terms": [b"a", b"b"]}, {"item_id": 2, "terms": [b"b"]}])
    bag = pd.Series([np.array([[0, 3], [1, 2]], np.uint32).tobytes(), np.array([[1, 1]], np.uint32).tobytes()])
    m = np.array([100, 70])
    small = search.score_block(bag, m, np.array([5, 9]), block)
    large = search.score_block(bag, m, np.array([5, 9]) * 10**9, block)
    assert (large == small * 10**9).all()
