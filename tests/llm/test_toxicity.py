"""Toxicity: features and scores against plain loops, gradients against differences, location and held-out accuracy."""

import math
import re

import numpy as np
import pytest

from scholia_spark.llm import queries, toxicity

M = 2**64 - 1


def mix(h):
    h ^= h >> 31
    h = h * 0x9E3779B97F4A7C15 & M
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 & M
    return h ^ (h >> 32)


def plain_sentences(text):
    """(start, end) in characters of the sentences that hold a word."""
    text = text or ""
    out, start = [], 0
    for m in re.finditer(r"[.!?](?=[ \t-\r])|\n|$", text):
        end = m.end() if m[0] else len(text)
        if re.search(r"[0-9A-Za-z\u0080-\U0010ffff]", text[start:end]):
            out.append((start, end))
        start = end
    return out


def plain_words(sentence):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), sentence)
    return set(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", low))


def plain_features(word):
    data = word.encode()
    part = lambda k: sum(int(toxicity._VALUE[b]) * int(toxicity._PLACE[i & 255]) for i, b in enumerate(data[:k])) & M
    hashes = [part(len(data)) + len(data)] + [part(k) + 1000 + k for k in toxicity.PREFIXES if len(data) > k]
    return [mix(h & M) >> (64 - toxicity.HASH_BITS) for h in hashes]


TEXTS = [None, "", "...", "You idiot! go.home. Now", "a\n\nb. Ärger überall? ja", "one two two ONE.", "x" * 5000 + ". tail", "no end", "é" * 9 + "!\n" + "中文 ok", "1.5 is fine. 2!"]


def test_scores_equal_plain_loops():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(1 << toxicity.HASH_BITS) + 1).astype(np.float32)
    weights[-1] = 0
    got = toxicity.score_texts(TEXTS, (weights, -1.0))
    for i, text in enumerate(TEXTS):
        found = plain_sentences(text)
        z = [-1.0 + sum(float(weights[f]) for w in plain_words(text[a:b]) for f in plain_features(w)) for a, b in found]
        assert got["n_sentences"][i] == len(found)
        assert got["score"][i] == pytest.approx(1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in z), abs=1e-6)
        if found:
            best = found[max(range(len(z)), key=lambda k: (round(z[k], 6), -k))]
            assert (got["worst_start"][i], got["worst_end"][i]) == best
        else:
            assert got.isna()["worst_start"][i]


def test_training_finds_the_sentence():
    """Labels say which texts are toxic; the weights must say which sentence is."""
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(60)]
    texts, y = [], []
    for i in range(300):
        parts = [" ".join(rng.choice(words, 6)) for _ in range(rng.integers(1, 9))]
        y.append(int(i % 3 == 0))
        if y[-1]:
            parts[rng.integers(len(parts))] += " nasty"
        texts.append(". ".join(parts) + ".")
    found = [toxicity.bags([t]) for t in texts]
    sizes = [np.bincount(f.sentence, minlength=f.start.size) for f in found]
    model = toxicity.train(sizes, [f.features for f in found], np.array(y), np.ones(len(y)))
    got = toxicity.score_texts(texts, model)
    assert ((got["score"] >= 0.5).astype(int) == np.array(y)).all()
    for i, text in enumerate(texts):
        if y[i]:
            assert "nasty" in text[got["worst_start"][i] : got["worst_end"][i]]


def test_offending_sentences(spark):
    df = spark.createDataFrame([(1, "Fine day. You nasty one! Bye."), (2, "Fine day."), (3, None), (4, "é nasty")], "doc_id long, text string")
    weights = np.zeros((1 << toxicity.HASH_BITS) + 1, np.float32)
    weights[plain_features("nasty")[0]] = 12
    rows = toxicity.offending(df, (weights, -6.0)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.sentence, r.text.strip()) for r in rows] == [(1, 1, "You nasty one!"), (4, 0, "é nasty")]


def test_no_labels_of_one_class(spark):
    df = spark.createDataFrame([(i, "bad text") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity_scores(df, labels).collect()} == {0}


def test_held_out_accuracy(spark):
    """On all of sf0.01, fitted outside the fold."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op12_toxicity_mil(spark, folder).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    pairs = [(a.score, b.score) for a in rows if a.toxic for b in rows if not b.toxic]
    assert sum(a > b for a, b in pairs) / len(pairs) > 0.9
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93
