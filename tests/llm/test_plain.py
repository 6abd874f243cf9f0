"""The quality classifier and the whole pipeline against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from test_findings import plain_leaks

from scholia_spark.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain_grams(text):
    """Indicators as tuples: words and pairs of them, and runs of one to three marked shapes."""
    w = words(text)
    squeezed = re.sub(r"a+", "a", re.sub(r"0+", "0", re.sub(r"Z+", "Z", "".join("a" if c.islower() or ord(c) > 127 else "Z" if c.isupper() else "0" if c.isdigit() else c for c in text))))
    shapes = [(x.lower(),) for x in WORD.findall(squeezed)]  # capitals and lower case are one here, but not one run
    assert len(shapes) == len(w)
    seen, marked = set(), []
    for i, s in enumerate(shapes):
        again = i > 0 and w[i] == w[i - 1]
        three = tuple(w[i : i + 3])
        old = len(three) == 3 and three in seen
        seen.add(three)
        marked.append((s, again, old))
    out = {("w", *w[i : i + 1]) for i in range(len(w))} | {("w", *w[i : i + 2]) for i in range(len(w) - 1)}
    for n in (1, 2, 3):
        out |= {("s", n, *marked[i : i + n]) for i in range(len(w) - n + 1)}
    return out


def test_indicators_are_those_of_plain_grams():
    r = random.Random(7)
    bits = ["The", "cat", "sat,", "42", "4.5!", "NASA", "x", "cat", "on-off", "(a)", "Zoë"]
    texts = [" ".join(r.choices(bits, k=r.randrange(1, 14))) for _ in range(40)]
    have = [set(quality.indicators(t).tolist()) for t in texts]
    want = [plain_grams(t) for t in texts]
    for i in range(len(texts)):
        assert len(have[i]) == len(want[i])
        for j in range(i):
            assert len(have[i] & have[j]) == len(want[i] & want[j])
    assert not quality.indicators(None).size and not quality.indicators(" \n").size


def test_ratios_and_the_hinge_model(monkeypatch):
    monkeypatch.setattr(quality, "HASH_BITS", 6)
    r = random.Random(3)
    rows = [np.array(sorted(r.sample(range(64), r.randrange(3, 20)))) for _ in range(80)]
    y = np.array([1.0 if 3 in x or (5 in x and 9 not in x) else -1.0 for x in rows])
    count = {s: collections.Counter(f for x, t in zip(rows, y, strict=True) if t == s for f in x.tolist()) for s in (1.0, -1.0)}
    total = {s: sum(c.values()) + 64 for s, c in count.items()}
    ratios = quality.log_count_ratios(rows, y)
    assert all(math.isclose(ratios[f], math.log((count[1.0][f] + 1) / total[1.0]) - math.log((count[-1.0][f] + 1) / total[-1.0])) for f in range(64))
    c = 0.1
    weights, bias = quality.dual_coordinate_descent(rows, y, ratios, c=c, epochs=3000)
    w = np.divide(weights, ratios, out=np.zeros(64), where=ratios != 0)

    def primal(w, b):
        return (w @ w + b * b) / 2 + c * sum(max(0.0, 1 - t * (w[x] @ ratios[x] + b)) for x, t in zip(rows, y, strict=True))

    # plain subgradient steps on the same objective come no lower, and stepping away from the solution raises it
    best, v, b = primal(np.zeros(64), 0.0), np.zeros(64), 0.0
    for step in range(1, 3001):
        gv, gb = v.copy(), b
        for x, t in zip(rows, y, strict=True):
            if t * (v[x] @ ratios[x] + b) < 1:
                gv[x] -= c * t * ratios[x]
                gb -= c * t
        v, b = v - gv / step, b - gb / step
        best = min(best, primal(v, b))
    found = primal(w, bias)
    assert found <= best + 1e-3 and abs(found - best) < 0.02 * best
    rng = np.random.default_rng(0)
    assert all(primal(w + 0.05 * rng.normal(size=64), bias + 0.05 * rng.normal()) > found for _ in range(50))


def test_scores_are_sums_of_weights(spark):
    weights = np.random.default_rng(1).normal(size=1 << quality.HASH_BITS).astype(np.float32)
    texts = ["a b c", "The The 42 cats", "", None, "x " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.classify(docs, (weights, 0.25)).collect()}
    for i, t in enumerate(texts):
        margin = 0.25 + sum(float(weights[k]) for k in quality.indicators(t).tolist())
        assert math.isclose(got[i]["score"], 1 / (1 + math.exp(-2 * max(-40, min(40, margin)))), rel_tol=1e-6) and got[i]["predicted"] == (got[i]["score"] >= 0.3)


def test_labels_of_the_held_out_fold_change_nothing(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = labels.select("doc_id", "quality").collect()
    held = {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    turned = spark.createDataFrame([(r["doc_id"], 1 - r["quality"] if r["doc_id"] in held else r["quality"]) for r in rows], "doc_id long, quality int")
    score = lambda x: {r["doc_id"]: (r["score"], r["held_out"]) for r in quality.quality_scores(docs, x).collect()}
    assert held and score(labels) == score(turned)
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, (_, h) in score(labels).items())


def near_duplicates(texts):
    """ids kept by a plain version: links at Jaccard >= 0.8 of 5-word shingles, the smallest id of each component."""
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label, of = {i: i for i in texts}, collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            of[g].append(i)
    links = set()
    for i, s in sets.items():
        shared = collections.Counter(j for g in s for j in of[g] if j < i)
        links |= {(i, j) for j, n in shared.items() if 100 * n >= 80 * (len(s) + len(sets[j]) - n)}
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return {i for i in texts if label[i] == i}


@pytest.mark.parametrize("extra", [False, True])
def test_pipeline_equals_plain_stages(spark, sf_dir, tmp_path, extra):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = sf_dir
    if extra:  # names that the stages use themselves
        folder = str(tmp_path)
        for name in ("score", "_score", "predicted", "_id", "_h", "_key", "_place"):
            docs = docs.withColumn(name, docs["source"])
        docs.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    weights, bias = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {i: t for i, t in texts.items() if quality.score_texts([t], weights, bias)[0] >= 0.3}
    kept = near_duplicates(good)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {d for d, _ in plain_leaks([(i, texts[i]) for i in kept], items)}
    assert set(got) == kept - leaked and leaked and len(kept) < len(good) < len(texts)
    t = Tokenizer.from_file(queries.vocabulary())
    for i, r in got.items():
        ids = t.encode(texts[i] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
