"""Phrases as runs of tokens, against plain lists; vector neighbours over many blocks."""

import random

import numpy as np
import pytest

from scholia_spark.operators import retrieval


def holds(needle, hay):
    return any(hay[i : i + len(needle)] == needle for i in range(len(hay) - len(needle) + 1))


def test_no_part_of_a_word_is_a_hit(spark):
    queries = spark.createDataFrame([(1, ["cat", "sat"]), (2, ["cat"]), (3, []), (4, None), (5, ["cat", None]), (6, ["x", "x", "x"])], "query_id int, phrase array<string>")
    texts = ["a bobcat sated x", "the cat sat", "cat", "sat cat", "x x x x", "x x", None, ""]
    chunks = spark.createDataFrame([(i, i, t.split() if t is not None else None) for i, t in enumerate(texts)], "chunk_id int, paper_id int, tokens array<string>")
    got = {(r["query_id"], r["chunk_id"]) for r in retrieval.phrase_match(queries, chunks).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (2, 3), (6, 4)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_equal_plain_lists(spark, seed):
    rnd = random.Random(seed)
    words = list("abcde")
    texts = [rnd.choices(words + [None] * (seed == 3), k=rnd.choice([0, 1, 2, 5, 30])) for _ in range(150)]
    other = [rnd.choices(words, k=rnd.choice([0, 3])) for _ in texts]
    phrases = [rnd.choices(words, k=rnd.choice([1, 1, 2, 2, 3, 4, 6])) for _ in range(40)]
    narrow = [(rnd.choice([None, rnd.sample(range(150), 60)]), rnd.choice([None, 2003]), rnd.choice([None, 2006])) for _ in phrases]
    queries = spark.createDataFrame([(i, p, *n) for i, (p, n) in enumerate(zip(phrases, narrow))], "query_id int, phrase array<string>, paper_ids array<int>, since int, until int")
    chunks = spark.createDataFrame([(i, i, 2000 + i % 10, t, o) for i, (t, o) in enumerate(zip(texts, other))], "chunk_id int, paper_id int, year int, tokens array<string>, abstract array<string>")
    got = {(r["query_id"], r["chunk_id"]) for r in retrieval.phrase_match(queries, chunks, 1000, ("tokens", "abstract")).collect()}
    fits = lambda i, n: (n[0] is None or i in n[0]) and (n[1] is None or 2000 + i % 10 >= n[1]) and (n[2] is None or 2000 + i % 10 <= n[2])
    assert got == {(q, c) for q, (p, n) in enumerate(zip(phrases, narrow)) for c in range(150) if fits(c, n) and (holds(p, texts[c]) or holds(p, other[c]))}


def test_best_chunk_of_a_paper_and_k(spark):
    queries = spark.createDataFrame([(1, ["a", "b"])], "query_id int, phrase array<string>")
    chunks = spark.createDataFrame([(i, i // 3, ["a", "b"]) for i in range(30)], "chunk_id int, paper_id int, tokens array<string>")
    got = retrieval.phrase_match(queries, chunks, 4).orderBy("rank").collect()
    assert [(r.paper_id, r.chunk_id) for r in got] == [(0, 0), (1, 3), (2, 6), (3, 9)]


def test_neighbours_over_many_blocks(spark):
    """Batches of few rows, equal vectors and a vector without length; k rows a query leave a task at most."""
    rng = np.random.default_rng(5)
    vectors = [v.tolist() for v in rng.integers(-2, 3, size=(400, 6)).astype(float)]
    vectors[7] = [0.0] * 6
    chunks = spark.createDataFrame([(i, i // 2, v if i % 50 else None) for i, v in enumerate(vectors)], "chunk_id int, paper_id int, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(q, vectors[q * 3 + 1]) for q in range(9)] + [(99, None)], "query_id int, vector array<double>")
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    want = set()
    for q in range(9):
        scores = sorted((-round(float(unit(vectors[q * 3 + 1]) @ unit(v)), 9), i) for i, v in enumerate(vectors) if i % 50)[:10]
        best = {}
        for s, i in scores:
            best.setdefault(i // 2, (q, i))
        want |= set(best.values())
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "16")
        got = retrieval.knn(queries, chunks, 10)
        assert {(r["query_id"], r["chunk_id"]) for r in got.collect()} == want
    finally:
        spark.conf.set(name, before)


def test_rows_out_of_a_task():
    import pandas as pd

    rows = pd.DataFrame({"q": [0, 0, 0, 1], "score": [0.5, 0.9, 0.9, 0.1], "chunk_id": ["b", "d", "c", "z"], "paper_id": list("abcd")})
    assert retrieval._best(rows, 2)["chunk_id"].tolist() == ["c", "d", "z"]
