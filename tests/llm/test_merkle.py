"""The Merkle manifest against plain trees, and the queue against a sorted list."""

import hashlib
import random
import zlib

import pytest

from scholia_spark.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def siblings(levels, i):
    for nodes in levels[:-1]:
        run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(nodes)))
        yield [nodes[k] for k in run if k < i], [nodes[k] for k in run if k > i]
        i //= 3


def plain_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for members in by_source.values():
        members.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    trees = {s: tree([plain_leaf(r) for r in by_source[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            proof = [*siblings(trees[s], i), *siblings(top, place)]
            odd = dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                odd["text"] = r["text"].replace("\n", "")
            now = plain_leaf(odd)
            for left, right in proof:
                now = H(*left, now, *right)
            root = top[-1][0]
            out.append((r["doc_id"], plain_leaf(r), trees[s][-1][0], root, H(*(x for left, right in proof for x in left + right)), now, now == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def run(spark, rows):
    return sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def made(seed, n, sources):
    rnd = random.Random(seed)
    return [
        {"doc_id": rnd.choice([None, 1, 2**60 + i, i]), "source": rnd.choice(sources), "lang": rnd.choice([None, "de"]), "n_chars": rnd.choice([None, 3]), "text": rnd.choice([None, "", "a\nb", "\n", f"é{i}\n"])}
        for i in range(n)
    ]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10, 28])
def test_small_tables(spark, n):
    rows = made(n, n, [None, "", "a"])
    assert run(spark, rows) == (plain_manifest(rows) if rows else [])


def test_blocks_and_tiers(spark):
    """One source spans blocks (729 leaves each), and so do the subroots."""
    rows = made(7, 2_600, ["hot", "hot", *(f"s{i}" for i in range(1_500))])
    assert run(spark, rows) == plain_manifest(rows)


def test_one_source_and_repeated_rows(spark):
    rows = made(9, 40, ["only"]) * 2
    assert run(spark, rows) == plain_manifest(rows)


def test_queue_spills():
    rnd = random.Random(3)
    queue, held, out, want = merkle.ExternalQueue(most=8), [], [], []
    for i in range(2_000):
        if held and rnd.random() < 0.45:
            assert queue.first() == held[0][0]
            out.append(queue.pop())
            want.append(held.pop(0)[1])
        else:
            label = (rnd.randrange(50), rnd.randrange(3))
            queue.push(label, i)
            held.append((label, i))
            held.sort()
    while queue.first() is not None:
        out.append(queue.pop())
        want.append(held.pop(0)[1])
    assert out == want and not held


@pytest.mark.parametrize("m", [1, 2, 3, 5, 9, 10, 27, 100])
def test_sweeps_with_a_spilling_queue(m):
    digests = [H(str(i)) for i in range(m)]
    levels = tree(digests)
    done = merkle.sweep_up(digests, merkle.height(m), most=2)
    assert done[-1][2] == levels[-1][0]
    for place, proof in merkle.sweep_down(done, m, None, most=2):
        assert merkle.fold(digests[place], proof) == (levels[-1][0], H(*(x for left, right in siblings(levels, place) for x in left + right)))
