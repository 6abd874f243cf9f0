"""N-gram Jaccard join: exact links and components at a Jaccard threshold over word shingles, by a prefix-tree join.

1. A map turns every whole text into its set of shingle hashes; texts with equal sets form a class, whose smallest doc_id
   stands for it. The same map reports shingles that are frequent within a chunk; the most frequent ones of the corpus
   go to the end of the global order (rare first, then by hash). The order only steers speed: any order gives all links.
2. Two sets that reach the threshold share a shingle within their prefixes, so only prefixes are dealt by shingle.
3. Stars: within each shingle and size band, everybody is paired with the smallest member. A parity bitmap per set bounds
   the symmetric difference from below and drops pairs that can't reach the threshold; the rest is joined exactly by
   the trie. This folds large groups of near copies into few components in linear work.
4. Rest: shingles that still span several components give the pairs between components, of neighbouring size bands, again
   through the bitmaps and the trie, in blocks of bounded size. Links within one component can't change it, so no component is lost.

The trie holds the globally ordered sets of a block; a probe descends it, shares the overlap of common paths, and leaves
a subtree once the overlap so far plus what can remain on either side stays below what its smallest set demands.

Shingle hashes have 64 bits; two different shingles count as one with a chance of about 2**-64 a pair.

Defined cases: null and word-less texts have the empty set, link with nothing and are components of their own; a text with
fewer than n words is one shingle, its whole sequence; a repeated doc_id is one node with the links of all its rows; rows
with a null doc_id get a null component; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia_spark.llm import shared
from scholia_spark.llm.components import connected_components
from scholia_spark.llm.textkit import batches, mix, ngram_hashes, tokenise

_U = np.uint64
#: Most frequent shingles kept for the global order (bounds a broadcast of 3.2 MB), and the chunk of shingles counted at once.
HEAVY = 200_000
CHUNK = 2_000_000
#: Share of all rows beyond which a class of equal sets is joined by broadcast.
HOT = 1 / 2000
#: Rows of a block in a pass over pairs, and sets of a trie.
BLOCK = 1024
TRIE_SETS = 64


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text."""
    hashes, counts = tokenise(texts)
    grams = ngram_hashes(hashes, n)
    out, at = [], 0
    for k in counts.tolist():
        if k >= n:
            out.append(np.unique(grams[at : at + k - n + 1]))
        elif k:
            h = np.array([k], _U)
            for i in range(at, at + k):
                h = mix(h ^ hashes[i : i + 1]) + hashes[i : i + 1]
            out.append(h)
        else:
            out.append(np.empty(0, _U))
        at += k
    return out


def _all_sets(pdf: pd.DataFrame, n: int) -> Iterator[tuple[int, np.ndarray]]:
    texts, ids = list(pdf["text"]), pdf["doc_id"].tolist()
    for a, b in batches(texts):
        yield from zip(ids[a:b], shingle_sets(texts[a:b], n), strict=True)


class Order:
    """Global order of shingles: those outside ``heavy`` by hash, then the heavy ones by count and hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        at = np.argsort(tokens)
        self.tokens, self.counts = tokens[at], counts[at]

    def weight(self, s: np.ndarray) -> np.ndarray:
        if not self.tokens.size:
            return np.zeros(s.size, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, s), self.tokens.size - 1)
        return np.where(self.tokens[at] == s, self.counts[at], 0)

    def sort(self, s: np.ndarray) -> np.ndarray:
        """``s``, sorted by hash, in the global order."""
        w = self.weight(s)
        return s[np.argsort(w, kind="stable")] if w.any() else s


def parity_bits(s: np.ndarray) -> np.ndarray:
    """Parity bitmap, as uint64 words, of at least as many bits as members: equal sets agree, each differing member flips one bit."""
    size = max(64, 1 << max(0, int(s.size - 1)).bit_length())
    counts = np.bincount(((s * _U(0x9E3779B97F4A7C15)) >> _U(20)).astype(np.int64) & (size - 1), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(_U)


def _least_difference(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Lower bounds of the symmetric difference of the sets behind the bitmaps; a longer bitmap is folded onto the shorter."""
    out = np.zeros(len(a), np.int64)
    shape: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        shape.setdefault((x.size, y.size), []).append(i)
    for (p, q), at in shape.items():
        x, y, w = np.stack([a[i] for i in at]), np.stack([b[i] for i in at]), min(p, q)
        x = np.bitwise_xor.reduce(x.reshape(len(at), -1, w), axis=1)
        y = np.bitwise_xor.reduce(y.reshape(len(at), -1, w), axis=1)
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _may_link(na: np.ndarray, nb: np.ndarray, bits_a: list[np.ndarray], bits_b: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """False only for pairs that can't reach num / den: |A n B| >= num / (num + den) * (|A| + |B|) bounds the difference."""
    total = na + nb
    return (num + den) * _least_difference(bits_a, bits_b) <= (den - num) * total


class Trie:
    """Path-compressed trie over sets of ranks, each ascending in the global order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        #: node: [segment, depth after it, smallest and largest set below, children, sets that end here]
        self.root = [np.empty(0, np.int64), 0, 0, 0, [], []]
        path, last = [self.root], np.empty(0, np.int64)
        for i in order:
            s = sets[i]
            m = min(s.size, last.size)
            differ = np.flatnonzero(s[:m] != last[:m])
            common = int(differ[0]) if differ.size else m
            while path[-1][1] > common:
                node = path.pop()
                if path[-1][1] < common:  # cut the segment where the paths part
                    cut = common - path[-1][1]
                    upper = [node[0][:cut], common, 0, 0, [node], []]
                    node[0] = node[0][cut:]
                    path[-1][4][-1] = upper
                    path.append(upper)
            if s.size > common or path[-1] is self.root:
                leaf = [s[common:], s.size, 0, 0, [], []]
                path[-1][4].append(leaf)
                path.append(leaf)
            path[-1][5].append(i)
            last = s
        self._sizes(self.root)

    def _sizes(self, root: list) -> None:
        todo, done = [root], []
        while todo:
            node = todo.pop()
            done.append(node)
            todo += node[4]
        for node in reversed(done):
            below = [c[2] for c in node[4]] + [node[1]] * bool(node[5])
            above = [c[3] for c in node[4]] + [node[1]] * bool(node[5])
            node[2], node[3] = min(below, default=0), max(above, default=0)

    def probe(self, x: np.ndarray, ranks: int, num: int, den: int) -> list[int]:
        """Sets whose Jaccard similarity with ``x`` is at least num / den."""
        member = np.zeros(ranks, np.int64)
        member[x] = 1
        out, todo = [], [(self.root, 0)]
        while todo:
            node, overlap = todo.pop()
            segment = node[0]
            left = x.size
            if segment.size:
                overlap += int(member[segment].sum())
                left = x.size - int(np.searchsorted(x, segment[-1], "right"))
            remaining = min(node[3] - node[1], left)
            if (num + den) * (overlap + remaining) < num * (x.size + node[2]):
                continue
            if node[5] and den * overlap >= num * (x.size + node[1] - overlap):
                out += node[5]
            todo += [(c, overlap) for c in node[4]]
        return out


def trie_links(probe: np.ndarray, sets: list[np.ndarray], order: Order, num: int, den: int) -> list[int]:
    """Places in ``sets`` (shingle hashes) that link with ``probe``, by a trie over the global order."""
    tokens = np.unique(np.concatenate([probe, *sets]))
    rank = np.empty(tokens.size, np.int64)
    rank[np.argsort(order.weight(tokens), kind="stable")] = np.arange(tokens.size)
    ranked = [np.sort(rank[np.searchsorted(tokens, s)]) for s in sets]
    return Trie(ranked).probe(np.sort(rank[np.searchsorted(tokens, probe)]), tokens.size, num, den)


def _read_sets(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: doc_id, size and 128-bit signature of each row; kind 1: shingles frequent in a chunk, with their counts."""

    def run(it):
        pending, size = [], 0

        def frequent():
            tokens, counts = np.unique(np.concatenate(pending), return_counts=True)
            at = counts >= 3
            return pd.DataFrame({"kind": np.ones(at.sum(), np.int32), "a": tokens[at].view(np.int64), "b": counts[at], "c": 0, "d": 0})

        for pdf in it:
            rows = []
            for i, s in _all_sets(pdf, n):
                sig = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                rows.append((0, i, s.size, sig[0], sig[1]))
                pending.append(s)
                size += s.size
                if size >= CHUNK:
                    yield frequent()
                    pending, size = [], 0
            yield pd.DataFrame(rows, columns=list("kind a b c d".split())).astype("int64")
        if pending:
            yield frequent()

    return docs.mapInPandas(run, "kind int, a long, b long, c long, d long")


def _prefixes(docs: DataFrame, n: int, num: int, den: int, order) -> DataFrame:
    def run(it):
        for pdf in it:
            rows = []
            for i, s in _all_sets(pdf, n):
                if s.size:
                    p = s.size - -(-num * s.size // den) + 1
                    rows.append((i, s.size, order.value.sort(s)[:p].view(np.int64), parity_bits(s).tobytes()))
            yield pd.DataFrame(rows, columns=["doc", "n", "prefix", "bits"])

    return docs.mapInPandas(run, "doc long, n long, prefix array<long>, bits binary")


def _sets_of(docs: DataFrame, wanted: DataFrame, n_wanted: int, n: int) -> DataFrame:
    def run(it):
        for pdf in it:
            yield pd.DataFrame([(i, s.tobytes()) for i, s in _all_sets(pdf, n)], columns=["doc", "tokens"])

    only = shared.keep_only(docs, wanted.withColumnRenamed("doc", "doc_id"), "doc_id", n_wanted)
    return only.mapInPandas(run, "doc long, tokens binary")


def _verified(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int, order, name: str) -> DataFrame:
    """The pairs (a, b) that link, by tries of bounded size: a probe a meets its partners in blocks."""
    wanted = shared.keep(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), f"{name}-wanted")
    sets = shared.keep(_sets_of(docs, wanted, wanted.count(), n), f"{name}-sets")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(float(TRIE_SETS))).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.expr("pmod(xxhash64(b), parts)").alias("part"))
    rows = dealt.select("a", "part", F.col("b").alias("doc")).union(dealt.select("a", "part", F.col("a").alias("doc")).distinct()).join(sets, "doc")

    def run(it):
        carry = None
        for pdf in it:
            pdf = pd.concat([carry, pdf], ignore_index=True) if carry is not None else pdf
            last = (pdf["a"] == pdf["a"].iloc[-1]) & (pdf["part"] == pdf["part"].iloc[-1]) if len(pdf) else []
            carry = pdf[last] if len(pdf) else None
            if len(pdf):
                yield linked(pdf[~last])
        if carry is not None:
            yield linked(carry)

    def linked(pdf):
        out = []
        for (a, _), g in pdf.groupby(["a", "part"], sort=False):
            tokens = [np.frombuffer(t, _U) for t in g["tokens"]]
            docs_ = g["doc"].tolist()
            for probe in [t for d, t in zip(docs_, tokens, strict=True) if d == a]:
                others = [(d, t) for d, t in zip(docs_, tokens, strict=True) if d != a]
                if others:
                    out += [(a, others[k][0]) for k in trie_links(probe, [t for _, t in others], order.value, num, den)]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    cut = rows.repartition("a", "part").sortWithinPartitions("a", "part").select("a", "part", "doc", "tokens")
    links = shared.keep(cut.mapInPandas(run, "u long, v long"), f"{name}-links")
    shared.forget(wanted)
    shared.forget(sets)
    return links


def _pairs_between(it: Iterator[pd.DataFrame], num: int, den: int) -> Iterator[pd.DataFrame]:
    """Pairs of different components within each (token, low, i, j) block that size and bitmaps allow, one of the two in band ``low``; rows come sorted by block."""
    carry = None
    keys = ["token", "low", "i", "j"]

    def found(pdf):
        key = pdf[keys].to_numpy()
        doc, n, comp, side, own = (pdf[c].to_numpy() for c in ("doc", "n", "component", "side", "own"))
        bits = [np.frombuffer(b, _U) for b in pdf["bits"]]
        out, k = [], 1
        while k < len(pdf):
            same = (key[k:] == key[:-k]).all(axis=1)
            if not same.any():
                break
            at = np.flatnonzero(same & (comp[k:] != comp[:-k]) & (den * np.minimum(n[k:], n[:-k]) >= num * np.maximum(n[k:], n[:-k])))
            at = at[((key[at, 2] == key[at, 3]) | (side[at] != side[at + k])) & (own[at] | own[at + k])]
            for c in range(0, at.size, 50_000):
                x = at[c : c + 50_000]
                y = x + k
                ok = _may_link(n[x], n[y], [bits[v] for v in x], [bits[v] for v in y], num, den)
                out.append(np.stack([np.minimum(doc[x], doc[y])[ok], np.maximum(doc[x], doc[y])[ok]], axis=1))
            k += 1
        got = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame(got, columns=["a", "b"])

    for pdf in it:
        pdf = pd.concat([carry, pdf], ignore_index=True) if carry is not None else pdf
        if not len(pdf):
            continue
        last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1)
        carry = pdf[last]
        yield found(pdf[~last])
    if carry is not None:
        yield found(carry)


def similarity_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link when den * |A n B| >= num * |A u B|."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = shared.keep(_read_sets(texts.where("doc_id IS NOT NULL"), n), "jaccard-read")
    rows = read.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("sig1"), F.col("d").alias("sig2"))
    heavy = read.where("kind = 1").groupBy("a").agg(F.sum("b").alias("b")).orderBy(F.desc("b"), "a").limit(HEAVY).toPandas()
    order = spark.sparkContext.broadcast(Order(heavy["a"].to_numpy(np.int64).view(_U), heavy["b"].to_numpy(np.int64)))

    classes = shared.keep(rows.where("n_shingles > 0").groupBy("sig1", "sig2").agg(F.min("doc_id").alias("doc"), F.count("*").alias("c")), "jaccard-classes")
    nodes = texts.where("doc_id IS NOT NULL")
    only = shared.keep(classes.select("doc").distinct(), "jaccard-nodes")
    prefixes = _prefixes(nodes, n, num, den, order)
    prefixes = shared.keep(shared.keep_only(prefixes, only, "doc", only.count()), "jaccard-prefixes")
    band = F.floor(F.log("n") / F.lit(float(np.log(den / num)) if num < den else 1.0)).alias("band")
    dealt = prefixes.select("doc", F.explode("prefix").alias("token"))  # two columns: these rows are shuffled
    common = dealt.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    dealt = dealt.join(common, "token").join(prefixes.select("doc", "n"), "doc")  # far fewer rows by now
    dealt = shared.keep(dealt.withColumn("band", band), "jaccard-dealt")
    shared.release(spark)

    bits = prefixes.select("doc", "n", "bits")

    @F.pandas_udf("boolean")
    def may(na: pd.Series, nb: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        ok = _may_link(na.to_numpy(), nb.to_numpy(), [np.frombuffer(x, _U) for x in a], [np.frombuffer(x, _U) for x in b], num, den)
        return pd.Series(ok)

    lead = dealt.groupBy("token", "band").agg(F.min("doc").alias("a"), F.count("*").alias("c")).where("c > 1").select("token", "band", "a")
    star = dealt.join(lead, ["token", "band"]).where("doc <> a").select("a", F.col("doc").alias("b")).distinct()
    of = lambda x: bits.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    star = star.join(of("a"), "a").join(of("b"), "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    star = shared.keep(star.where(may("na", "nb", "bitsa", "bitsb")).select("a", "b").distinct(), "jaccard-star")
    links = _verified(nodes, star, n, num, den, order, "jaccard-star")
    shared.release(spark)
    first = shared.keep(connected_components(links, "jaccard-first"), "jaccard-first")

    labelled = dealt.join(first, dealt["doc"] == first["node"], "left").select("token", "band", "doc", "n", F.coalesce("component", "doc").alias("component"))
    # sets that link are of one band or of bands that follow each other: a pair meets at its lower band
    labelled = labelled.withColumn("low", F.explode(F.array("band", F.col("band") - 1))).withColumn("own", F.col("low") == F.col("band")).drop("band")
    open_ = labelled.groupBy("token", "low").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("own").alias("any"), F.count("*").alias("c")).where("x <> y AND any")
    open_ = open_.select("token", "low", F.ceil(F.col("c") / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    rest = labelled.join(open_, ["token", "low"]).join(prefixes.select("doc", "bits"), "doc").withColumn("block", F.expr("cast(pmod(xxhash64(doc), blocks) as int)"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("token", "low", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("side"), "own", "doc", "n", "component", "bits")
    rest = rest.repartition("token", "low", "i", "j").sortWithinPartitions("token", "low", "i", "j", "n")
    pairs = shared.keep(rest.mapInPandas(lambda it: _pairs_between(it, num, den), "a long, b long").distinct(), "jaccard-rest")
    shared.release(spark)
    more = _verified(nodes, pairs, n, num, den, order, "jaccard-rest")
    # an id with several texts ties their classes together
    several = rows.groupBy("doc_id").agg(F.min("sig1").alias("x"), F.max("sig1").alias("y")).where("x <> y").select("doc_id")
    ties = rows.join(several, "doc_id").join(classes, ["sig1", "sig2"]).where("doc <> doc_id").select(F.col("doc").alias("u"), F.col("doc_id").alias("v"))
    final = shared.keep(connected_components(links.union(more).union(ties), "jaccard-final"), "jaccard-final")

    named = classes.join(final, classes["doc"] == final["node"], "left").select("sig1", "sig2", "c", F.coalesce("component", "doc").alias("component_id"))
    named = shared.keep(named, "jaccard-named")
    total = rows.count()
    hot, cold = (named.where(F.expr(f"c {sign} {HOT * total}")).drop("c") for sign in (">", "<="))
    full = rows.where("n_shingles > 0")
    spread = full.join(F.broadcast(hot), ["sig1", "sig2"])  # at most 1 / HOT classes: copies of one text needn't meet in a task
    others = full.join(F.broadcast(hot), ["sig1", "sig2"], "left_anti").join(cold, ["sig1", "sig2"])
    bare = rows.where("n_shingles = 0").join(final, F.col("doc_id") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    out = shared.keep(spread.select(columns).union(others.select(columns)).union(bare.select(columns)), "jaccard-out")
    for used in (read, classes, only, prefixes, dealt, star, links, first, pairs, more, final, named):
        shared.forget(used)
    lost = texts.where("doc_id IS NULL").mapInPandas(
        lambda it: (pd.DataFrame({"n_shingles": [s.size for _, s in _all_sets(p, n)]}) for p in it), "n_shingles long"
    )
    return out.union(lost.select(F.lit(None).cast("long"), "n_shingles", F.lit(None).cast("long")))


def deduplicate(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id; of repeated rows of that id, one. Rows without a doc_id stay."""
    kept = similarity_classes(docs, n, num, den).where("doc_id = component_id").select("doc_id").distinct()
    same = docs.columns
    ids = shared.keep(kept, "dedup-ids")
    out = shared.keep_only(docs.where("doc_id IS NOT NULL"), ids.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "doc_id", ids.count())
    one = Window.partitionBy("doc_id").orderBy(*[F.xxhash64(*same)])
    repeated = out.groupBy("doc_id").count().where("count > 1").select("doc_id")
    place = shared.fresh(docs, "place")
    first = out.join(repeated, "doc_id", "left_semi").withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).drop(place)
    return out.join(repeated, "doc_id", "left_anti").unionByName(first).unionByName(docs.where("doc_id IS NULL")).select(*same)
