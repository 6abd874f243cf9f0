"""Merkle manifest of a dataset, with a proof for every row, by time-forward processing.

Leaves are ordered by source and doc_id; runs of ``FAN`` nodes are hashed into their parent until each source has one node,
and the sources' nodes likewise become the root. A node's label is its last leaf and its level, so labels in ascending order
are children before parents: a node is processed when its label comes up, takes its children's digests from a priority queue
ordered by label and sends its own digest to its parent's label. In the reversed sweep labels descend: the root's proof
suffix is empty, and each node sends its children their siblings in front of its own suffix. Queues hold the messages of open
ancestors only and spill sorted runs to the task's scratch files beyond ``MOST_HELD``.

At scale the labels are cut into blocks, subtrees of ``LEVELS`` levels, so one task never has a source to itself: a block's
digest is a row that Spark's shuffle delivers, sorted by label, to the tier above, and its proof suffix comes back the same way.
A tier divides the nodes by FAN ** LEVELS, so four tiers do for 10^11 rows. Texts are read once, for leaf digests; all
that is shuffled has a few hundred bytes a row, and a block's suffix is one row.

Defined cases: null columns are ``-``; rows of one source and doc_id follow by their leaf digest; a null source is a source of
its own, before all others; a row without a doc_id comes first in its source and is never tampered with; a table without rows
has no root and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia_spark.llm import shared

FAN, LEVELS = 3, 6
MOST_HELD = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class ExternalQueue:
    """A priority queue that holds at most ``most`` entries; beyond it the later half becomes a sorted run in a scratch file."""

    def __init__(self, most: int = MOST_HELD):
        self.most, self.heap, self.heads, self.number = most, [], [], count()

    def push(self, label: tuple, message) -> None:
        heapq.heappush(self.heap, (label, next(self.number), message))
        if len(self.heap) > self.most:
            self.heap.sort()
            keep = len(self.heap) // 2
            run = tempfile.TemporaryFile()
            for entry in self.heap[keep:]:
                pickle.dump(entry, run)
            del self.heap[keep:]
            run.seek(0)
            self._advance(run)

    def _advance(self, run) -> None:
        try:
            entry = pickle.load(run)
        except EOFError:
            run.close()
            return
        heapq.heappush(self.heads, (*entry[:2], entry[2], run))

    def first(self) -> tuple | None:
        """The least label, or None."""
        ends = [h[0][:2] for h in (self.heap, self.heads) if h]
        return min(ends)[0] if ends else None

    def pop(self):
        """The message of the least label; of equal labels the one sent first."""
        if self.heads and (not self.heap or self.heads[0][:2] < self.heap[0][:2]):
            _, _, message, run = heapq.heappop(self.heads)
            self._advance(run)
            return message
        return heapq.heappop(self.heap)[2]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def height(n: int) -> int:
    """Levels above n nodes until one remains."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def _label(level: int, j: int, m: int) -> tuple[int, int]:
    """Of the j-th node of a level over m leaves."""
    return min((j + 1) * FAN**level, m) - 1, level


def sweep_up(digests: list[str], levels: int, most: int = MOST_HELD) -> list[tuple[int, int, str, list[str]]]:
    """(level, place, digest, children) of every node in label order, up to the one node ``levels`` above; it is the last."""
    m, queue, done = len(digests), ExternalQueue(most), []

    def send(level: int, j: int, own: str, children: list[str]) -> None:
        done.append((level, j, own, children))
        if level < levels:
            queue.push(_label(level + 1, j // FAN, m), (j // FAN, own))

    for i, own in enumerate(digests):
        send(0, i, own, [])
        while (label := queue.first()) is not None and label[0] == i:
            j, children = 0, []
            while queue.first() == label:
                j, child = queue.pop()
                children.append(child)
            send(label[1], j, digest("".join(children)), children)
    return done


def sweep_down(done: list[tuple[int, int, str, list[str]]], m: int, suffix, most: int = MOST_HELD) -> Iterator[tuple[int, tuple]]:
    """(place, proof) of every leaf, last to first. A proof is a chain of (left, right, rest) from the leaf to the root;
    ``suffix`` is that of the topmost node."""
    queue = ExternalQueue(most)
    for level, j, _, children in reversed(done):
        own = queue.pop() if queue.first() is not None else suffix
        if level == 0:
            yield j, own
        for k, _ in enumerate(children):
            last, at = _label(level - 1, j * FAN + k, m)
            queue.push((-last, -at), ("".join(children[:k]), "".join(children[k + 1 :]), own))


def fold(leaf: str, proof: tuple | None) -> tuple[str, str]:
    """The root that a leaf and its siblings give, and the digest of the siblings."""
    now, siblings = leaf, []
    while proof:
        left, right, proof = proof
        now = digest(left + now + right)
        siblings += (left, right)
    return now, digest("".join(siblings))


def _packed(proof: tuple | None) -> str:
    parts = []
    while proof:
        left, right, proof = proof
        parts.append(f"{left}|{right};")
    return "".join(parts)


def _unpacked(text: str) -> tuple | None:
    proof = None
    for part in reversed(text.split(";")[:-1]):
        proof = (*part.split("|"), proof)
    return proof


def leaf_digest(text: Column) -> Column:
    """H over the five columns, with ``text`` in the place of the text."""
    parts = []
    for name in FIELDS:
        value = text if name == "text" else F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """grp (the source as a key that sorts null first), name (the doc_id as text, so that nulls leave others whole in pandas),
    digest, and the digest of the tampered row where it differs."""
    text = F.col("text").cast("string")
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    grp = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    return docs.select(
        grp.alias("grp"), F.col("doc_id").cast("string").alias("name"), leaf_digest(text).alias("digest"),
        F.when(chosen, leaf_digest(F.replace(text, F.lit("\n"), F.lit("")))).alias("tampered"),
    )


def numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """``nodes`` with idx (place in its grp by ``order``) and n (nodes of the grp): a range shuffle, places within each
    partition, and the offsets of the partitions, of which there is a row a partition and grp."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now, at = TaskContext.get().partitionId(), None, 0
        for pdf in it:
            places = []
            for grp in pdf["grp"]:
                now, at = grp, at + 1 if grp == now else 0
                places.append(at)
            yield pdf.assign(part=part, place=places)

    shared.bound_batches(nodes.sparkSession)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + ", part int, place long"
    placed = shared.keep(nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).mapInPandas(run, schema), "merkle-placed")
    counts = placed.groupBy("grp", "part").agg(F.count("*").alias("c"))
    by_grp = Window.partitionBy("grp")
    offsets = counts.select("grp", "part", (F.sum("c").over(by_grp.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(by_grp).alias("n"))
    out = placed.join(offsets, ["grp", "part"]).select(*nodes.columns, (F.col("before") + F.col("place")).alias("idx"), "n")
    out = shared.keep(out, "merkle-nodes")
    shared.forget(placed)
    return out


def _blocks(nodes: DataFrame) -> DataFrame:
    """Rows of a block lie together, in order."""
    block = F.floor(F.col("idx") / F.lit(FAN**LEVELS)).cast("long")
    return nodes.withColumn("block", block).repartition("grp", "block").sortWithinPartitions("grp", "block", "idx")


def _each_block(it: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], list]]:
    """(grp, block) and its rows, over the batches of a sorted partition."""
    key, rows = None, []
    for pdf in it:
        for row in pdf.itertuples(index=False):
            if (row.grp, row.block) != key:
                if rows:
                    yield key, rows
                key, rows = (row.grp, row.block), []
            rows.append(row)
    if rows:
        yield key, rows


def _frames(rows: Iterator[tuple], names: list[str], most: int = 2_000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def _tier_above(nodes: DataFrame) -> DataFrame:
    """The topmost node of every block: grp, idx, n, digest."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[tuple]:
            for (grp, block), rows in _each_block(it):
                n = int(rows[0].n)
                top = sweep_up([r.digest for r in rows], min(LEVELS, height(n)))[-1][2]
                yield grp, block, -(-n // FAN**LEVELS), top

        yield from _frames(each(), ["grp", "idx", "n", "digest"])

    return _blocks(nodes.select("grp", "idx", "n", "digest")).mapInPandas(run, "grp string, idx long, n long, digest string")


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """The nodes and the tiers above them, until each grp has one node."""
    out = [nodes]
    most = nodes.agg(F.max("n")).head()[0] or 0
    while most > 1:
        out.append(shared.keep(_tier_above(out[-1]), "merkle-tier"))
        most = -(-most // FAN**LEVELS)
    return out


def _messages(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes, and before those of a block the row with the suffix and subroot that come to it from ``above`` (grp, idx, suffix, subroot)."""
    sent = above.select("grp", (F.col("idx") * FAN**LEVELS).alias("idx"), "suffix", "subroot", F.lit(0).alias("kind"))
    both = nodes.withColumn("kind", F.lit(1)).unionByName(sent, allowMissingColumns=True)
    block = F.floor(F.col("idx") / F.lit(FAN**LEVELS)).cast("long")
    return both.withColumn("block", block).repartition("grp", "block").sortWithinPartitions("grp", "block", "kind", "idx")


def _tier_proofs(it: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(row, proof, subroot) of every node, block by block."""
    for _, (head, *rows) in _each_block(it):
        done = sweep_up([r.digest for r in rows], min(LEVELS, height(int(rows[0].n))))
        for j, proof in sweep_down(done, len(rows), _unpacked(head.suffix)):
            yield rows[j], proof, head.subroot


def _sent_down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """grp, idx, suffix, subroot of every node of a tier."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(((r.grp, r.idx, _packed(proof), subroot) for r, proof, subroot in _tier_proofs(it)), ["grp", "idx", "suffix", "subroot"])

    return _messages(nodes, above).mapInPandas(run, "grp string, idx long, suffix string, subroot string")


def _descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """What comes to the blocks of the lowest tier; ``above``: to the one node of each grp."""
    for nodes in reversed(levels[1:-1]):
        then = shared.keep(_sent_down(nodes, above), "merkle-sent")
        shared.forget(above)
        above = then
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; the fold takes the tampered leaf."""
    spark = docs.sparkSession
    found = shared.keep(leaves(docs), "merkle-leaves")
    nodes = numbered(found, [F.col("name").cast("long"), F.col("digest")])
    shared.forget(found)
    lower = tiers(nodes)
    subroots = lower[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    upper = tiers(numbered(subroots, [F.col("name")]))
    top = upper[-1].select("grp", "idx", F.col("digest").alias("root"))
    got = top.head()
    if got is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    root = got["root"]
    # the sources' proofs: the name of a node is the grp that its suffix goes to
    sent = _descend(upper, spark.createDataFrame([("", 0, "", root)], "grp string, idx long, suffix string, subroot string"))

    def to_sources(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(((r.name, 0, _packed(proof), r.digest) for r, proof, _ in _tier_proofs(it)), ["grp", "idx", "suffix", "subroot"])

    by_source = shared.keep(_messages(upper[0], sent).mapInPandas(to_sources, "grp string, idx long, suffix string, subroot string"), "merkle-sent")
    to_blocks = _descend(lower, by_source)

    def verified(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[tuple]:
            for r, proof, subroot in _tier_proofs(it):
                folded, siblings = fold(r.tampered or r.digest, proof)
                yield r.name, r.digest, subroot, root, siblings, folded, folded == root

        yield from _frames(each(), ["name", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    out = _messages(nodes, to_blocks).mapInPandas(verified, "name string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    out = out.select(F.col("name").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    out = shared.keep(out, "merkle-out")
    for used in (*lower, *upper, sent, by_source, to_blocks):
        shared.forget(used)
    return out
