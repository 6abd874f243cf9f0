"""SRC16: a keyed store of document models, and D29: a reparse in slices that can be resumed.

The store is a log of puts and removals, a folder a batch, dealt by buckets of the paper, and a compacted base that a pointer names.
A batch is visible as a whole once its folder is written. Readers take the base and the batches behind it; ``compact`` writes a
new base of what is live and moves the pointer by a rename; ``vacuum`` deletes what no base in use needs.

Defined cases: of several puts of a key the one of the last batch counts (within a batch, the largest body by order); a removal
takes all versions of its paper put in its own batch or before; removing what isn't there does nothing; a body that ``readable``
refuses is a miss; rows without paper_id or version are left out; an empty store has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia_spark.sources.files import BUCKETS, POINTER, _file_system, current, loss_within, publish

_LOG = "paper_id string, version int, body string, op string, at bigint, bucket int"


def _bucket(paper: str = "paper_id") -> Column:
    return F.pmod(F.xxhash64(paper), F.lit(BUCKETS)).cast("int")


def _names(spark: SparkSession, folder: str, start: str) -> list[int]:
    """Numbers of the folders ``start``=n under ``folder``: batches and bases, not papers."""
    path, fs = _file_system(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[len(start) + 1 :]) for n in names if n.startswith(f"{start}="))


class DocumentStore:
    """Document models by (paper_id, version) under ``folder``. One writer at a time gives batches their numbers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _append(self, rows: DataFrame) -> int:
        at = max([self.mark(), *_names(self.spark, f"{self.folder}/log", "at")]) + 1
        path = f"{self.folder}/log/at={at}"
        out = rows.select("paper_id", "version", "body", "op", _bucket().alias("bucket"))
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/draft-{at}")
        draft, fs = _file_system(self.spark, f"{self.folder}/draft-{at}")
        final, _ = _file_system(self.spark, path)
        fs.mkdirs(final.getParent())
        fs.rename(draft, final)
        return at

    def put(self, rows: DataFrame) -> int:
        """rows: paper_id, version, body. The batch's number."""
        named = rows.where("paper_id IS NOT NULL AND version IS NOT NULL").select(F.col("paper_id").cast("string"), F.col("version").cast("int"), F.col("body").cast("string"), F.lit("put").alias("op"))
        return self._append(named)

    def remove(self, papers: DataFrame) -> int:
        """papers: paper_id; all their versions go."""
        gone = papers.where("paper_id IS NOT NULL").select(F.col("paper_id").cast("string")).distinct()
        return self._append(gone.select("paper_id", F.lit(0).alias("version"), F.lit(None).cast("string").alias("body"), F.lit("remove").alias("op")))

    def mark(self) -> int:
        """The last batch that the current base holds; 0 without a base."""
        pointer, fs = _file_system(self.spark, f"{self.folder}/base/{POINTER}")
        if not fs.exists(pointer):
            return 0
        return int(self.spark.read.text(str(pointer), wholetext=True).head()[0])

    def _entries(self) -> DataFrame:
        mark = self.mark()
        out = self.spark.createDataFrame([], _LOG)
        if mark:
            out = current(self.spark, f"{self.folder}/base").select("paper_id", "version", "body", F.lit("put").alias("op"), F.lit(mark).cast("bigint").alias("at"), "bucket")
        behind = [n for n in _names(self.spark, f"{self.folder}/log", "at") if n > mark]
        if behind:
            paths = [f"{self.folder}/log/at={n}" for n in behind]
            log = self.spark.read.schema(_LOG).option("basePath", f"{self.folder}/log").parquet(*paths)
            out = out.unionByName(log.select(*out.columns))
        return out

    def live(self, asked: DataFrame | None = None) -> DataFrame:
        """paper_id, version, body, at of what is there; with ``asked`` (paper_id) of those papers only, by their buckets."""
        found = self._entries()
        if asked is not None:
            found = found.join(asked.select("paper_id", _bucket().alias("bucket")).distinct(), ["paper_id", "bucket"], "left_semi")
        last = found.groupBy("paper_id").agg(F.max(F.when(F.col("op") == "remove", F.col("at"))).alias("gone"))
        puts = found.where("op = 'put'").groupBy("paper_id", "version").agg(F.max(F.struct("at", "body")).alias("p"))
        kept = puts.join(last, "paper_id").where("gone IS NULL OR p.at > gone")
        return kept.select("paper_id", "version", "p.body", "p.at")

    def get(self, wanted: DataFrame, readable: Column | None = None) -> DataFrame:
        """wanted (paper_id, version) with ``body``, null where nothing is there or ``readable`` (of body) isn't true."""
        found = self.live(wanted.select("paper_id")).select("paper_id", "version", "body")
        if readable is not None:
            found = found.where(readable)
        return wanted.select("paper_id", "version").distinct().join(found, ["paper_id", "version"], "left")

    def latest(self) -> DataFrame:
        """paper_id, version of the last version that is there."""
        return self.live().groupBy("paper_id").agg(F.max("version").alias("version"))

    def compact(self) -> int:
        """A new base up to the last batch; readers see the old base or the new one, with the same rows."""
        batches = _names(self.spark, f"{self.folder}/log", "at")
        mark = max([self.mark(), *batches])
        if mark > self.mark():
            rows = self.live().select("paper_id", "version", "body", _bucket().alias("bucket")).repartition("bucket").sortWithinPartitions("paper_id", "version")
            publish(rows, f"{self.folder}/base", str(mark), 0)
        return mark

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete bases older than the current and the ``keep`` before it, and batches that the oldest of those holds; a reader that
        took its pointer before is safe as long as no more than ``keep`` compactions came after."""
        bases = [n for n in _names(self.spark, f"{self.folder}/base", "generation") if n <= self.mark()]
        safe = bases[-(keep + 1) :]
        old = [f"base/generation={n}" for n in bases if n not in safe]
        if len(bases) > keep and safe:
            old += [f"log/at={n}" for n in _names(self.spark, f"{self.folder}/log", "at") if n <= safe[0]]
        for name in old:
            path, fs = _file_system(self.spark, f"{self.folder}/{name}")
            fs.delete(path, True)
        return old


def reparse(papers: DataFrame, parse: Callable[[DataFrame], DataFrame], folder: str, slices: int = 64, most_loss: float = 0.1, least: int = 100, retry: bool = False) -> dict:
    """Papers (paper_id, ...) through ``parse`` in slices, each written with its outcomes in one commit, until the loss budget is spent.

    parse gives paper_id, outcome (indexed, excluded or failed) and what else it makes; a paper that it gives no row counts as failed.
    A slice is a share of the papers by hash. Results and ledger are the same rows, under ``slice=s/run=r``, so a driver that dies
    leaves whole slices only, and the next run takes the papers that have no outcome yet (with ``retry`` those that failed, too).
    After each slice the outcomes so far are held against the budget: with more than ``most_loss`` lost of at least ``least`` papers
    the run stops, and what follows it must not go on. Returns counts, bad_ratio, within, slices (done in this run), stopped.
    """
    spark = papers.sparkSession
    whole = papers.where("paper_id IS NOT NULL").dropDuplicates(["paper_id"]).withColumn("slice", F.pmod(F.xxhash64("paper_id"), F.lit(slices)).cast("int"))
    path, fs = _file_system(spark, folder)
    runs = set()
    for s in _names(spark, folder, "slice"):
        runs |= set(_names(spark, f"{folder}/slice={s}", "run"))
    run, done, stopped = max(runs, default=0) + 1, 0, False
    for s in range(slices):
        todo = whole.where(F.col("slice") == s)
        if fs.exists(path) and _names(spark, folder, "slice"):
            known = outcomes(spark, folder).where(F.col("slice") == s)
            todo = todo.join(known.where("outcome <> 'failed'") if retry else known, "paper_id", "left_anti")
        if todo.isEmpty():
            continue
        made = parse(todo.drop("slice"))
        rows = todo.select("paper_id").join(made, "paper_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("failed")))
        rows = rows.withColumn("slice", F.lit(s)).withColumn("run", F.lit(run))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice", "run").parquet(folder)
        done += 1
        verdict = loss_within(outcomes(spark, folder), most_loss).head().asDict()
        if not verdict["within"] and verdict["indexed"] + verdict["excluded"] + verdict["failed"] >= least:
            stopped = True
            break
    if not _names(spark, folder, "slice"):
        return {"indexed": 0, "excluded": 0, "failed": 0, "bad_ratio": 1.0, "within": False, "slices": 0, "stopped": False}
    return loss_within(outcomes(spark, folder), most_loss).head().asDict() | {"slices": done, "stopped": stopped}


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a reparse: each paper once, as its last run gave it."""
    rows = spark.read.parquet(folder)
    last = rows.groupBy("paper_id").agg(F.max("run").alias("run"))
    return rows.join(last, ["paper_id", "run"])


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """paper_id, outcome, slice: the ledger, which is the results without what was made."""
    return spark.read.parquet(folder).groupBy("paper_id", "slice").agg(F.max_by("outcome", "run").alias("outcome"))
