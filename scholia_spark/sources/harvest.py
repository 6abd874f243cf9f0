"""Paged feeds as a batch data source: one partition a category and window, read page by page."""

from __future__ import annotations

import datetime as dt
import random
import time
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scholia_spark.operators.docmodel import atom_records
from scholia_spark.session import ship_package


def retry_delay(attempt: int, base: float = 1.0, factor: float = 2.0, jitter: float = 0.0) -> float:
    """Base * factor ** (attempt - 1), plus up to ``jitter`` seconds."""
    return base * factor ** (attempt - 1) + random.uniform(0, jitter)


class Window(InputPartition):
    def __init__(self, category: str, since: str, until: str):
        self.category, self.since, self.until = category, since, until


class PagedFeedReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        o = self.options
        first, last, days = dt.date.fromisoformat(o["since"]), dt.date.fromisoformat(o["until"]), int(o.get("window_days", 7))
        starts = [first + dt.timedelta(n) for n in range(0, (last - first).days + 1, days)]
        ends = [min(s + dt.timedelta(days - 1), last) for s in starts]
        return [Window(c, str(a), str(b)) for c in o["categories"].split(",") for a, b in zip(starts, ends, strict=True)]

    def read(self, partition):
        size, most = int(self.options.get("page_size", 100)), int(self.options.get("max_pages", 20))
        for page in range(most):
            where = {"category": partition.category, "since": partition.since, "until": partition.until, "start": page * size, "page": page}
            body = self.fetch(self.options["template"].format(**where))
            if body:
                yield partition.category, partition.since, partition.until, page, body
            if body is None or body.count(self.options.get("item", "<entry")) < size:
                return
        raise RuntimeError(f"more than {most} pages for {partition.category} from {partition.since}; take shorter windows")

    def fetch(self, url: str) -> str | None:
        """Body of a page, null for a page that isn't there; other failures are tried again, then the task fails."""
        tries = int(self.options.get("tries", 3))
        for n in range(1, tries + 1):
            try:
                with urllib.request.urlopen(url, timeout=30) as r:
                    return r.read().decode("utf-8", "replace")
            except OSError as x:
                if getattr(x, "code", None) == 404 or isinstance(getattr(x, "reason", None), FileNotFoundError):
                    return None
                if n == tries:
                    raise
                time.sleep(retry_delay(n, float(self.options.get("delay", 1)), jitter=0.5))


class PagedFeed(DataSource):
    """SRC1, SRC2, SRC4, SRC5: options template (with category, since, until, start, page), categories, since, until; pages past ``max_pages`` are an error, never left out."""

    @classmethod
    def name(cls):
        return "paged_feed"

    def schema(self):
        return "category string, since string, until string, page int, body string"

    def reader(self, schema):
        return PagedFeedReader(self.options)


def harvest(spark: SparkSession, template: str, categories: list[str], since: str, until: str, **options) -> DataFrame:
    """Metadata records of a feed, each reference once (its last update), updated on ``since`` or later."""
    ship_package(spark)
    spark.dataSource.register(PagedFeed)
    pages = spark.read.format("paged_feed").options(template=template, categories=",".join(categories), since=since, until=until, **options).load()
    records = atom_records(pages.select(F.col("page").cast("long").alias("feed_id"), "body")).drop("feed_id").where(F.col("updated") >= since)
    newest = records.groupBy("arxiv_ref").agg(F.max_by(F.struct(*[c for c in records.columns if c != "arxiv_ref"]), "updated").alias("r"))
    return newest.select("arxiv_ref", "r.*")


def lookup_batch(refs: DataFrame, metadata: DataFrame) -> DataFrame:
    """SRC3: references (ref) with the record of their bare id; a join takes the place of requests of a hundred ids."""
    bare = lambda c: F.regexp_replace(c, r"v\d+$", "")
    newest = metadata.groupBy(bare(F.col("arxiv_ref")).alias("_id")).agg(F.max_by(F.struct(*metadata.columns), "updated").alias("record"))
    return refs.withColumn("_id", bare(F.col("ref"))).join(newest, "_id", "left").drop("_id")
