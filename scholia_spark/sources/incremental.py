"""SRC2: an Atom service as a streaming source with offsets, and SRC3: metadata of listed ids in batches of requests.

An offset is the newest update time so far and the ids that have it, so a batch is a range of the service's records: after the
start's time, or at it and not among its ids, up to the end's. Records that share the boundary's second are thus given once,
however late they appear. A batch that was read and not committed is asked for again with the same offsets and gives the same
records, as long as the service still has them. A batch is read in day windows, each by a task.
"""

from __future__ import annotations

import datetime as dt
import urllib.parse
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from scholia_spark.operators.docmodel import RECORD, atom_entries
from scholia_spark.sources.harvest import PagedFeedReader
from scholia_spark.session import ship_package

FIELDS = RECORD.replace("feed_id long, ", "")
_REF, _UPDATED = 0, 5


class Days(InputPartition):
    def __init__(self, since: str, until: str, start: dict, end: dict):
        self.since, self.until, self.start, self.end = since, until, start, end


def _within(ref: str, updated: str, start: dict, end: dict) -> bool:
    ids = lambda o: o["ids"].split(",")
    after = updated > start["at"] or (updated == start["at"] and ref not in ids(start))
    return after and (updated < end["at"] or (updated == end["at"] and ref in ids(end)))


class AtomStreamReader(DataSourceStreamReader):
    """Options: template (since, until, start, page: records of those days, oldest first), newest (start, page: newest first),
    since (first time, inclusive), window_days, page_size, max_pages, tries, delay."""

    def __init__(self, options):
        self.options = options
        self.pages = PagedFeedReader(options)

    def initialOffset(self) -> dict:
        return {"at": self.options["since"], "ids": ""}

    def latestOffset(self) -> dict:
        """The newest time and all ids that have it. An answer without entries is an error, not a service without news."""
        at, ids, size = None, set(), int(self.options.get("page_size", 100))
        for page in range(int(self.options.get("max_pages", 20))):
            found = self._entries(self.options["newest"].format(start=page * size, page=page))
            if at is None:
                if not found:
                    raise RuntimeError("the service names no newest record; it may be down, so nothing is read")
                at = max(r[_UPDATED] for r in found)
            new = {r[_REF] for r in found if r[_UPDATED] == at}
            ids |= new
            if len(found) < size or len(new) < len(found):
                break
        return {"at": at, "ids": ",".join(sorted(ids))} if at >= self.options["since"] else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Days]:
        if end["at"] < start["at"]:
            raise RuntimeError(f"the service's newest record went back from {start['at']} to {end['at']}")
        first, last = (dt.date.fromisoformat(o["at"][:10]) for o in (start, end))
        days = int(self.options.get("window_days", 1))
        since = [first + dt.timedelta(n) for n in range(0, (last - first).days + 1, days)]
        return [Days(str(a), str(min(a + dt.timedelta(days - 1), last)), start, end) for a in since]

    def _entries(self, url: str) -> list[tuple]:
        body = self.pages.fetch(url)
        return list(atom_entries(body)) if body else []

    def read(self, partition: Days) -> Iterator[tuple]:
        size, most = int(self.options.get("page_size", 100)), int(self.options.get("max_pages", 20))
        for page in range(most):
            found = self._entries(self.options["template"].format(since=partition.since, until=partition.until, start=page * size, page=page))
            yield from (r for r in found if _within(r[_REF], r[_UPDATED], partition.start, partition.end))
            if len(found) < size:
                return
        raise RuntimeError(f"more than {most} pages from {partition.since}; take shorter windows")


class AtomIncremental(DataSource):
    @classmethod
    def name(cls):
        return "atom_incremental"

    def schema(self):
        return FIELDS

    def streamReader(self, schema):
        return AtomStreamReader(self.options)


def atom_stream(spark: SparkSession, template: str, newest: str, since: str, **options) -> DataFrame:
    """SRC2: a stream of metadata records, each update of a reference once, from ``since`` (inclusive) on."""
    ship_package(spark)
    spark.dataSource.register(AtomIncremental)
    return spark.readStream.format("atom_incremental").options(template=template, newest=newest, since=since, **options).load()


BATCH = 100


def lookup_requests(refs: DataFrame, template: str, size: int = BATCH, **options) -> DataFrame:
    """SRC3: bare_id, record, error for every distinct bare id of ``refs`` (ref), asked for ``size`` at a time within tasks.

    template: an address with ``ids`` (joined by commas) and ``count``. A request that fails (after its tries) is halved until what fails
    is one id, whose row has the error; the others keep their records. An id that the answer leaves out has neither. Null
    refs ask for nothing.
    """
    ship_package(refs.sparkSession)
    wanted = refs.where("ref IS NOT NULL").select(F.regexp_replace("ref", r"v\d+$", "").alias("bare_id")).distinct()
    names = [c.split()[0] for c in FIELDS.split(", ")]

    def ask(pages: PagedFeedReader, ids: list[str]) -> Iterator[tuple]:
        try:
            body = pages.fetch(template.format(ids=urllib.parse.quote(",".join(ids), safe=","), count=len(ids)))
        except OSError as x:
            if len(ids) > 1:
                yield from ask(pages, ids[: len(ids) // 2])
                yield from ask(pages, ids[len(ids) // 2 :])
            else:
                yield ids[0], None, f"{type(x).__name__}: {x}"
            return
        found = {}
        for r in atom_entries(body or ""):
            bare = r[_REF].rpartition("v")[0] if r[_REF].rpartition("v")[2].isdigit() and "v" in r[_REF] else r[_REF]
            if bare not in found or found[bare][_UPDATED] < r[_UPDATED]:
                found[bare] = r
        for i in ids:
            yield i, dict(zip(names, found[i], strict=True)) if i in found else None, None

    def run(batches):
        pages, held = PagedFeedReader({k: str(v) for k, v in options.items()}), []
        frame = lambda ids: pd.DataFrame(list(ask(pages, ids)), columns=["bare_id", "record", "error"])
        for pdf in batches:
            held += pdf["bare_id"].tolist()
            while len(held) >= size:
                yield frame(held[:size])
                held = held[size:]
        if held:
            yield frame(held)

    record = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in FIELDS.split(", "))
    return wanted.mapInPandas(run, f"bare_id string, record struct<{record}>, error string")
