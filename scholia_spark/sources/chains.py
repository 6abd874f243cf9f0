"""Chained pages as a batch data source: each page names the next by a token or cursor, so a chain is one task's work and
chains (a category and window each) run side by side.

Defined cases: a page without a token ends its chain; a token that the service no longer knows starts the window anew, up to
``restarts`` times, and records are then met again (they are kept once by id); a token that comes back is an error, as are a
page that isn't there and any other error the service states; an answer that no record matches is an empty chain. Records
without an id or title, and broken ones, are left out; deleted ones become tombstones.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import time
import urllib.parse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from scholia_spark.functions.text import license_url
from scholia_spark.operators.docmodel import openalex_records, parse_xml, s2_records
from scholia_spark.sources.files import in_window
from scholia_spark.sources.harvest import PagedFeedReader
from scholia_spark.session import ship_package


class Oai:
    """Harvesting protocol: a resumptionToken element, errors with a code; pages aren't in order of date."""

    EMPTY, EXPIRED = {"noRecordsMatch"}, {"badResumptionToken"}

    @classmethod
    def read(cls, body: str) -> tuple[str, str | None, str | None]:
        """State (ok, empty, expired or an error), next token, and the last date where pages are in order of date."""
        root = parse_xml(body)
        if root is None:
            return "broken page", None, None
        codes = {e.get("code") or "unknown" for e in root.iter() if e.tag.rpartition("}")[2] == "error"}
        if codes - cls.EMPTY:
            return "expired" if codes <= cls.EXPIRED | cls.EMPTY else f"error {sorted(codes)}", None, None
        if codes:
            return "empty", None, None
        tokens = [(e.text or "").strip() for e in root.iter() if e.tag.rpartition("}")[2] == "resumptionToken"]
        return "ok", next(iter(tokens), None) or None, None


class Json:
    """JSON pages: where their items and next token are, and the dates of an item."""

    items: str
    dates: tuple[str, ...]

    @classmethod
    def token(cls, page: dict) -> str | None:
        raise NotImplementedError

    @classmethod
    def read(cls, body: str) -> tuple[str, str | None, str | None]:
        try:
            page = json.loads(body)
        except ValueError:
            return "broken page", None, None
        if not isinstance(page, dict) or "error" in page:
            why = str(page.get("error") if isinstance(page, dict) else page)
            return "expired" if re.search("token|cursor", why, re.I) else f"error {why}", None, None
        dates = [str(i[d]) for i in page.get(cls.items) or [] for d in cls.dates if isinstance(i, dict) and i.get(d)]
        return "ok", cls.token(page) or None, dates[-1] if dates else None


class SemanticScholar(Json):
    items, dates = "data", ("publicationDate",)

    @classmethod
    def token(cls, page):
        return page.get("token")


class OpenAlex(Json):
    items, dates = "results", ("publication_date",)

    @classmethod
    def token(cls, page):
        return (page.get("meta") or {}).get("next_cursor")


FORMATS = {"oai": Oai, "semantic_scholar": SemanticScholar, "openalex": OpenAlex}


class ChainReader(PagedFeedReader):
    """Options: format, first and next (templates with category, since, until and, for next, token), categories, since, until,
    window_days, restarts, tries, delay, interval (seconds between pages), sorted (true: pages ascend by date, so a chain ends
    with the page that passes ``until``)."""

    def read(self, partition):
        o, form = self.options, FORMATS[self.options["format"]]
        where = {"category": partition.category, "since": partition.since, "until": partition.until}
        restarts, in_order = int(o.get("restarts", 2)), str(o.get("sorted", "false")).lower() == "true"
        for attempt in range(restarts + 1):
            url, seen, page = o["first"].format(**where), set(), 0
            while True:
                body = self.fetch(url)
                state, token, last = ("no such page", None, None) if body is None else form.read(body)
                if state == "expired" and page:
                    break
                if state not in ("ok", "empty"):
                    raise RuntimeError(f"{state} at {url}")
                yield partition.category, partition.since, partition.until, attempt, page, body
                if not token or (in_order and last and last[:10] > partition.until):
                    return
                if token in seen:
                    raise RuntimeError(f"token {token} came back at {url}")
                seen.add(token)
                url, page = o["next"].format(token=urllib.parse.quote(token, safe=""), **where), page + 1
                time.sleep(float(o.get("interval", 0)))
        raise RuntimeError(f"tokens of {partition.category} from {partition.since} expired {restarts + 1} times; take shorter windows")


class PageChain(DataSource):
    """SRC1, SRC4, SRC5: pages that name the next one."""

    @classmethod
    def name(cls):
        return "page_chain"

    def schema(self):
        return "category string, since string, until string, attempt int, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return ChainReader(self.options)


def page_chains(spark: SparkSession, form: str, first: str, next_: str, categories: list[str], since: str, until: str, **options) -> DataFrame:
    """Pages of all chains, one chain for each category and window of ``window_days`` (7)."""
    ship_package(spark)
    spark.dataSource.register(PageChain)
    given = {"format": form, "first": first, "next": next_, "categories": ",".join(categories), "since": since, "until": until}
    return spark.read.format("page_chain").options(**given, **options).load()


OAI_RECORD = "arxiv_ref string, title string, abstract string, authors array<string>, categories array<string>, updated string, published string, license string, datestamp string, deleted boolean"


def oai_records(pages: DataFrame) -> DataFrame:
    """Records of harvested pages (body): a row a record, with ``deleted`` and nulls where the header says that it is gone."""

    def one(body: str | None):
        root = parse_xml(body)
        for record in [] if root is None else (e for e in root.iter() if e.tag.rpartition("}")[2] == "record"):
            named: dict[str, list] = {}
            for e in record.iter():
                named.setdefault(e.tag.rpartition("}")[2], []).append(e)
            text = lambda tag: next((" ".join((e.text or "").split()) for e in named.get(tag, [])), "")  # noqa: E731, B023
            ref, stamp = text("identifier").rpartition(":")[2], text("datestamp")
            if any(h.get("status") == "deleted" for h in named.get("header", [])):
                if ref and stamp:
                    yield ref, None, None, None, None, None, None, None, stamp, True
            elif (ref := text("id") or ref) and text("title") and stamp:
                people = [" ".join(x for x in ((a.findtext("{*}forenames") or "").strip(), (a.findtext("{*}keyname") or "").strip()) if x) for a in named.get("author", [])]
                yield ref, text("title"), text("abstract"), [p for p in people if p], text("categories").split(), text("updated") or text("created") or stamp, text("created") or None, text("license") or None, stamp, False

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for b in pdf["body"] for r in one(b)], columns=[c.split()[0] for c in OAI_RECORD.split(", ")])

    ship_package(pages.sparkSession)
    return pages.select("body").mapInPandas(run, OAI_RECORD)


def harvest_seed(spark: SparkSession, first: str, next_: str, categories: list[str], since: str, until: str, **options) -> DataFrame:
    """SRC1: each reference once, by its last datestamp; where that says deleted, the row is a tombstone (of one datestamp, the
    deletion wins)."""
    records = oai_records(page_chains(spark, "oai", first, next_, categories, since, until, **options))
    rest = [c for c in records.columns if c != "arxiv_ref"]
    newest = records.groupBy("arxiv_ref").agg(F.max_by(F.struct(*rest), F.struct("datestamp", "deleted", "updated")).alias("r"))
    return newest.select("arxiv_ref", "r.*")


def apply_harvest(stored: DataFrame, harvested: DataFrame) -> DataFrame:
    """``stored`` (columns of a harvested record) with newer records in place of older and without those that are gone."""
    kept = stored.join(harvested.select("arxiv_ref").distinct(), "arxiv_ref", "left_anti")
    return kept.unionByName(harvested.where(~F.col("deleted")).select(*stored.columns))


_COMMON = ("source_id", "title", "abstract", "authors", "updated", "published", "year", "doi", "arxiv_id", "venue", "fields_of_study", "license_url", "pdf_url")


def service_records(pages: DataFrame, form: str, license_of=license_url) -> DataFrame:
    """SRC4, SRC5: pages of either JSON service as records of one schema: source_name and ``_COMMON``.

    An item without an open file under a known licence gives no row.
    """
    name = FORMATS[form].items
    items = pages.select(F.explode(F.from_json("body", f"{name} array<string>")[name]).alias("item"))
    if form == "openalex":
        numbered = items.select(F.struct("item").alias("id"), "item")
        extra = F.from_json(F.col("id.item"), "updated_date string")
        found = openalex_records(numbered, license_of).withColumn("updated", F.try_to_timestamp(extra["updated_date"]))
    else:
        r, extra = s2_records(F.col("item"), license_of), F.from_json("item", "abstract string, venue string, publicationDate string")
        found = items.select(r.alias("r"), extra.alias("e")).where("r IS NOT NULL").select("r.*", F.coalesce("e.abstract", F.lit("")).alias("abstract"), F.coalesce("e.venue", F.lit("")).alias("venue"), F.try_to_date("e.publicationDate").alias("published"), F.lit(None).cast("timestamp").alias("updated"))
    return found.where("source_id IS NOT NULL AND title <> ''").select(F.lit(form).alias("source_name"), *_COMMON)


def fetch_incremental(spark: SparkSession, form: str, first: str, next_: str, categories: list[str], since: dt.datetime, until: dt.datetime | None = None, **options) -> DataFrame:
    """SRC4, SRC5 with SRC6's window: records after ``since`` and up to ``until`` (null: open), each source_id once by its last time."""
    last = (until or dt.datetime.now(dt.timezone.utc)).date().isoformat()
    days = {"window_days": str((dt.date.fromisoformat(last) - since.date()).days + 1)} | options
    found = service_records(page_chains(spark, form, first, next_, categories, since.date().isoformat(), last, **days), form)
    at: Column = F.lit(since)
    inside = found.where(in_window(F.col("updated"), F.col("published").cast("timestamp"), at, F.lit(until).cast("timestamp")))
    rest = [c for c in found.columns if c != "source_id"]
    time_ = F.coalesce("updated", F.col("published").cast("timestamp"), at)
    return inside.groupBy("source_id").agg(F.max_by(F.struct(*rest), F.struct(time_, F.xxhash64("title", "abstract"))).alias("r")).select("source_id", "r.*")
