"""Paged feeds over files in place of a service."""

import pytest

from scholia_spark.sources import harvest as H


def entry(ref, day):
    return f"<entry><id>http://h/abs/{ref}</id><title>T</title><summary>S</summary><updated>2021-01-{day:02}T00:00:00Z</updated><published>2020-12-01T00:00:00Z</published></entry>"


def feed(*entries):
    return "<feed xmlns='http://www.w3.org/2005/Atom'>" + "".join(entries) + "</feed>"


@pytest.fixture
def service(tmp_path):
    (tmp_path / "cs-2021-01-01-0.xml").write_text(feed(entry("2101.00001v1", 1), entry("2101.00002v1", 2)))
    (tmp_path / "cs-2021-01-01-1.xml").write_text(feed(entry("2101.00001v1", 3)))
    (tmp_path / "cs-2021-01-08-0.xml").write_text(feed(entry("2101.00003v2", 9)))
    (tmp_path / "ml-2021-01-01-0.xml").write_text("<broken")
    return f"file://{tmp_path}/{{category}}-{{since}}-{{page}}.xml"


def test_harvest(spark, service):
    found = H.harvest(spark, service, ["cs", "ml"], "2021-01-01", "2021-01-14", page_size="2", tries="1").collect()
    assert sorted((r.arxiv_ref, r.updated[:10]) for r in found) == [("2101.00001v1", "2021-01-03"), ("2101.00002v1", "2021-01-02"), ("2101.00003v2", "2021-01-09")]


def test_too_many_pages_are_an_error(spark, service):
    with pytest.raises(Exception, match="more than 1 pages"):
        H.harvest(spark, service, ["cs"], "2021-01-01", "2021-01-07", page_size="2", max_pages="1").collect()


def test_lookup(spark):
    refs = spark.createDataFrame([("2101.00001v3",), ("2101.9",), (None,)], "ref string")
    meta = spark.createDataFrame([("2101.00001v1", "2021-01-01"), ("2101.00001v2", "2021-01-02")], "arxiv_ref string, updated string")
    assert {r.ref: r.record and r.record.arxiv_ref for r in H.lookup_batch(refs, meta).collect()} == {"2101.00001v3": "2101.00001v2", "2101.9": None, None: None}


def test_delay():
    assert [H.retry_delay(n) for n in (1, 2, 3)] == [1.0, 2.0, 4.0]
