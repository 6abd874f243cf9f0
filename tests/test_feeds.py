"""Token chains, cursors, the offset stream and batched lookups, against a small service on this machine or files."""

import datetime as dt
import http.server
import json
import threading
import urllib.parse

import pytest

from scholia_spark.sources import chains, incremental


@pytest.fixture
def serve():
    """Starts services: serve(answer) with answer(path, query) -> (status, body); gives the address and the log of requests."""
    running = []

    def start(answer):
        log = []

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                url = urllib.parse.urlsplit(self.path)
                query = dict(urllib.parse.parse_qsl(url.query))
                log.append(query)
                status, body = answer(url.path, query)
                self.send_response(status)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_):
                pass

        server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        running.append(server)
        return f"http://127.0.0.1:{server.server_port}", log

    yield start
    for s in running:
        s.shutdown()


def oai(*records, token=None, error=None):
    body = "".join(records) + (f"<resumptionToken>{token}</resumptionToken>" if token else "")
    body = f"<error code='{error}'>no</error>" if error else f"<ListRecords>{body}</ListRecords>"
    return f"<OAI-PMH xmlns='http://www.openarchives.org/OAI/2.0/'>{body}</OAI-PMH>"


def rec(ref, stamp, title="T", deleted=False):
    if deleted:
        return f"<record><header status='deleted'><identifier>oai:x:{ref}</identifier><datestamp>{stamp}</datestamp></header></record>"
    meta = f"<m xmlns='http://m'><id>{ref}</id><created>2020-01-01</created><title>{title}</title><abstract> a  b\n c</abstract><authors><author><keyname>Ng</keyname><forenames>Ann</forenames></author></authors><categories>cs.AI cs.CL</categories></m>"
    return f"<record><header><identifier>oai:x:{ref}</identifier><datestamp>{stamp}</datestamp></header><metadata>{meta}</metadata></record>"


def seed(spark, address, **how):
    first, next_ = address + "/oai?set={category}&from={since}&until={until}", address + "/oai?token={token}"
    return chains.harvest_seed(spark, first, next_, ["cs"], "2021-01-01", "2021-01-07", tries="1", delay="0", **how)


def test_token_chain_and_deletions(spark, serve):
    pages = {"": oai(rec("1", "2021-01-01"), rec("2", "2021-01-01"), token="a/b+1"), "a/b+1": oai(rec("1", "2021-01-03", "New"), rec("2", "2021-01-02", deleted=True), "<record><header/></record>", token="c"), "c": oai(rec("3", "2021-01-02"))}
    address, log = serve(lambda path, q: (200, pages[q.get("token", "")]))
    rows = {r.arxiv_ref: r for r in seed(spark, address).collect()}
    assert sorted(rows) == ["1", "2", "3"] and rows["1"].title == "New" and rows["2"].deleted and rows["2"].title is None
    assert rows["3"].authors == ["Ann Ng"] and rows["3"].categories == ["cs.AI", "cs.CL"] and rows["3"].abstract == "a b c" and rows["3"].updated == "2020-01-01"
    assert [q.get("token") for q in log] == [None, "a/b+1", "c"]  # nothing is asked for twice
    stored = spark.createDataFrame([("2", "Old"), ("1", "Old"), ("9", "Kept")], "arxiv_ref string, title string")
    after = chains.apply_harvest(stored, seed(spark, address).withColumnRenamed("title", "title"))
    assert sorted((r.arxiv_ref, r.title) for r in after.collect()) == [("1", "New"), ("3", "T"), ("9", "Kept")]


def test_an_expired_token_starts_the_window_anew(spark, serve):
    calls = []

    def answer(path, q):
        calls.append(q.get("token"))
        if "token" not in q:
            return 200, oai(rec("1", "2021-01-01"), token="t")
        return 200, oai(error="badResumptionToken") if calls.count("t") == 1 else oai(rec("2", "2021-01-02"))

    address, _ = serve(answer)
    assert sorted(r.arxiv_ref for r in seed(spark, address).collect()) == ["1", "2"]
    assert calls == [None, "t", None, "t"]


def test_tokens_that_always_expire_are_an_error(spark, serve):
    address, _ = serve(lambda path, q: (200, oai(error="badResumptionToken") if "token" in q else oai(rec("1", "2021-01-01"), token="t")))
    with pytest.raises(Exception, match="expired 3 times"):
        seed(spark, address).collect()


def test_a_loop_of_tokens_is_an_error(spark, serve):
    address, _ = serve(lambda path, q: (200, oai(rec("1", "2021-01-01"), token={"": "a", "a": "b", "b": "a"}[q.get("token", "")])))
    with pytest.raises(Exception, match="token a came back"):
        seed(spark, address).collect()


@pytest.mark.parametrize("body, why", [(oai(error="badArgument"), "badArgument"), ("<OAI-PMH><broken", "broken page"), (None, "no such page")])
def test_answers_that_are_no_pages(spark, serve, body, why):
    address, _ = serve(lambda path, q: (200, body) if body else (404, ""))
    with pytest.raises(Exception, match=why):
        seed(spark, address).collect()


def test_no_match_is_empty(spark, serve):
    address, _ = serve(lambda path, q: (200, oai(error="noRecordsMatch")))
    assert seed(spark, address).collect() == []


def s2_item(i, date, **more):
    return {"paperId": f"p{i}", "title": f"T{i}", "abstract": None if i % 2 else "A", "year": 2021, "venue": "V", "isOpenAccess": True, "openAccessPdf": {"url": f"https://x/{i}.pdf", "license": "CC-BY"}, "authors": [{"name": "Ann"}], "externalIds": {"DOI": "10.1/x"}, "s2FieldsOfStudy": [{"category": "CS"}], "publicationDate": date} | more


def oa_item(i, date, updated=None):
    return {"id": f"https://o/W{i}", "display_name": f"T{i}", "publication_date": date, "publication_year": 2021, "updated_date": updated, "primary_location": {"pdf_url": f"https://x/{i}.pdf", "license": "cc-by", "source": {"display_name": "V"}}}


SINCE, UNTIL = dt.datetime(2021, 1, 2, tzinfo=dt.timezone.utc), dt.datetime(2021, 1, 4, tzinfo=dt.timezone.utc)


@pytest.mark.parametrize("form", ["semantic_scholar", "openalex"])
def test_json_services(spark, serve, form):
    """The window is open below and closed above; both services give one schema."""
    item = s2_item if form == "semantic_scholar" else oa_item
    dates = ["2021-01-01", "2021-01-02", "2021-01-03", "2021-01-04", "2021-01-05"]
    pages = [[item(i, d) for i, d in enumerate(dates[:3])], [item(3, dates[3]), item(4, dates[4]), {"title": "no id"}, item(2, dates[2])], []]

    def answer(path, q):
        at = int(q.get("token", 0))
        token = str(at + 1) if at < 2 else None
        return 200, json.dumps({"data": pages[at], "token": token} if form == "semantic_scholar" else {"results": pages[at], "meta": {"next_cursor": token}})

    address, log = serve(answer)
    found = chains.fetch_incremental(spark, form, address + "/first?q={category}", address + "/next?token={token}", ["cs"], SINCE, UNTIL, tries="1")
    rows = found.orderBy("source_id").collect()
    assert [r.title for r in rows] == ["T2", "T3"] and {r.source_name for r in rows} == {form}
    assert [str(r.published) for r in rows] == ["2021-01-03", "2021-01-04"] and {r.license_url for r in rows} == {"https://creativecommons.org/licenses/by/4.0/"}
    assert found.columns == ["source_id", "source_name", *[c for c in chains._COMMON if c != "source_id"]]
    assert len(log) == 3


def test_updates_count_before_publication(spark, serve):
    body = json.dumps({"results": [oa_item(1, "2019-01-01", "2021-01-03T05:00:00"), oa_item(2, "2021-01-03", "2021-02-01T00:00:00")], "meta": {}})
    address, _ = serve(lambda path, q: (200, body))
    found = chains.fetch_incremental(spark, "openalex", address + "/?a", address + "/?t={token}", ["cs"], SINCE, UNTIL, tries="1").collect()
    assert [r.title for r in found] == ["T1"]


def test_sorted_pages_end_a_chain_inside_a_page(spark, serve):
    pages = [[s2_item(0, "2021-01-03")], [s2_item(1, "2021-01-04"), s2_item(2, "2021-01-06")], [s2_item(3, "2021-01-07")]]
    address, log = serve(lambda path, q: (200, json.dumps({"data": pages[int(q.get("token", 0))], "token": str(int(q.get("token", 0)) + 1)})))
    found = chains.fetch_incremental(spark, "semantic_scholar", address + "/?a", address + "/?token={token}", ["cs"], SINCE, UNTIL, tries="1", sorted="true")
    assert sorted(r.source_id for r in found.collect()) == ["p0", "p1"]
    assert len(log) == 2


def test_a_json_error_and_an_expired_cursor(spark, serve):
    address, _ = serve(lambda path, q: (200, json.dumps({"error": "bad query"})))
    with pytest.raises(Exception, match="bad query"):
        chains.fetch_incremental(spark, "openalex", address + "/?a", address + "/?t={token}", ["cs"], SINCE, UNTIL, tries="1").collect()


# the offset stream, over files


def entry(ref, updated):
    return f"<entry><id>http://h/abs/{ref}</id><title>T</title><summary>S</summary><updated>{updated}</updated><published>2020-12-01T00:00:00Z</published></entry>"


class Folder:
    """A service as files: pages of two records a day, oldest first, and pages of the newest."""

    def __init__(self, path):
        self.path, self.records = path, []

    def add(self, *records):
        self.records = sorted({r[0]: r for r in [*self.records, *records]}.values(), key=lambda r: (r[1], r[0]))
        by_day = {}
        for r in self.records:
            by_day.setdefault(r[1][:10], []).append(r)
        pages = {f"{day}-{p}": rows[2 * p : 2 * p + 2] for day, rows in by_day.items() for p in range(len(rows) // 2 + 1)}
        newest = self.records[::-1]
        pages |= {f"newest-{p}": newest[2 * p : 2 * p + 2] for p in range(len(newest) // 2 + 1)}
        for name, rows in pages.items():
            (self.path / f"{name}.xml").write_text("<feed xmlns='http://www.w3.org/2005/Atom'>" + "".join(entry(*r) for r in rows) + "</feed>")

    def stream(self, spark):
        base = f"file://{self.path}"
        return incremental.atom_stream(spark, base + "/{since}-{page}.xml", base + "/newest-{page}.xml", "2021-01-01T00:00:00Z", page_size="2", tries="1")


def run_once(stream, top, fail=False):
    seen = []

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{top}/out/batch={batch_id}")
        seen.append(batch_id)
        if fail:
            raise RuntimeError("killed before the commit")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return seen


def held(spark, top):
    return sorted((r.arxiv_ref, r.updated) for r in spark.read.parquet(f"{top}/out").collect())


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "service").mkdir()
    return Folder(tmp_path / "service")


def test_each_record_once_over_runs(spark, folder, tmp_path):
    top = f"file://{tmp_path}"
    folder.add(("1v1", "2021-01-01T00:00:00Z"), ("2v1", "2021-01-01T09:00:00Z"), ("3v1", "2021-01-03T10:00:00Z"), ("0v1", "2020-12-31T23:59:59Z"))
    run_once(folder.stream(spark), top)
    first = [("1v1", "2021-01-01T00:00:00Z"), ("2v1", "2021-01-01T09:00:00Z"), ("3v1", "2021-01-03T10:00:00Z")]
    assert held(spark, top) == first
    # one more of the boundary's second, and an update of an old one
    folder.add(("4v1", "2021-01-03T10:00:00Z"), ("5v1", "2021-01-04T00:00:00Z"), ("2v2", "2021-01-05T00:00:00Z"))
    run_once(folder.stream(spark), top)
    assert held(spark, top) == sorted([*first, ("4v1", "2021-01-03T10:00:00Z"), ("5v1", "2021-01-04T00:00:00Z"), ("2v2", "2021-01-05T00:00:00Z")])
    run_once(folder.stream(spark), top)
    assert len(held(spark, top)) == 6


def test_killed_between_read_and_commit(spark, folder, tmp_path):
    top = f"file://{tmp_path}"
    folder.add(("1v1", "2021-01-01T00:00:00Z"), ("2v1", "2021-01-02T00:00:00Z"))
    with pytest.raises(Exception, match="killed"):
        run_once(folder.stream(spark), top, fail=True)
    folder.add(("3v1", "2021-01-02T00:00:00Z"), ("4v1", "2021-01-06T00:00:00Z"))  # grows before the restart
    run_once(folder.stream(spark), top)
    run_once(folder.stream(spark), top)
    assert held(spark, top) == [("1v1", "2021-01-01T00:00:00Z"), ("2v1", "2021-01-02T00:00:00Z"), ("3v1", "2021-01-02T00:00:00Z"), ("4v1", "2021-01-06T00:00:00Z")]


def test_offsets():
    reader = incremental.AtomStreamReader({"since": "2021-01-01T00:00:00Z"})
    with pytest.raises(RuntimeError, match="went back"):
        reader.partitions({"at": "2021-01-03T00:00:00Z", "ids": "a"}, {"at": "2021-01-02T00:00:00Z", "ids": "b"})
    days = reader.partitions({"at": "2021-01-30T00:00:00Z", "ids": ""}, {"at": "2021-02-02T00:00:00Z", "ids": "b"})
    assert [d.since for d in days] == ["2021-01-30", "2021-01-31", "2021-02-01", "2021-02-02"]


def test_a_silent_service_is_an_error(spark, folder, tmp_path):
    (folder.path / "newest-0.xml").write_text("<feed xmlns='http://www.w3.org/2005/Atom'/>")
    with pytest.raises(Exception, match="no newest record"):
        run_once(folder.stream(spark), f"file://{tmp_path}")


def test_lookup_in_batches(spark, serve):
    """Of a request that fails only the id that breaks it is lost; ids are asked for together."""
    feed = lambda ids: "<feed xmlns='http://www.w3.org/2005/Atom'>" + "".join(entry(f"{i}v2", "2021-01-01T00:00:00Z") for i in ids if not i.startswith("9")) + "</feed>"

    def answer(path, q):
        ids = q["ids"].split(",")
        return (500, "") if "bad" in ids else (200, feed(ids))

    address, log = serve(answer)
    refs = [(f"{i}v1",) for i in range(40)] + [(f"{i}",) for i in range(40)] + [("bad",), ("99",), (None,)]
    found = incremental.lookup_requests(spark.createDataFrame(refs, "ref string").coalesce(1), address + "/q?ids={ids}&n={count}", size=16, tries=1)
    rows = {r.bare_id: r for r in found.collect()}
    assert set(rows) == {*map(str, range(40)), "bad", "99"}
    assert all(rows[str(i)].record.arxiv_ref == f"{i}v2" for i in range(9)) and rows["99"].record is None and rows["99"].error is None
    assert rows["bad"].record is None and "500" in rows["bad"].error
    assert len(log) <= 20
