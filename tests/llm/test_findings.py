"""Cases that the code once did by half."""

import base64
import collections
import hashlib
import math
import random
import struct
import zlib

import pytest
import regex
import zstandard as zstd
from pyspark.sql import functions as F

from scholia_spark.llm import components, decontaminate, jaccard, lm, queries, shared, warc


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_language_model_of_order_3(spark):
    texts = ["a b c d a b c e", "a b c d", "x b c d f g h a b", "b c", "", None, "a a a a a a b", "q r s t u v"] * 9 + ["f g h a b c d a b e", "new a b c"]
    toks = [["<s>", *(t or "").split(), "</s>"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    three, raw, words = collections.Counter(), collections.Counter(), collections.Counter()
    for t, h in zip(toks, held, strict=True):
        if not h:
            three.update(zip(t, t[1:], t[2:]))
            raw[t[0], t[1]] += 1
            words.update(t[1:])
    two = collections.Counter(raw)
    two.update((v, w) for _, v, w in three)
    one = collections.Counter(w for _, w in two)
    d3, d2, d1 = (lm.discounts(*[sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for c in (three, two, one))
    rest = sum(d1[min(k, 3)] for k in one.values()) / len(two)

    def level(grams, d, context, w, low):
        after = [k for g, k in grams.items() if g[:-1] == context]
        k = grams.get((*context, w), 0)
        return (max(k - d[min(k, 3)], 0) + sum(d[min(x, 3)] for x in after) * low) / sum(after) if after else low

    def p(u, v, w):
        low = max(one[w] - d1[min(one[w], 3)], 0) / len(two) + rest / (len(words) + 1)
        low = level(two, d2, (v,), w, low)
        return low if u is None else level(three, d3, (u, v), w, low)

    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(documents(spark, texts), order=3).collect()}
    for i, t in enumerate(toks):
        assert math.isclose(got[i], sum(math.log10(p(t[k - 2] if k > 1 else None, t[k - 1], t[k])) for k in range(1, len(t))), rel_tol=1e-9)
    for u, v in (("a", "b"), (None, "<s>"), ("b", "c"), ("no", "no")):
        assert math.isclose(sum(p(u, v, w) for w in words) + p(u, v, "never seen"), 1.0, rel_tol=1e-9)


def test_language_model_query_uses_longer_contexts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mean = lambda df: df.where("held_out").selectExpr("sum(score) / sum(n_tokens)").first()[0]
    assert mean(queries.op8_kneser_ney(spark, sf_dir)) > mean(lm.lm_scores(docs, order=2))


def leaks(spark, item, texts):
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    return {r["doc_id"]: r for r in decontaminate.leaks(documents(spark, texts), benchmark).collect()}


def test_slots_count_in_matched_windows_only(spark):
    head = "the shop sold 12 red apples to the old baker and then 7 green pears to the young cook who came by"
    item = f"{head} later with 12 more and 7 less"
    verbatim = f"{head} today with 55 more and 66 less"  # the tail's numbers stand in the head as well
    wrong = item.replace("12", "31", 1)  # 12 stands for 31 and 12
    twice = f"{wrong} . {'so it goes on and on in between ' * 3} {item}"
    assert set(leaks(spark, item, [verbatim, wrong, twice])) == {0, 2}


def test_parameters_of_any_form(spark):
    item = "Tom has 5 red apples in a basket. Tom gives 2 of them to a friend. Ann buys 3 more at the shop. How many apples are there now?"
    changed = item.replace("Tom", "Sam").replace("Ann", "Eve").replace("5", "1,500").replace("2", "7.25").replace("3", "11")
    longer = changed.replace("Sam", "Mary Jones").replace("Eve", "Lee O'Neill Stone")
    lines = "\n".join(changed.split(". "))
    inserted = item.replace("them to", "them right to")  # 6 and 9 of 22 windows along two offsets
    mixed = changed.replace("Sam gives", "Bob gives")  # Tom stands for Sam and Bob
    got = leaks(spark, item, [item, changed, longer, lines, inserted, mixed])
    assert set(got) == {0, 1, 2, 3, 4}
    assert got[1]["matched_windows"] == got[3]["matched_windows"] == got[1]["n_windows"] and got[1]["new_slots"] == 5 and got[4]["new_slots"] == 0
    assert set(leaks(spark, item, [item.upper(), item.lower(), item.replace("Ann", "ann")])) == {0, 1, 2}


def test_jaccard_ties_repeated_ids(spark):
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue white black grey")
    rows = spark.createDataFrame([(7, a), (7, b), (3, a), (2, b), (9, c), (9, ""), (1, c), (5, "")], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in jaccard.similarity_classes(rows, 4, 85, 100).collect())
    assert got == {(7, 2): 2, (3, 2): 1, (2, 2): 1, (9, 1): 2, (1, 1): 1, (5, 5): 1}


def test_jaccard_hot_class_and_bands(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choices(words, k=40)) for _ in range(6)]
    texts = [base[0]] * 60 + [" ".join(t.split()[:k]) for t in base for k in (40, 39, 37, 36, 34)]
    docs = documents(spark, texts)
    sets = [frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for _ in range(6):
        for i, x in enumerate(sets):
            for j in range(i):
                if 100 * len(x & sets[j]) >= 85 * len(x | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    for hot in (1 / 2000, 1 / 3):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(jaccard, "HOT", hot)
            assert {r["doc_id"]: r["component_id"] for r in jaccard.similarity_classes(docs, 4, 85, 100).collect()} == dict(enumerate(label))


def test_components_by_themselves(spark):
    r = random.Random(4)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(40)], [(r.randrange(60), r.randrange(60)) for _ in range(45)]):
        want = {}
        for u, v in edges:
            if u != v:
                want.setdefault(u, u), want.setdefault(v, v)
        for _ in edges:
            for u, v in edges:
                if u != v:
                    want[u] = want[v] = min(want[u], want[v])
        df = spark.createDataFrame(edges, "u long, v long")
        assert {x["node"]: x["component"] for x in components.connected_components(df).collect()} == want


def plain_leaks(docs, items):
    """Pairs by plain loops: canonical windows at each offset or at near ones, and slots that stand for one value."""
    def tokens(text, name):
        t = (text or "").translate({1: " ", 2: " "})
        if name:
            t = regex.sub(name, " \u0001a\\1 ", regex.sub(decontaminate.JOIN, "\u0002", t))
        t = regex.sub(decontaminate.POINT, "\u0002", regex.sub(decontaminate.GROUPING, "", t))
        t = regex.sub(decontaminate.NUMBER, lambda m: f" \u0001n{m[1]} \u0001u{m[2] or ''} ", t)
        return [w for w in regex.split(decontaminate.SPLIT, t.lower()) if w not in ("", "\u0001u")]

    canon = lambda raw: [w[:2] if w[0] == "\u0001" else w for w in raw]
    parts = lambda c: {i: tuple(c[i : i + 8]) for i in range(len(c) - 7)}
    out = set()
    read = {d: tokens(t, decontaminate.NAME) for d, t in docs}
    places = {}
    for d, raw in read.items():
        for p, w in parts(canon(raw)).items():
            places.setdefault(w, []).append((d, p))
    for item, text in items:
        for name in decontaminate.READINGS:
            raw = tokens(text, name)
            counted = {i: w for i, w in parts(canon(raw)).items() if sum(x[0] != "\u0001" for x in w) >= 4}
            shifts = collections.defaultdict(lambda: collections.defaultdict(set))
            for i, w in counted.items():
                for d, p in places.get(w, ()):
                    shifts[d][p - i].add(i)
            for d, at in shifts.items():
                tries = [{s: x} for s, x in at.items()]
                for g in {s // 8 + k for s in at for k in (-1, 0)}:
                    inside = sorted((s for s in at if s // 8 - g in (0, 1)), key=lambda s: (-len(at[s]), s))
                    got, seen = {}, set()
                    for s in inside if len(inside) > 1 else ():
                        got[s] = at[s] - seen
                        seen |= at[s]
                    tries.append(got)
                for t in tries:
                    if sum(map(len, t.values())) < 0.5 * len(counted):
                        continue
                    faces = {(raw[i + k], read[d][i + k + s]) for s, x in t.items() for i in x for k in range(8)}
                    faces = {(a, b) for a, b in faces if a[0] == "\u0001"}
                    if t and len({a for a, _ in faces}) == len(faces):
                        out.add((d, item))
    return out


def test_decontamination_equals_plain_loops(spark, sf_dir):
    r = random.Random(6)
    folder = sf_dir.replace("0.001", "0.01")
    bench = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = [x["text"] for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    names = ["Ann", "Bob Lee", "Mary", "Tom", "Eve O'Hara"]
    for k in range(60):
        item = bench[k % len(bench)][1] if k % 3 else f"{names[k % 5]} has {k} red apples in a basket and {names[(k + 1) % 5]} buys {k % 7 + 3} more at the shop every day"
        if k < 3 * len(names):
            bench.append((10_000 + k, item))
        w = item.split(" ")
        for _ in range(r.randrange(4)):
            i = r.randrange(len(w))
            w[i : i + r.randrange(2)] = r.choice([["12"], ["3.5"], ["Zoe"], ["so", "it"], []])
        texts.append("Before that. " + " ".join(w) + f" after {names[k % 5]}")
    want = plain_leaks(list(enumerate(texts)), bench)
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(documents(spark, texts), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == want and len(want) > 50


def test_items_without_windows_match_as_they_stand(spark):
    items = [(1, "What is the capital of France?"), (2, "12 + 7 = 19, 4 + 5 = 9, 3 + 3 = 6, 2 + 8 = 10"), (3, "Why?"), (4, None)]
    texts = ["So: what is the Capital of France? Paris", "what is the capital of Spain", "12 + 7 = 19 4 + 5 = 9 3 + 3 = 6 2 + 8 = 10 done", "12 + 7 = 19 4 + 5 = 9 3 + 3 = 6 2 + 8 = 11", "why", None, "x " + "what is the capital of france " * 2]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(documents(spark, texts), bench).collect()} == {(0, 1), (2, 2), (6, 1)}


def test_leaks_under_repeated_ids_and_clashing_columns(spark, monkeypatch):
    item = "the shop sold 12 red apples to the old baker and then 7 green pears to the young cook"
    rows = [(1, item, "a"), (1, "another text of the same id", "b"), (None, item, "c"), (None, "kept", "d"), (0, "kept as well", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string").withColumn("_h", F.col("_id")).withColumn("_key", F.col("_id"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for bound in (decontaminate.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
        kept = decontaminate.clean(docs, bench)
        assert kept.columns == docs.columns and sorted((r["_id"], r["_h"], r["_key"]) for r in kept.collect()) == [(x,) * 3 for x in "bde"]
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(shared, "BROADCAST_IDS", 0)
    assert decontaminate.clean(docs, bench).count() == 3


def record(payload, kind="response", more=(), content="text/html", digest=None):
    heads = [("WARC-Type", kind), ("WARC-Record-ID", "<urn:uuid:1234>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", content), *more]
    if digest:
        heads.append(("WARC-Payload-Digest", digest))
    heads.append(("Content-Length", str(len(payload))))
    return b"WARC/1.0\r\n" + "".join(f"{a}: {b}\r\n" for a, b in heads).encode() + b"\r\n" + payload + b"\r\n\r\n"


def test_archives_of_other_writers(spark):
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    body = b"<p>hello</p>"
    chunked = b"5\r\n<p>he\r\n7\r\nllo</p>\r\n0\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    records = [
        record(b"software: x", "warcinfo", content="application/warc-fields"),
        record(http + body, digest=sha(body), content="application/http; msgtype=response"),
        record(http + chunked, digest=sha(body), content="application/http;msgtype=response"),
        record(body, "resource", digest="sha256:" + hashlib.sha256(body).hexdigest()),
        record(b"", "revisit", more=[("WARC-Concurrent-To", "<urn:a>"), ("WARC-Concurrent-To", "<urn:b>")], digest=sha(body)),
        record(body, digest="blake9:whatever"),
    ]
    plain = zstd.ZstdCompressor(write_content_size=False)

    def streamed(data):
        c = plain.compressobj()
        return c.compress(data) + c.flush()

    archive = b"".join(streamed(x) for x in records)
    frame = spark.createDataFrame([("a", archive)], "archive string, content binary")
    got = [(r["record_type"], r["page_id"], r["payload_bytes"], bytes(r["payload"] or b"")) for r in warc.read_archives(frame).collect()]
    assert got == [("warcinfo", None, 11, b"software: x"), ("response", None, 12, body), ("response", None, len(chunked), chunked), ("resource", None, 12, body), ("revisit", None, None, b""), ("response", None, 12, body)]
    assert warc.parse_record(records[4])[0]["warc-concurrent-to"] == "<urn:a>, <urn:b>"
    lead = struct.pack("<II", warc.DICTIONARY_MAGIC, 4) + b"abcd"
    assert len(list(warc.read_records(lead + archive))) == 6
    bad = [
        lead + archive + struct.pack("<II", 0x184D2A50, 9) + b"short", archive + b"xy", archive[:-1], lead[:-1], b"abc", streamed(records[0])[:6],
        streamed(records[1].replace(b"hello", b"hallo")), streamed(record(body, more=[("WARC-Block-Digest", sha(b"no"))])), streamed(record(body, more=[("WARC-Date", "again")])),
    ]
    for x in bad:
        with pytest.raises(ValueError):
            list(warc.read_records(x))


def test_batches_stay_bounded(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for before, after in (("10000", "500"), ("16", "16"), ("0", "500")):
        spark.conf.set(name, before)
        shared.bound_batches(spark)
        assert spark.conf.get(name) == after
