"""The ten operators against brute force, the libraries, or exact round trips, with null, empty, long, tied and repeated rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia_spark.llm import bpe, chat, decontaminate, jaccard, license_texts, licenses, lm, media, quality, queries, sharding, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \n\t ", "one", "one two three", "same text over and over " * 3000]


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def documents(spark, texts):
    rows = [(i, t, "en", "s", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(vocabulary, k=r.randrange(5, 200))) for _ in range(40)]
    near = []
    for t in base[:15]:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        near += [" ".join(w), t.upper(), t]
    return base + near + ODD + ["A b C d", "a B c D"]


def test_jaccard(spark, texts):
    for n, num, den in ((4, 85, 100), (5, 80, 100), (2, 50, 100)):
        got = {r["doc_id"]: r for r in jaccard.similarity_classes(documents(spark, texts), n, num, den).collect()}
        sets = []
        for t in texts:
            w = words(t)
            sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
        label = list(range(len(texts)))
        for _ in texts:
            for a in range(len(texts)):
                for b in range(a):
                    i = len(sets[a] & sets[b])
                    if i and den * i >= num * len(sets[a] | sets[b]):
                        label[a] = label[b] = min(label[a], label[b])
        assert all(got[i]["n_shingles"] == len(s) and got[i]["component_id"] == label[i] for i, s in enumerate(sets))


def test_jaccard_blocks_and_null_ids(spark, texts, monkeypatch):
    want = sorted((r["doc_id"], r["component_id"]) for r in jaccard.similarity_classes(documents(spark, texts), 4, 85, 100).collect())
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    monkeypatch.setattr(jaccard, "TRIE_SETS", 1)
    monkeypatch.setattr(jaccard, "HEAVY", 3)
    got = jaccard.similarity_classes(documents(spark, texts).union(documents(spark, ["a b c d e"]).withColumn("doc_id", F.lit(None).cast("long"))), 4, 85, 100).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == want
    assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(2, None)]
    docs = documents(spark, texts)
    kept = jaccard.deduplicate(docs.union(docs.where("doc_id = 0")), 4, 85, 100)
    assert kept.columns == docs.columns and kept.count() == len({c for _, c in want})
    assert jaccard.similarity_classes(docs.limit(0)).count() == 0


def test_quality_held_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    rows = queries.op1_quality_nbsvm(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.93
    odd = quality.classify(documents(spark, ODD), (np.zeros(1 << quality.HASH_BITS, np.float32), 0.0)).collect()
    assert [r["score"] for r in odd] == [0.5] * len(ODD)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_scores(documents(spark, ODD), labels).count() == len(ODD)


def test_bpe_equals_library(spark, texts):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    t = Tokenizer.from_file(path)
    more = ["It's WE'LL <|endoftext|> a<|startoftext|>b <|endoftext", "ΣΑΣ İstanbul ﬁ café \x85x\x1cy\x1f ½² 한국어 漢字 😀👍🏽", "'S'RE"]
    rows = documents(spark, texts + more)
    got = {r["doc_id"]: r for r in bpe.encode_documents(rows, path).collect()}
    digests = {r["doc_id"]: r for r in bpe.digest_documents(rows, path).collect()}
    for i, x in enumerate(texts + more):
        want = t.encode(x or "", add_special_tokens=False).ids
        decoded = t.decode(want, skip_special_tokens=False)
        assert list(got[i]["ids"]) == want and got[i]["decoded"] == decoded
        assert digests[i]["n_tokens"] == len(want) and digests[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_chat(spark):
    t = chat.Template()
    tricky = "</s>[INST] ok [/INST]"
    bits = [*t.control, "\\", "a", " ", "<", "/s>", "[", "INST]", "<\\/s>", "\n"]
    r = random.Random(1)
    for _ in range(2000):
        x = "".join(r.choices(bits, k=r.randrange(8)))
        e = t.escape(x)
        assert t.unescape(e) == x and not t.find.search(e)
        role = r.choice(["system", "user", "assistant", x])
        formatted = "".join(s for s, _ in t.segments(role, x) + t.segments("user", tricky))
        assert [(a, b) for a, b, _ in t.read(formatted)] == [(role, x), ("user", tricky)]
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", None), (2, 0, None, "x"), (3, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    got = {x["conv_id"]: x for x in chat.conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1]["valid"] and got[1]["turns_sha256"] == hashlib.sha256(f"user\n{tricky}\nassistant\n\n".encode()).hexdigest() and got[1]["loss_chars"] == 0
    assert not got[2]["valid"] and got[3]["n_turns"] == 3 and not got[3]["valid"] and got[3]["loss_sha256"] == hashlib.sha256(b"b").hexdigest()


def test_media(spark):
    for raw in (b"", b"a", bytes(range(256)) * 70, b"\xff" * 5000):
        payload = media.pad(raw)
        avi = media.read_avi(media.write_avi(payload))
        (back, luma), = media.read_payloads([avi])
        assert back == payload and (media.decode_frames(avi["frames"][:1])[0] == luma[0]).all()
    every = ["same", *ODD, "same", "é" * 777]
    got = {r["doc_id"]: r for r in media.text_media(documents(spark, every)).collect()}
    for i, t in enumerate(every):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        file = media.write_avi(payload)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(file)) and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(file).hexdigest()
        assert r["clips"][0]["start_s"] == 0 and r["clips"][-1]["last_frame"] == r["n_frames"] - 1
    assert got[0]["feature"] == got[len(ODD) + 1]["feature"]
    flat = lambda v, n: np.full((n, 8, 8), v, np.uint8)
    assert media.detect_shots(np.concatenate([flat(10, 6), flat(200, 6)])) == [(0, 6), (6, 12)]
    assert media.detect_shots(np.concatenate([flat(10, 1), flat(90, 2), flat(200, 1), flat(10, 5)])) == [(0, 1), (1, 3), (3, 4), (4, 9)]


def entropy_coded(values, h, restart, parts, tables):
    """A scan by plain sequential coding; values: blocks of each unit as (component, 64 coefficients in zigzag order)."""
    code_of = {}
    for key, body in tables.items():
        code, at = 0, 16
        for length in range(1, 17):
            for _ in range(body[length - 1]):
                code_of[key, body[at]] = format(code, f"0{length}b")
                at, code = at + 1, code + 1
            code <<= 1
    amp = lambda v: (n := abs(v).bit_length(), format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else "")
    out, bits, last = b"", "", {}

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""
        return raw

    for k, unit in enumerate(values):
        if restart and k and k % restart == 0:
            out += flush() + bytes([0xFF, 0xD0 + (k // restart - 1) % 8])
            last = {}
        for name, block in unit:
            t = tables_of[name]
            n, b = amp(int(block[0]) - last.get(name, 0))
            last[name] = int(block[0])
            bits += code_of[(0, t), n] + b
            zeros = 0
            for v in block[1:]:
                if not v:
                    zeros += 1
                    continue
                while zeros > 15:
                    bits, zeros = bits + code_of[(1, t), 0xF0], zeros - 16
                n, b = amp(int(v))
                bits, zeros = bits + code_of[(1, t), zeros << 4 | n] + b, 0
            if zeros:
                bits += code_of[(1, t), 0]
    return out + flush()


tables_of = {1: 0, 2: 1, 3: 1}


def colour_frame(r, width, height, restart, with_tables):
    wide, high = -(-width // 16), -(-height // 16)

    def block():
        out = np.zeros(64, int)
        out[0] = r.randrange(-60, 60)
        for _ in range(r.randrange(6)):
            out[r.randrange(1, 64)] = r.randrange(-30, 31)
        return out

    units = [[(1, block()) for _ in range(4)] + [(2, block()), (3, block())] for _ in range(wide * high)]
    scan = entropy_coded(units, 2, restart, None, media.STANDARD)
    seg = media._segment
    head = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([2]) * 64)
    head += seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    for (cls, k), body in media.STANDARD.items() if with_tables else ():
        head += seg(0xC4, bytes([cls << 4 | k]) + body)
    head += seg(0xDD, restart.to_bytes(2, "big")) if restart else b""
    return head + seg(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + scan + b"\xff\xd9", units


def test_media_decodes_colour_frames_of_any_tables():
    r = random.Random(3)
    for width, height, restart, tables in ((16, 16, 0, True), (50, 35, 2, False), (33, 64, 1, True), (64, 48, 0, False)):
        frame, units = colour_frame(r, width, height, restart, tables)
        j = media._parse_jpeg(frame)
        got, = media.decode_coefficients([j])
        wide = media._units(j)[0]
        for k, unit in enumerate(units):
            y, x = divmod(k, wide)
            have = [got[1][2 * y + a, 2 * x + b] for a in (0, 1) for b in (0, 1)] + [got[2][y, x], got[3][y, x]]
            assert all((a == b).all() for a, (_, b) in zip(have, unit, strict=True))
        assert media.decode_frames([frame])[0].shape == (height, width, 3)
        with pytest.raises(ValueError):
            media.decode_frames([frame[: len(frame) // 2] + b"\xff\xd9"])
        with pytest.raises(ValueError):
            media.decode_frames([frame[:-2]])


def avi_of(frames, micro=40_000, rate=(1, 25), second=()):
    c, ls = media._chunk, media._list
    import struct

    avih = struct.pack("<14I", micro, 0, 0, 0, len(frames), 0, 1, 0, 16, 16, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, *rate, 0, len(frames), 0, 0, 0, 0, 0, 16, 16)
    hdrl = ls(b"hdrl", c(b"avih", avih), ls(b"strl", c(b"strh", strh)))
    out = c(b"RIFF", b"AVI " + hdrl + ls(b"movi", *[c(b"00dc", f) for f in frames]))
    return out + (c(b"RIFF", b"AVIX" + ls(b"movi", *[c(b"00dc", f) for f in second])) if second else b"")


def test_clips(spark):
    def grey(value):
        units = [[(1, np.array([value] + [0] * 63))] for _ in range(4)]
        scan = entropy_coded(units, 1, 0, None, media.STANDARD)
        seg = media._segment
        return b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([8]) * 64) + seg(0xC0, bytes([8, 0, 16, 0, 16, 1, 1, 0x11, 0])) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"

    dark, light = grey(-100), grey(90)
    files = [(1, avi_of([dark] * 2 + [light])), (2, avi_of([dark], 0, (0, 0))), (3, b"RIFFxxxxWAVE"), (4, avi_of([dark])[:-5]), (5, None), (6, avi_of([dark] * 3, 0, (1, 10), [light] * 2)), (7, avi_of([]))]
    rows = [tuple(r) for r in media.clips(spark.createDataFrame(files, "media_id long, content binary")).orderBy("media_id", "clip").collect()]
    assert [r[:6] for r in rows if r[0] != 3 and r[0] != 4] == [(1, 0, 0.0, 0.08, 0, 1), (1, 1, 0.08, 0.12, 2, 2), (2, 0, None, None, 0, 0), (6, 0, 0.0, 0.3, 0, 2), (6, 1, 0.3, 0.5, 3, 4)]
    assert [r[0] for r in rows if r[6]] == [3, 4]


def test_warc(spark):
    pages = [(3, "u", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (4, "u\r\nx", "é" * 100_000), (1, "u", "same"), (None, "u", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(df)
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_index(archives).collect())
    first = {"same": 1, "": 2, "é" * 100_000: 4}
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        seen = first[h or ""]
        want.append((i or 0, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == seen else "revisit", None if i == seen else seen))
    assert got == sorted(want, key=lambda r: r[:4])
    assert {r["payload"] for r in warc.read_archives(archives).where("record_type = 'response'").collect()} == {b"same", b"", ("é" * 100_000).encode()}
    assert warc.write_archives(df.limit(0)).count() == 0
    good = warc.make_record(1, "u", b"abc", None)
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"abc", b"abd"), good.replace(b"Content-Length: 3", b"Content-Length: x")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    w = warc.ArchiveWriter(b"abcd" * 50)
    w.add(good)
    with pytest.raises(ValueError):
        list(warc.read_records(w.finish()[:-3]))


def test_decontaminate(spark):
    item = "Alice had 12 apples and gave Bob 5 apples so how many of the 12 apples are left for the market"
    other = "A train leaves the old station at noon and travels for 3 hours with 80 km done every single hour before it stops"
    benchmark = spark.createDataFrame([(1, "and " + item), (2, other), (3, "too short"), (4, None), (None, other)], "item_id long, text string")
    changed = "so and " + item.replace("12", "31").replace("5", "9")
    wrong = "so and " + item.replace("12", "31", 1).replace("5", "9")  # 12 would stand for 31 and 12
    docs = documents(spark, [f"Before. And {item}. After", changed, wrong, other.replace("80 km", "70 miles"), "train station apples " * 50, *ODD])
    pairs = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs.union(docs.where("doc_id = 3")), benchmark).collect()}
    assert set(pairs) == {(0, 1), (1, 1), (3, 2)} and pairs[(0, 1)]["new_slots"] == 0 and pairs[(1, 1)]["new_slots"] > 0
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(docs.count())) - {0, 1, 3}
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), benchmark).count() == 0


def test_decontaminate_whole_passages(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet").toPandas() for t in ("documents", "benchmark"))
    want = {(d, b) for d, t in zip(docs.doc_id, docs.text) for b, x in zip(bench.item_id, bench.text) if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontaminate(spark, sf_dir.replace("0.001", "0.01")).collect()}
    assert got >= want and len(got - want) <= 2


def test_language_model(spark, texts):
    every = texts * 2
    rows = documents(spark, every)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(every))]
    got = {r["doc_id"]: r for r in lm.lm_scores(rows, order=2).collect()}
    toks = [words(t) + [None] for t in every]
    c, pairs, before = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for t, h in zip(toks, held, strict=True):
        if not h:
            c.update(t)
            pairs.update(zip(["<s>", *t[:-1]], t, strict=True))
    for v, w in pairs:
        before[w].add(v)
    n, v = sum(c.values()), len(c)
    times = lambda counts: lm.discounts(*[sum(x == k for x in counts) for k in (1, 2, 3, 4)])
    d2, d1 = times(pairs.values()), times([len(s) for s in before.values()])
    kinds = sum(map(len, before.values()))
    rest = sum(d1[min(len(s), 3)] for s in before.values()) / kinds
    after = collections.defaultdict(list)
    for (a, _), k in pairs.items():
        after[a].append(k)

    def p(a, w):
        k = len(before.get(w, ()))
        low = max(k - d1[min(k, 3)], 0) / kinds + rest / (v + 1)
        if a not in after:
            return low
        k = pairs.get((a, w), 0)
        return (max(k - d2[min(k, 3)], 0) + sum(d2[min(x, 3)] for x in after[a]) * low) / sum(after[a])

    for i, t in enumerate(toks):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (held[i], len(t), n, sum(c[w] > 0 for w in t))
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(a, w)) for a, w in zip(["<s>", *t[:-1]], t, strict=True)), rel_tol=1e-9)
    a = next(iter(after))
    assert math.isclose(sum(p(a, w) for w in c) + p(a, "never seen"), 1.0, rel_tol=1e-9)
    assert lm.lm_scores(rows.limit(0)).count() == 0


def plain(template):
    return template.replace("{", "").replace("}", "")


def test_licenses(spark):
    templates = license_texts.templates()
    mit = "Released under the MIT License."
    edited = plain(templates["MIT-text"]).replace("free of charge", "FREE of any charge").replace("sublicense", "relicense")
    docs = documents(spark, [f"Text é.\n{mit}\nMore {mit}", edited, "nothing of the kind under the sun", f"x {plain(templates['Apache-2.0'])}", *ODD])
    got = collections.defaultdict(list)
    for r in licenses.scan(docs).collect():
        got[r["doc_id"]].append(r)
    assert sorted(got) == [0, 1, 3] and [r["license"] for r in got[0]] == ["MIT", "MIT"] and got[1][0]["license"] == "MIT-text" and 0.9 < got[1][0]["coverage"] < 1
    assert got[0][0]["start"] == 8 and got[3][0]["license"] == "Apache-2.0"
    index = licenses.Index(templates)
    for name, t in templates.items():
        assert [(m[0], m[1]) for m in licenses.scan_text(f"before {plain(t)} after", index)] == [(name, 1.0)]


def test_licenses_are_told_apart():
    index = licenses.Index(license_texts.templates())
    names = lambda text: [m[0] for m in licenses.scan_text(text, index)]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0"]
    assert names("Licensed under CC BY-ND 4.0.") == ["CC-BY-ND-4.0"] and names("Licensed under CC BY-NC-SA 3.0!") == ["CC-BY-NC-SA-3.0"]
    assert names("Licensed under the Apache License, Version 1.1") == ["Apache-1.1"] and names("Licensed under the Apache License, Version 9.9") == []
    assert names("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.") == ["AGPL-3.0-or-later"]
    three = license_texts.TEXTS["BSD-3-Clause"].replace("the copyright holder nor", "ACME Corp nor").replace("are met: Re", "are met:\n1. Re")
    assert names(three) == ["BSD-3-Clause"] and names(license_texts.TEXTS["BSD-2-Clause"]) == ["BSD-2-Clause"]


def test_alignment_and_candidates_equal_plain_search():
    r = np.random.default_rng(8)
    for _ in range(60):
        template = r.integers(0, 12, r.integers(3, 25)).astype(np.uint64)
        words = r.integers(0, 12, r.integers(1, 60)).astype(np.uint64)
        shift, band = int(r.integers(-4, 20)), int(r.integers(1, 6))
        best = {}
        for i in range(template.size + 1):  # longest common subsequence within the band, by plain recursion over cells
            for j in range(-1, words.size):
                if not i:
                    best[i, j] = 0
                    continue
                near = abs(j - (i - 1 + shift)) <= band
                best[i, j] = max(best[i - 1, j], best.get((i, j - 1), 0), best.get((i - 1, j - 1), 0) + int(near and j >= 0 and words[j] == template[i - 1]))
        got = licenses.align(template, words, shift, band)
        assert len(got) == best[template.size, words.size - 1]
        assert all(template[i] == words[j] and abs(j - i - shift) <= band for i, j in got) and got == sorted(got) and len({j for _, j in got}) == len(got)
    index = licenses.Index(license_texts.templates())
    for t, words in enumerate(index.words):  # any run of K + W - 1 words of a template is a candidate at its place, in parts any with PART_HITS windows
        length = licenses.K + licenses.W * (1 if index.part[t] is None else licenses.PART_HITS) - 1
        for a in range(words.size - length + 1):
            run = np.concatenate([r.integers(0, 1 << 60, 7).astype(np.uint64), words[a : a + length], r.integers(0, 1 << 60, 7).astype(np.uint64)])
            assert any(u == t and abs(s - (7 - a)) <= index.band(t) for u, s in index.candidates(run))


def test_sharding(spark, texts):
    every = texts * 3 + ["hot"] * 4000
    size = [len((t or "").encode()) + 8 for t in every]
    for split in (None, 0.125):
        rows = sharding.assign_shards(documents(spark, every), 24, split).toPandas().set_index("doc_id")
        assert list(rows.loc[range(len(every)), "size"]) == size
        assert all(rows.loc[i, "text_crc32"] == zlib.crc32((t or "").encode()) for i, t in enumerate(every))
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard")) and rows.shard.between(0, 23).all()
        texts_of = rows.assign(t=[every[i] for i in rows.index])
        limit = sum(size) / 24 * split if split else sum(size)
        together = [g.shard.nunique() for _, g in texts_of.groupby("t", dropna=False) if g["size"].sum() <= limit]
        assert len(together) > 40 and set(together) == {1}
        assert split is None or rows[rows["size"] == 11].shard.nunique() > 1
    assert sharding.assign_shards(documents(spark, []), 24).count() == 0


def test_sharding_balance_and_blocks(spark, monkeypatch):
    r = random.Random(9)
    docs = documents(spark, [f"text {i} " * r.randrange(1, 20) for i in range(6000)] + ["copy of a text"] * 200).withColumn("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id")))
    for blocks, slots in ((100_000, 200_000), (50, 20)):
        monkeypatch.setattr(sharding, "BLOCK_GROUPS", blocks)
        monkeypatch.setattr(sharding, "SLOT_ROWS", slots)
        rows = sharding.assign_shards(docs, 24).toPandas()
        sums = rows.groupby("shard")[["size", "tokens"]].sum().assign(n=rows.groupby("shard").size())
        assert len(sums) == 24 and (sums.max() / sums.mean()).max() < 1.03
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))


def test_pack_is_the_greedy_rule():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 50, (60, 3)).astype(float)
    capacity = sizes.sum(axis=0) / 5
    got, used = sharding.pack(sizes, capacity, np.zeros((5, 3))), np.zeros((5, 3))
    for x, b in zip(sizes, got, strict=True):
        worth = [sum((1 - used[k][d] / capacity[d]) * x[d] / capacity[d] for d in range(3)) for k in range(5)]
        fits = [all(used[k][d] + x[d] <= capacity[d] + 1e-9 for d in range(3)) for k in range(5)]
        if any(fits):
            assert fits[b] and math.isclose(worth[b], max(worth[k] for k in range(5) if fits[k]))
        else:
            over = [max((used[k][d] + x[d]) / capacity[d] for d in range(3)) for k in range(5)]
            assert math.isclose(over[b], min(over))
        used[b] += x


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
            docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count() == out.count()


def test_license_bodies():
    """Whole texts are found as themselves, with changed words, lost lines and inserted page heads; prose that shares phrases isn't."""
    index, bodies = licenses.Index(license_texts.templates()), license_texts.bodies()
    assert len(bodies) == 16
    for name, text in bodies.items():
        assert [(m[0], m[1]) for m in licenses.scan_text(f"before\n{text}\nafter", index)] == [(name, 1.0)]
        lines = text.splitlines()
        if len(lines) < 60:  # not wrapped as published
            lines = [" ".join(text.split()[i : i + 12]) for i in range(0, len(text.split()), 12)]
        edited = "\n".join(f"{line}\npage {i}" if i % 60 == 59 else line for i, line in enumerate(lines) if i % 20 != 7)
        got = licenses.scan_text(edited.replace(" the ", " THE  "), index)
        kept = sum(licenses.words_of(line)[0].size for i, line in enumerate(lines) if i % 20 != 7)
        assert [m[0] for m in got] == [name] and 0.9 * kept < got[0][2] <= kept, (name, got)
    pieces = " ".join(" ".join(t.split()[100:112]) for t in bodies.values())
    assert licenses.scan_text(pieces, index) == []
