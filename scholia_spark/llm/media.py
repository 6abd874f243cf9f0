"""Media columns: AVI motion-JPEG.

``write_avi`` stores bytes losslessly: each 64 bytes are the 64 quantised coefficients of a block, all of magnitude
category 8, whose 8 amplitude bits are the byte itself (so every coefficient is one Huffman code and one byte); each block
is a restart interval. ``read_avi`` walks the RIFF trees and the idx1 index. ``decode_frames`` is a baseline decoder (grey
and YCbCr with subsampling, any Huffman tables, the standard ones where a frame has none): all restart intervals of frames
that share tables are decoded in step, one symbol of each at a time. ``detect_shots`` cuts where the histogram difference
exceeds the mean plus two deviations of the differences before it that were no cuts, and a floor.

Defined cases: null texts are empty; the payload is padded with zero bytes to a positive multiple of 64; equal texts give
equal files (nothing depends on place or time); repeated rows give repeated results; an empty table gives no rows. In
``clips`` a broken file gives one row that names its error, a file without frames none, and times are null without a rate.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia_spark.llm import shared
from scholia_spark.llm.textkit import batches

FPS = 25
_U64 = np.uint64
#: Characters of text, and frames of a file, that are decoded at once: what a worker holds.
DECODE_BYTES = 1 << 20
FRAMES_AT_ONCE = 8
#: Fixed value: order of coefficients in a block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(cls: int) -> bytes:
    """A table with one code of 8 bits, for symbol 8."""
    return _segment(0xC4, bytes([cls << 4]) + bytes([0] * 7 + [1] + [0] * 8) + bytes([8]))


def _jpeg_head(width: int, height: int) -> bytes:
    return (
        b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1]) * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
        + _dht(0) + _dht(1) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _frames(payload: np.ndarray, side: int) -> list[bytes]:
    """JPEG frames of side x side blocks (the last one padded with zero bytes)."""
    per = side * side
    n = -(-payload.size // (64 * per))
    blocks = np.zeros((n, per, 64), np.uint8)
    blocks.reshape(-1)[: payload.size] = payload
    scan = np.zeros((n, per, 130), np.uint8)
    scan[:, :, 1:128:2] = blocks
    scan[:, :, 128] = 0xFF
    scan[:, :, 129] = 0xD0 + np.arange(per) % 8
    head, out = _jpeg_head(side * 8, side * 8), []
    stuffed = (blocks == 0xFF).any(axis=(1, 2))
    for i in range(n):
        if stuffed[i]:
            body = b"".join(scan[i, k, :128].tobytes().replace(b"\xff", b"\xff\x00") + scan[i, k, 128:].tobytes() for k in range(per))[:-2]
        else:
            body = scan[i].tobytes()[:-2]
        out.append(head + body + b"\xff\xd9")
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", kind + b"".join(chunks))


def write_avi(payload: bytes) -> bytes:
    """The payload (a positive multiple of 64 bytes) as a motion-JPEG AVI file."""
    data = np.frombuffer(payload, np.uint8)
    side = min(8, max(1, int(np.ceil(np.sqrt(data.size // 64)))))
    frames = _frames(data, side)
    size = side * 8
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, 0, size, size, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, size, size)
    strf = struct.pack("<IiiHH4sIiiII", 40, size, size, 1, 24, b"MJPG", size * size * 3, 0, 0, 0, 0)
    hdrl = _list(b"hdrl", _chunk(b"avih", avih), _list(b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"ICMT", b"payload_bytes=%d\0" % len(payload)))
    at, chunks, index = 4, [], []
    for f in frames:
        chunks.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(chunks[-1])
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _list(b"movi", *chunks) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, at: int, end: int):
    """(name, body, size) of the chunks between two places; those of LISTs but movi follow their LIST."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError(f"chunk {name!r} exceeds its parent")
        yield name, at + 8, size
        if name == b"LIST" and data[at + 8 : at + 12] != b"movi":
            yield from _walk(data, at + 12, at + 8 + size)
        at += 8 + size + size % 2


def _is_frame(name: bytes) -> bool:
    return name[2:] in (b"dc", b"db")


def _indexed(data: bytes, movi: int, index: list[tuple]) -> list[bytes]:
    """Frames that idx1 names; its offsets count from the movi list or from the file's start."""
    base = movi if data[movi + index[0][2] :][:4] == index[0][0] else 0
    out = []
    for name, _, offset, size in index:
        if _is_frame(name):
            if data[base + offset : base + offset + 4] != name or struct.unpack_from("<I", data, base + offset + 4)[0] != size:
                raise ValueError("index entry without its chunk")
            out.append(data[base + offset + 8 : base + offset + 8 + size])
    return out


def read_avi(data: bytes) -> dict:
    """width, height, fps (0 if unknown), comment, frames (bytes each) of an AVI file, found through idx1, or by walking movi where it has none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"width": 0, "height": 0, "fps": 0.0, "comment": "", "frames": []}
    at, lists, rate = 0, 0, 0.0
    while data[at : at + 4] == b"RIFF" and data[at + 8 : at + 12] in (b"AVI ", b"AVIX"):
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        if end > len(data):
            raise ValueError("the file is cut short")
        movis, index = [], None
        for name, body, size in _walk(data, at + 12, end):
            if name == b"LIST" and data[body : body + 4] == b"movi":
                movis.append((body, body + size))
            elif name == b"avih":
                micro, out["width"], out["height"] = struct.unpack_from("<I", data, body)[0], *struct.unpack_from("<II", data, body + 32)
                out["fps"] = 1e6 / micro if micro else 0.0
            elif name == b"strh" and data[body : body + 4] == b"vids" and not rate:
                scale, ticks = struct.unpack_from("<II", data, body + 20)
                rate = ticks / scale if scale else 0.0
            elif name == b"ICMT":
                out["comment"] = data[body : body + size].rstrip(b"\0").decode("latin-1")
            elif name == b"idx1":
                index = [struct.unpack_from("<4sIII", data, body + i) for i in range(0, size - 15, 16)]
        for k, (body, stop) in enumerate(movis):
            if index and not lists and not k:
                out["frames"] += _indexed(data, body, index)
            else:
                out["frames"] += [data[b : b + n] for name, b, n in _walk(data, body + 4, stop) if _is_frame(name)]
        lists += len(movis)
        at = end + end % 2
    if not lists:
        raise ValueError("no movi list")
    out["fps"] = rate or out["fps"]
    return out


#: Inverse DCT as exact integers times 2**12, so that equal blocks give equal samples wherever they stand in a batch.
_X = np.arange(8)
_COS = np.round(np.where(_X[:, None] == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _X[None, :] + 1) * _X[:, None] * np.pi / 16) * 4096)


def samples(coefficients: np.ndarray) -> np.ndarray:
    """8-bit samples (..., 8, 8) of dequantised blocks (..., 64) in natural order."""
    block = coefficients.reshape(*coefficients.shape[:-1], 8, 8).astype(np.float64)
    spread = np.matmul(np.matmul(_COS.T, block), _COS)
    return np.clip(np.floor(spread / 4096**2 + 128.5), 0, 255).astype(np.uint8)


def _table(counts: list[int], head: list[int], runs: bool) -> bytes:
    """Body of a DHT table: symbols ``head``, then the other ones in rising order (of ``runs``: 0-15 zeros before sizes 1-10)."""
    every = [r << 4 | n for r in range(16) for n in range(1, 11)] if runs else list(range(12))
    return bytes(counts + head + [x for x in every if x not in head])


#: The standard tables (class, number), for frames that bring none: codes of each length, and the first symbols.
STANDARD = {
    (0, 0): _table([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [], False),
    (0, 1): _table([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], [], False),
    (1, 0): _table([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], list(bytes.fromhex("0102030004110512213141061351610722711432 8191a1082342b1c11552d1f02433627282".replace(" ", ""))), True),
    (1, 1): _table([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], list(bytes.fromhex("00010203110405213106124151076171132232810814 4291a1b1c109233352f0156272d10a162434e125f1".replace(" ", ""))), True),
}


@lru_cache(64)
def _codes(body: bytes) -> np.ndarray:
    """By the next 16 bits: length of the code (0: none such) * 256 + symbol."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            if code >= 1 << length:
                raise ValueError("broken Huffman table")
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | body[at]
            at, code = at + 1, code + 1
        code <<= 1
    return out


def _parse_jpeg(data: bytes) -> dict:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, j = 2, {"q": {}, "h": dict(STANDARD), "restart": 0}
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                j["q"][body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                j["h"][(body[k] >> 4, body[k] & 15)] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif marker in (0xC0, 0xC1):
            _, j["height"], j["width"], n = struct.unpack_from(">BHHB", body)
            j["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            j["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            j["tables"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            end = data.rfind(b"\xff\xd9")
            if end < at or "parts" not in j or any(p[0] not in j["tables"] or p[3] not in j["q"] for p in j["parts"]):
                raise ValueError("a frame without its end, its header or its tables")
            j["scan"] = data[at:end]
            return j


def _units(j: dict) -> tuple[int, int]:
    """Units across and down; a unit holds the blocks of all components for one cell of the frame."""
    return -(-j["width"] // (8 * max(p[1] for p in j["parts"]))), -(-j["height"] // (8 * max(p[2] for p in j["parts"])))


def _segments(scan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a scan without stuffing and restart markers, and where each restart interval begins."""
    a = np.frombuffer(scan, np.uint8)
    behind = np.flatnonzero(a[:-1] == 0xFF) + 1
    after = a[behind]
    restart = behind[(after >= 0xD0) & (after <= 0xD7)]
    if (after[(after < 0xD0) | (after > 0xD7)] != 0).any():
        raise ValueError("a marker within the scan")
    keep = np.ones(a.size, bool)
    keep[behind] = False
    keep[restart - 1] = False
    return a[keep], np.append(0, np.cumsum(keep)[restart - 1]) if restart.size else np.zeros(1, np.int64)


def _in_step(data: np.ndarray, begin: np.ndarray, end: np.ndarray, units: np.ndarray, plan: list[tuple]) -> np.ndarray:
    """Coefficients (segments, units, blocks of a unit, 64) in zigzag order, one symbol of each segment at a time.

    begin, end: bytes of ``data`` of each segment; plan: (component, codes of DC, codes of AC) of each block of a unit.
    """
    padded = np.concatenate([data, np.zeros(12, np.uint8)])
    word = np.zeros(data.size + 1, _U64)  # 8 bytes from each place on
    for k in range(8):
        word |= padded[k : k + word.size].astype(_U64) << _U64(56 - 8 * k)
    at, last = begin * 8, end * 8
    out = np.zeros((begin.size, int(units.max(initial=0)), len(plan), 64), np.int16)
    sums = {name: np.zeros(begin.size, np.int64) for name, _, _ in plan}

    def symbol(which, codes):
        """Next symbol of the segments ``which``, and the value of its bits."""
        bit = at[which]
        window = word[np.minimum(bit >> 3, data.size)] << (bit & 7).astype(_U64)
        code = codes[(window >> _U64(48)).astype(np.int64)]
        length, size = code >> 8, code & 15
        if not length.all():
            raise ValueError("no such code")
        value = ((window << length.astype(_U64)) >> (_U64(63) - size.astype(_U64)) >> _U64(1)).astype(np.int64)
        value = np.where(value >> np.maximum(size - 1, 0), value, value - (1 << size) + 1)
        at[which] = bit + length + size
        return code & 255, np.where(size > 0, value, 0)

    for unit in range(out.shape[1]):
        active = np.flatnonzero(units > unit)
        for block, (name, dc, ac) in enumerate(plan):
            sums[name][active] += symbol(active, dc)[1]
            out[active, unit, block, 0] = sums[name][active]
            which, z = active, np.ones(active.size, np.int64)
            while which.size:
                code, value = symbol(which, ac)
                z = z + (code >> 4)
                if (z > 63)[code != 0].any():
                    raise ValueError("too many coefficients")
                going = code != 0  # 0 ends the block
                full = going.all()
                if not full:
                    which, z, value, code = which[going], z[going], value[going], code[going]
                out[which, unit, block, z] = value  # of 15, 0 the value is 0
                z = z + 1
                if (z > 63).any():
                    which, z = which[z < 64], z[z < 64]
    if (at > last).any() or (last - at > 7).any():
        raise ValueError("a restart interval of a wrong length")
    return out


def decode_coefficients(parsed: list[dict]) -> list[dict[int, np.ndarray]]:
    """Quantised coefficients (rows, columns, 64) of each component of each parsed frame, in zigzag order."""
    out: list = [None] * len(parsed)
    alike: dict = {}
    for i, j in enumerate(parsed):
        used = tuple((name, h, v, j["h"].get((0, j["tables"][name][0])), j["h"].get((1, j["tables"][name][1]))) for name, h, v, _ in j["parts"])
        alike.setdefault((used, j["restart"]), []).append(i)
    for (used, restart), at in alike.items():
        if any(dc is None or ac is None for *_, dc, ac in used):
            raise ValueError("a Huffman table is missing")
        plan = [(name, _codes(dc), _codes(ac)) for name, h, v, dc, ac in used for _ in range(h * v if len(used) > 1 else 1)]
        data, begin, end, units, size = [], [], [], [], 0
        for i in at:
            wide, high = _units(parsed[i] if len(used) > 1 else parsed[i] | {"parts": [(0, 1, 1, 0)]})
            scan, cuts = _segments(parsed[i]["scan"])
            step = restart or wide * high
            if cuts.size != -(-(wide * high) // step):
                raise ValueError("restart intervals are missing or too many")
            data.append(scan)
            begin.append(cuts + size)
            end.append(np.append(cuts[1:], scan.size) + size)
            units.append(np.minimum(step, wide * high - np.arange(cuts.size) * step))
            size += scan.size
        got = _in_step(np.concatenate(data), np.concatenate(begin), np.concatenate(end), np.concatenate(units), plan)
        first = 0
        for i, n in zip(at, units, strict=True):
            wide, high = _units(parsed[i] if len(used) > 1 else parsed[i] | {"parts": [(0, 1, 1, 0)]})
            rows = got[first : first + n.size].reshape(-1, len(plan), 64)[: wide * high]
            first, planes, block = first + n.size, {}, 0
            for name, h, v, *_ in used:
                h, v = (h, v) if len(used) > 1 else (1, 1)
                own = rows[:, block : block + h * v].reshape(high, wide, v, h, 64).transpose(0, 2, 1, 3, 4)
                planes[name], block = own.reshape(high * v, wide * h, 64), block + h * v
            out[i] = planes
    return out


def _planes(j: dict, coefficients: dict[int, np.ndarray]) -> np.ndarray:
    planes, h, v = [], max(p[1] for p in j["parts"]), max(p[2] for p in j["parts"])
    if len(j["parts"]) == 1:
        h, v = j["parts"][0][1:3]
    for name, ph, pv, q in j["parts"]:
        c = coefficients[name] * j["q"][q]
        natural = np.zeros_like(c)
        natural[..., ZIGZAG] = c
        plane = samples(natural).transpose(0, 2, 1, 3).reshape(c.shape[0] * 8, c.shape[1] * 8)
        planes.append(plane.repeat(v // pv, axis=0).repeat(h // ph, axis=1)[: j["height"], : j["width"]])
    return planes[0] if len(planes) == 1 else np.stack(planes, axis=-1)


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Samples of baseline frames: (height, width) grey, or (height, width, 3) YCbCr."""
    parsed = [_parse_jpeg(f) for f in frames]
    return [_planes(j, c) for j, c in zip(parsed, decode_coefficients(parsed), strict=True)]


def amplitudes(b: np.ndarray) -> np.ndarray:
    """Values of category 8 for 8 amplitude bits: 128..255, or -255..-128 without the leading bit."""
    b = b.astype(np.int64)
    return np.where(b >= 128, b, b - 255)


def read_payloads(avis: list[dict]) -> list[tuple[bytes, np.ndarray]]:
    """Stored bytes of each file of ``write_avi``, and its frames' samples (frames, height, width)."""
    parsed = [[_parse_jpeg(f) for f in a["frames"]] for a in avis]
    decoded, at, out = decode_coefficients([j for frames in parsed for j in frames]), 0, []
    for avi, frames in zip(avis, parsed, strict=True):
        got = np.stack([next(iter(c.values())) for c in decoded[at : at + len(frames)]])
        at += len(frames)
        natural = np.zeros(got.shape, np.int64)
        natural[..., ZIGZAG] = got
        luma = samples(natural).transpose(0, 1, 3, 2, 4).reshape(len(frames), got.shape[1] * 8, got.shape[2] * 8)
        data = np.where(got > 0, got, got + 255).astype(np.uint8).tobytes()
        out.append((data[: int(avi["comment"].partition("=")[2])], luma))
    return out


#: Differences on each side that a cut is held against.
RADIUS = 5


def detect_shots(luma: np.ndarray, bins: int = 32, ratio: float = 2.0, floor: float = 0.5) -> list[tuple[int, int]]:
    """(first, last + 1) frames of each shot.

    Two frames are cut apart where their histograms differ by more than ``floor`` x pixels, and by more than ``ratio`` times the
    median of the differences around (``RADIUS`` on each side, cuts among them). So a fade or any other steady change, whose
    differences are alike, is no row of cuts. A single frame between two alike is a flash and no shot.
    """
    n = len(luma)
    key = (np.arange(n)[:, None] * bins + (luma.reshape(n, -1) >> 3).astype(np.int64) * bins // 32).ravel()
    hist = np.bincount(key, minlength=n * bins).reshape(n, bins)
    differ = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    least = floor * luma[0].size
    cuts = [0]
    for i in np.flatnonzero(differ > least).tolist():
        around = np.concatenate([differ[max(0, i - RADIUS) : i], differ[i + 1 : i + 1 + RADIUS]])
        if not around.size or differ[i] > ratio * np.median(around):
            cuts.append(i + 1)
    flashes = {c for c, d in zip(cuts[1:], cuts[2:]) if d == c + 1 and np.abs(hist[c - 1] - hist[d]).sum() <= least}
    cuts = [c for c in cuts if c not in flashes and c - 1 not in flashes]
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw))


def _clip_rows(shots: list[tuple[int, int]], fps: float) -> list[dict]:
    return [{"clip": k, "start_s": a / fps if fps else None, "end_s": b / fps if fps else None, "first_frame": a, "last_frame": b - 1} for k, (a, b) in enumerate(shots)]


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_frames, clips (timed shots) of every row."""
    shared.bound_batches(docs.sparkSession)

    def rows(texts):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        media = [write_avi(pad(r)) for r in raw]
        avis = [read_avi(m) for m in media]
        for r, m, avi, (payload, luma) in zip(raw, media, avis, read_payloads(avis), strict=True):
            shots = detect_shots(luma)
            tones = np.bincount((luma >> 5).ravel(), minlength=8)
            feature = f"{avi['width']}x{avi['height']};frames={len(luma)};shots={','.join(f'{a}-{b}' for a, b in shots)};sum={int(luma.sum(dtype=np.int64))};tones={','.join(map(str, tones))}"
            yield (len(r), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature, len(luma), _clip_rows(shots, avi["fps"]))

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "clips"]

    def run(it):
        for pdf in it:
            texts, got = list(pdf["text"]), []
            for a, b in batches(texts, DECODE_BYTES):
                got += rows(texts[a:b])
            yield pd.DataFrame({"doc_id": pdf["doc_id"]}).assign(**{c: pd.Series([r[k] for r in got], dtype=object if c == "clips" else None) for k, c in enumerate(names)})

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, clips array<struct<clip: int, start_s: double, end_s: double, first_frame: int, last_frame: int>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema)


def file_clips(content: bytes) -> list[dict]:
    """Timed clips of one AVI file; frames are decoded a few at a time, and only their histograms' input (luma) is held."""
    avi, luma = read_avi(content), []
    for k in range(0, len(avi["frames"]), FRAMES_AT_ONCE):
        luma += [f if f.ndim == 2 else f[..., 0] for f in decode_frames(avi["frames"][k : k + FRAMES_AT_ONCE])]
    return _clip_rows(detect_shots(np.stack(luma)), avi["fps"]) if luma else []


def clips(files: DataFrame) -> DataFrame:
    """media_id, clip, start_s, end_s, first_frame, last_frame, error of each shot of AVI files (media_id, content): timed clip rows."""
    shared.bound_batches(files.sparkSession)
    names = ["clip", "start_s", "end_s", "first_frame", "last_frame"]

    def run(it):
        for pdf in it:
            for key, content in zip(pdf["media_id"], pdf["content"], strict=True):
                try:
                    out = [(key, *[c[n] for n in names], None) for c in file_clips(content)]
                except (ValueError, IndexError, struct.error) as e:
                    out = [(key, None, None, None, None, None, str(e) or type(e).__name__)]
                if out:
                    yield pd.DataFrame(out, columns=["media_id", *names, "error"]).astype({"clip": "Int32", "first_frame": "Int32", "last_frame": "Int32"})

    schema = "media_id long, clip int, start_s double, end_s double, first_frame int, last_frame int, error string"
    return files.where("content IS NOT NULL").select(F.col("media_id").cast("long"), "content").mapInPandas(run, schema)
