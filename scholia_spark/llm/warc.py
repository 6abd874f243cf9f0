"""WARC archives in Zstandard: the dictionary in a leading skippable frame, then one frame per record.

``write_archives`` makes archives as rows (archive, content) of bounded size, so that any store Spark writes can hold them
and a lost task is simply run again; ``read_archives`` loads the dictionary from the first frame (archives without one are
read, too), decodes frame by frame, whether or not a frame states its size, and validates version line, headers, lengths
and digests (of the block, and of the payload: the body of an HTTP message, else the block). Records with equal payloads of
at least ``min_bytes`` bytes are one response and revisits that name it.

Defined cases: null html is an empty payload; of equal payloads that with the smallest page_id is the response (rows that
repeat this page_id too are responses); rows with a null page_id come after all others, and where no page_id is known all
are responses; null urls are empty; other columns are ignored; an empty table gives no rows. Archives of other writers:
page_id and refers_to are null where a record id isn't ours, payload_bytes is null for revisits that don't state it, records
of other types are rows with their type, digests of unknown algorithms aren't checked; anything broken is a ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia_spark.llm import shared

#: Fixed value: magic number of the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
NO_DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    """The page_id in a record id of ``record_uri``; None for others."""
    found = re.fullmatch(r"<urn:page:(-?\d{1,19})>", uri)
    return int(found[1]) if found else None


#: Header fields that a record has once; the values of others are joined by commas.
SINGLE = {"warc-type", "warc-record-id", "warc-date", "content-length", "content-type", "warc-payload-digest", "warc-block-digest", "warc-refers-to", "warc-target-uri"}


def digest_matches(digest: str, data: bytes) -> bool:
    """Whether an ``algorithm:value`` digest (base32 or hexadecimal) is that of ``data``; unknown algorithms match."""
    name, _, value = digest.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return True
    raw = hashlib.new(name, data).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def _unchunked(body: bytes) -> bytes | None:
    """A chunked HTTP body put together, or None if it isn't one."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            return None
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        out.append(body[at : at + n])
        at += n + 2


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The record's payload: the body of an HTTP message, else the block."""
    if headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def make_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_uri(page_id)), ("WARC-Date", NO_DATE)]
    headers += [("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)), ("Content-Type", "text/html; charset=utf-8"), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_uri(refers_to))]
    body = b"" if revisit else payload
    headers.append(("Content-Length", str(len(body))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; a ValueError tells what is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"broken header {line!r}")
        name = name.lower()
        if name in headers and name in SINGLE:
            raise ValueError(f"header {name} is repeated")
        headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"header {name} is missing")
    if not re.fullmatch("[0-9]{1,18}", headers["content-length"]):
        raise ValueError("content-length is not a number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("content-length differs from the block")
    block = rest[:n]
    if not digest_matches(headers.get("warc-block-digest", ""), block):
        raise ValueError("block digest differs")
    digest = headers.get("warc-payload-digest")
    if headers["warc-type"] != "revisit" and digest:  # that of a revisit is of another record's payload
        payload = payload_of(headers, block)
        if not digest_matches(digest, payload):
            whole = _unchunked(payload) if payload is not block else None
            if whole is None or not digest_matches(digest, whole):
                raise ValueError("payload digest differs")
    return headers, block


def frame_size(data: memoryview, at: int) -> int:
    """Bytes of the frame at ``at``, from its header and block headers."""
    if int.from_bytes(data[at : at + 4], "little") != ZSTD_MAGIC or at + 5 > len(data):
        raise ValueError(f"no frame at {at}")
    try:
        size = zstd.frame_header_size(bytes(data[at : at + 18]))
    except zstd.ZstdError as e:
        raise ValueError(f"broken frame header at {at}: {e}") from None
    checksum = bool(data[at + 4] & 4)
    while True:
        if at + size + 3 > len(data):
            raise ValueError("truncated frame")
        head = int.from_bytes(data[at + size : at + size + 3], "little")
        size += 3 + (1 if (head >> 1) & 3 == 1 else head >> 3)
        if head & 1:
            break
    size += 4 * checksum
    if at + size > len(data):
        raise ValueError("truncated frame")
    return size


class ArchiveWriter:
    def __init__(self, dictionary: bytes, level: int = 3):
        self.dictionary = dictionary
        kind = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT) if dictionary else None
        self.compressor = zstd.ZstdCompressor(level=level, dict_data=kind, write_checksum=True, write_content_size=True)
        self.start()

    def start(self) -> None:
        self.parts = [struct.pack("<II", DICTIONARY_MAGIC, len(self.dictionary)) + self.dictionary]
        self.size, self.records = len(self.parts[0]), 0

    def add(self, record: bytes) -> None:
        self.parts.append(self.compressor.compress(record))
        self.size += len(self.parts[-1])
        self.records += 1

    def finish(self) -> bytes:
        out = b"".join(self.parts)
        self.start()
        return out


def read_records(archive: bytes):
    """(headers, block) of each record of an archive."""
    view = memoryview(archive)

    def skippable(at):
        """Bytes of the skippable frame at ``at``; 0 if none is there."""
        if at + 8 > len(view) or struct.unpack_from("<I", view, at)[0] & 0xFFFFFFF0 != 0x184D2A50:
            return 0
        size = 8 + struct.unpack_from("<I", view, at + 4)[0]
        if at + size > len(view):
            raise ValueError("truncated skippable frame")
        return size

    def opened(frame, decompressor):
        try:
            stream = decompressor.decompressobj()
            out = stream.decompress(frame)
        except zstd.ZstdError as e:
            raise ValueError(f"broken frame: {e}") from None
        if not stream.eof:
            raise ValueError("truncated frame")
        return out

    first = skippable(0) if len(view) >= 4 and struct.unpack_from("<I", view, 0)[0] == DICTIONARY_MAGIC else 0
    dictionary = bytes(view[8:first])
    if dictionary[:4] == struct.pack("<I", ZSTD_MAGIC):  # the dictionary itself may be compressed
        dictionary = opened(dictionary, zstd.ZstdDecompressor())
    kind = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_AUTO if dictionary[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT) if dictionary else None
    decompressor, at = zstd.ZstdDecompressor(dict_data=kind), first
    while at < len(view):
        if n := skippable(at):
            at += n
            continue
        n = frame_size(view, at)
        yield parse_record(opened(bytes(view[at : at + n]), decompressor))
        at += n


def _row(h: dict[str, str], block: bytes) -> tuple:
    """record_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    if h["warc-type"] == "revisit":
        n = h.get("x-payload-length", "")
        digest = h.get("warc-payload-digest", "").partition(":")[2] or None
        return h["warc-record-id"], page_of(h["warc-record-id"]), h.get("warc-target-uri", ""), int(n) if n.isdigit() else None, digest, "revisit", page_of(h.get("warc-refers-to", "")), None
    payload = payload_of(h, block)
    return h["warc-record-id"], page_of(h["warc-record-id"]), h.get("warc-target-uri", ""), len(payload), payload_digest(payload), h["warc-type"], None, payload


def sample_dictionary(pages: DataFrame, rows: int = 32) -> bytes:
    """Raw-content dictionary from the beginnings of a bounded sample of pages (those of the smallest hashes)."""
    got = pages.select(F.substring(F.col("html").cast("string"), 1, 8192).alias("t"), F.xxhash64("page_id", "url").alias("k")).orderBy("k", "t").limit(rows).collect()
    return b"".join((r["t"] or "").encode("utf-8", "surrogatepass")[: DICTIONARY_BYTES // rows] for r in got)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to of the rows that repeat a payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = shared.keep(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")), "warc-digests")
    groups = keyed.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c"))
    groups = groups.where("c > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")
    found = keyed.where(F.col("n") >= min_bytes).join(groups, "digest").where("page_id IS NULL OR page_id <> refers_to")
    return found.select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """archive, records, content: archives of about ``ARCHIVE_BYTES`` bytes, written to the shared folder."""
    spark = pages.sparkSession
    shared.bound_batches(spark)
    dictionary = sample_dictionary(pages)
    repeats = shared.keep(revisits(pages, min_bytes), "warc-revisits")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    side = repeats.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    side = F.broadcast(side) if repeats.count() <= shared.BROADCAST_IDS // 8 else side  # about 64 bytes each
    rows = rows.join(side, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", "html", "refers_to")

    def run(it):
        writer, first = ArchiveWriter(dictionary), None

        def row():
            n = writer.records
            return pd.DataFrame({"archive": [f"page-{first}"], "records": [n], "content": [writer.finish()]})

        for pdf in it:
            for page, url, html, refers in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                page = None if pd.isna(page) else int(page)
                first = page if not writer.records else first
                writer.add(make_record(page, url, html.encode("utf-8", "surrogatepass"), None if pd.isna(refers) else int(refers)))
                if writer.size >= ARCHIVE_BYTES:
                    yield row()
        if writer.records:
            yield row()

    return shared.keep(rows.mapInPandas(run, "archive string, records long, content binary"), "warc-archives")


def _rows_of(archives: DataFrame, wanted: list[str]) -> DataFrame:
    """Columns of ``_row`` of each record, a few hundred at a time."""
    shared.bound_batches(archives.sparkSession)
    names = ["record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = dict(zip(names, ("string", "long", "string", "long", "string", "string", "long", "binary"), strict=True))

    def frame(out):
        return pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})[wanted]

    def run(it):
        for pdf in it:
            for content in pdf["content"]:
                out, size = [], 0
                for h, block in read_records(content):
                    out.append(_row(h, block))
                    size += len(block)
                    if len(out) >= 500 or size >= ARCHIVE_BYTES:
                        yield frame(out)
                        out, size = [], 0
                yield frame(out)

    return archives.select("content").mapInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in wanted))


def read_archives(archives: DataFrame) -> DataFrame:
    """record_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of each record."""
    return _rows_of(archives, ["record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def archive_index(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: what the archives hold, without the payloads."""
    return _rows_of(archives, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
