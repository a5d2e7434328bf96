"""WARC archives in Zstandard frames with a shared dictionary.

An archive is a skippable frame that holds the dictionary, then one Zstandard
frame per WARC record.  A record whose payload equals that of another record
with a smaller id is written as a ``revisit`` and carries no payload.

Defined results: a null html is an empty payload; a null or blank url leaves
out ``WARC-Target-URI``; a null id never counts as the smallest while another
row has the same payload; rows that repeat the smallest id are all responses;
an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.files import put

#: Fixed values of the formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = (
    "archive string, record_offset long, record_id string, record_type string, target_uri string, "
    "record_date string, payload_digest string, payload_bytes long, refers_to_id string, payload binary"
)


class ArchiveError(ValueError):
    """An archive or record that breaks the format."""


# ---------------------------------------------------------------- one record


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        + f"Content-Length: {len(payload)}".encode()
        + CRLF * 2
    )
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if uri:
        head.append(("WARC-Target-URI", quote(uri, safe="%/:=&?~#+!$,;'@()*[]")))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    lines = CRLF.join(f"{k}: {v}".encode() for k, v in head)
    return VERSION + CRLF + lines + CRLF * 2 + block + CRLF * 2


def _fields(raw: bytes, what: str) -> dict[str, str]:
    out = {}
    for line in raw.split(CRLF):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError(f"{what}: bad header line {line[:60]!r}")
        out[name.strip().decode().lower()] = value.strip().decode()
    return out


def parse_record(raw: bytes) -> dict:
    """Check a record's version, required headers, lengths and digests."""
    head, gap, rest = raw.partition(CRLF * 2)
    version, _, lines = head.partition(CRLF)
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError(f"not a WARC record: {raw[:20]!r}")
    f = _fields(lines, "WARC header")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in f:
            raise ArchiveError(f"header {name} is missing")
    if not re.fullmatch(r"\d+", f["content-length"]):
        raise ArchiveError(f"bad Content-Length {f['content-length']!r}")
    n = int(f["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != CRLF * 2:
        raise ArchiveError(f"the block has {max(0, len(rest) - 4)} bytes, Content-Length says {n}")
    digest = f"sha1:{payload_digest(block)}"
    if f.get("warc-block-digest", digest) != digest:
        raise ArchiveError("the block does not match its digest")
    out = {
        "record_id": f["warc-record-id"].strip("<>"),
        "record_type": f["warc-type"],
        "target_uri": f.get("warc-target-uri"),
        "record_date": f["warc-date"],
        "payload_digest": f.get("warc-payload-digest", "").rpartition(":")[2] or None,
        "refers_to_id": f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None,
        "payload_bytes": n,
        "payload": block,
    }
    if f.get("content-type", "").startswith("application/http"):
        http, gap, body = block.partition(CRLF * 2)
        if not gap:
            raise ArchiveError("the HTTP header does not end")
        h = _fields(http.partition(CRLF)[2], "HTTP header")
        out["payload_bytes"] = int(h.get("content-length", len(body)))
        out["payload"] = body if out["record_type"] != "revisit" else None
    if out["record_type"] == "revisit":
        if out["refers_to_id"] is None or out["payload_digest"] is None:
            raise ArchiveError("a revisit without WARC-Refers-To or WARC-Payload-Digest")
    else:
        if out["payload_bytes"] != len(out["payload"]):
            raise ArchiveError(f"the payload has {len(out['payload'])} bytes, HTTP says {out['payload_bytes']}")
        digest = payload_digest(out["payload"])
        if out["payload_digest"] not in (None, digest):
            raise ArchiveError("the payload does not match its digest")
        out["payload_digest"] = digest
    return out


# --------------------------------------------------------------- one archive


def _dictionary(records: list[bytes], size: int) -> bytes:
    """Train on the archive's own records; too few of them serve as raw content."""
    sample = records[:: max(1, len(records) // 256)]
    try:
        return zstandard.train_dictionary(size, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:size] or b"\0" * 8


def build_archive(records: list[bytes], level: int = 3, dictionary_bytes: int = 16384) -> bytes:
    raw = _dictionary(records, dictionary_bytes)
    packed = zstandard.ZstdCompressor(level=level).compress(raw)
    made = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    frames = [struct.pack("<II", SKIPPABLE_DICTIONARY, len(packed)), packed]
    return b"".join(frames + [made.compress(r) for r in records])


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, found by walking its block headers."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != ZSTD_MAGIC:
        raise ArchiveError(f"no Zstandard frame at byte {at}")
    checksum = data[at + 4] & 4
    p = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        if p + 3 > len(data):
            raise ArchiveError(f"the frame at byte {at} is cut off")
        head = data[p] | data[p + 1] << 8 | data[p + 2] << 16
        p += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            end = p + (4 if checksum else 0)
            if end > len(data):
                raise ArchiveError(f"the frame at byte {at} is cut off")
            return end


def iter_archive(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Yield ``(offset, record bytes)`` of an archive, one frame at a time."""
    data, at, dictionary = memoryview(content), 0, None
    if len(data) >= 8:
        magic, n = struct.unpack_from("<II", data, 0)
        if magic == SKIPPABLE_DICTIONARY:
            if 8 + n > len(data):
                raise ArchiveError("the dictionary is cut off")
            raw, at = bytes(data[8 : 8 + n]), 8 + n
            if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            dictionary = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        end = _frame_end(data, at)
        try:
            yield at, reader.decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise ArchiveError(f"the frame at byte {at} does not decode: {e}") from e
        at = end


# ---------------------------------------------------------------------- Spark


def write_archives(
    pages: DataFrame,
    out_dir: str,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = 8 << 20,
    level: int = 3,
) -> DataFrame:
    """Write every row as a record of ``out_dir/*.warc.zst``; return the manifest.

    Equal payloads are found by their digest and length: a grouped minimum
    with partial aggregation, of which only digests that repeat are joined
    back, so a payload shared by a third of the rows is an ordinary skewed
    join.  Within a task, records go in id order under a name made of the
    partition and a running number, so that a repeated attempt writes the same
    bytes to the same places.  ``archive_bytes`` bounds what is held of an
    archive, uncompressed, beyond its last record.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8").alias("body"),
    ).withColumn("sha", F.sha1("body"))
    repeated = cut(
        rows.groupBy("sha").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "repeated",
    )
    rows = (
        rows.join(repeated, "sha", "left")
        .withColumn("refers_to", F.expr("if(first_id is not null and (id is null or id > first_id), first_id, null)"))
        .select("id", "url", "body", "refers_to")
        .sortWithinPartitions("id", "url", "body")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pd.DataFrame:
            nonlocal made, held, size
            name = f"part-{part:06d}-{made:06d}.warc.zst"
            data = build_archive(held, level)
            put(f"{out_dir}/{name}", data)
            out = pd.DataFrame({"archive": [name], "records": [len(held)], "bytes": [len(data)]})
            made, held, size = made + 1, [], 0
            return out

        for b in batches:
            for i, url, body, ref in zip(b["id"], b["url"], b["body"], b["refers_to"], strict=True):
                name = "urn:x-page:" + ("null" if pd.isna(i) else str(int(i)))
                refers = None if pd.isna(ref) else f"urn:x-page:{int(ref)}"
                record = build_record(name, url if isinstance(url, str) else None, bytes(body), refers, date)
                held.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    # ids travel as strings of digits: pandas would turn a nullable long into a double
    text = rows.select(F.col("id").cast("string").alias("id"), "url", "body", F.col("refers_to").cast("string").alias("refers_to"))
    return cut(text.mapInPandas(write, "archive string, records long, bytes long"), "manifest")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Read every record of the archives under ``path``; any breach of the format raises."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                held, size = [], 0
                for at, raw in iter_archive(content):
                    r = parse_record(raw) | {"archive": name, "record_offset": at}
                    if not with_payload:
                        r["payload"] = None
                    held.append(r)
                    size += len(raw)
                    if size >= 4 << 20:
                        yield pd.DataFrame(held)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held)

    return files.mapInPandas(read, RECORD_SCHEMA)


def page_id_of(record_id: str):
    """The id that ``write_archives`` put into a record id, as a column."""
    return F.regexp_extract(F.col(record_id), r"^urn:x-page:(-?\d+)$", 1).try_cast("long")
