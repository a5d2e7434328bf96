import random
import struct

import pytest

from tessera.llm import warc
from tessera.llm.common import scratch_dir

PAYLOADS = [b"", b"<html>one</html>", "é🙂\r\n\r\nWARC/1.1".encode(), b"x" * 300_000]


@pytest.fixture
def archive():
    return warc.build_archive([warc.build_record(f"urn:x-page:{i}", f"http://h/{i}?a=b c", p, None, "2024-01-01T00:00:00Z") for i, p in enumerate(PAYLOADS * 20)])


def test_archive_round_trip(archive):
    assert struct.unpack_from("<I", archive)[0] == warc.SKIPPABLE_DICTIONARY
    got = [warc.parse_record(r) for _, r in warc.iter_archive(archive)]
    assert [g["payload"] for g in got] == PAYLOADS * 20
    assert got[1]["target_uri"] == "http://h/1?a=b%20c"


def test_every_frame_decodes_alone(archive):
    offsets = [at for at, _ in warc.iter_archive(archive)]
    n = struct.unpack_from("<I", archive, 4)[0]
    alone = archive[: 8 + n] + archive[offsets[5] : offsets[6]]
    assert warc.parse_record(next(warc.iter_archive(alone))[1])["record_id"] == "urn:x-page:5"


def test_plain_dictionary_and_none():
    import zstandard

    records = [warc.build_record("urn:x-page:1", None, b"abc" * 50, None, "2024-01-01T00:00:00Z")]
    raw = b"abcabcabc HTTP/1.1 200 OK"
    made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    data = struct.pack("<II", warc.SKIPPABLE_DICTIONARY, len(raw)) + raw + made.compress(records[0])
    assert [r for _, r in warc.iter_archive(data)] == records
    assert [r for _, r in warc.iter_archive(zstandard.ZstdCompressor().compress(records[0]))] == records
    assert list(warc.iter_archive(b"")) == []


def test_damage_is_found(archive):
    rng = random.Random(1)
    for cut in (3, 10, len(archive) // 2, len(archive) - 1):
        with pytest.raises(warc.ArchiveError):
            for _, r in warc.iter_archive(archive[:cut]):
                warc.parse_record(r)
    start = next(warc.iter_archive(archive))[0]
    for _ in range(20):
        bad = bytearray(archive)
        bad[rng.randrange(start, len(bad))] ^= 1 << rng.randrange(8)
        try:
            good = [warc.parse_record(r)["payload"] for _, r in warc.iter_archive(bytes(bad))] == PAYLOADS * 20
        except warc.ArchiveError:
            good = True
        assert good  # found, or in a bit that changes nothing


@pytest.mark.parametrize(
    "change",
    [(b"WARC/1.1", b"WARC/9.9"), (b"WARC-Type: response\r\n", b""), (b"Content-Length: 107", b"Content-Length: 106"), (b"Content-Length: 107", b"Content-Length: x"),
     (b"Content-Length: 16", b"Content-Length: 15"), (b"one", b"two"), (b"WARC-Date: ", b"WARC-Date ")],
)
def test_bad_records(change):
    record = warc.build_record("urn:x-page:1", "http://h/", PAYLOADS[1], None, "2024-01-01T00:00:00Z")
    bad = record.replace(*change, 1) if change[0] in record else record[:-1]
    with pytest.raises(warc.ArchiveError):
        warc.parse_record(bad)


def test_write_and_read(spark):
    rows = [(5, "u5", "same"), (2, "u2", "same"), (9, None, "same"), (7, "http://x/\n y", None), (8, "", ""), (None, "n", "same"), (1, "one", "é🙂"), (2, "u2", "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload_digest string")
    out = scratch_dir(spark, "w")
    assert sum(r["records"] for r in warc.write_archives(df, out, archive_bytes=600).collect()) == len(rows)
    got = warc.read_archives(spark, out).withColumn("id", warc.page_id_of("record_id")).withColumn("ref", warc.page_id_of("refers_to_id"))
    seen = sorted((str(r["id"]), r["record_type"], str(r["ref"]), r["payload_bytes"], r["payload_digest"]) for r in got.collect())
    d = warc.payload_digest
    want = [(5, "revisit", 2, "same"), (2, "response", None, "same"), (2, "response", None, "same"), (9, "revisit", 2, "same"), (7, "response", None, ""),
            (8, "revisit", 7, ""), (None, "revisit", 2, "same"), (1, "response", None, "é🙂")]
    assert seen == sorted((str(i), t, str(r), len(p.encode()), d(p.encode())) for i, t, r, p in want)


def test_write_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(df, scratch_dir(spark, "w")).collect() == []
