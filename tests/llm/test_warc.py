"""Archives read back against a sequential reader."""

import hashlib

import pytest
from pyspark.sql import functions as F

from wordspace.llm import warc
from wordspace.llm.shared import local_path
from wordspace.sources.scratch import scratch_path

SCHEMA = "page_id bigint, url string, html string, key string, digest string, payload binary"


def fake(text):
    body = text.encode()
    return b"".join(warc.record("99999", "http://fake", body, hashlib.sha1(body).hexdigest(), None, False)).decode()


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "d", None) for r in rows], SCHEMA)


def sequential(path):
    data, at, out = open(path, "rb").read(), 0, []
    while at < len(data):
        out.append(at)
        end = data.index(b"\r\n\r\n", at)
        length = int(data[at:end].lower().split(b"content-length:")[1].split(b"\r\n")[0])
        at = end + 4 + length + 4
    return out


def want(rows):
    out = []
    for page, _, text in rows:
        body = (text or "").encode()
        equal = [p for p, _, t in rows if (t or "") == (text or "") and p is not None]
        revisit = len(body) >= 1000 and bool(equal) and page != max(equal)
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", max(equal) if revisit else None))
    return sorted(out, key=repr)


def check(spark, rows):
    assert sorted(map(tuple, warc.round_trip(pages(spark, rows)).collect()), key=repr) == want(rows)


MAGIC_ROWS = [
    (1, "http://a", fake("inner") * 30), (2, "http://b\r\nWARC-Type: x", "WARC/1.1\r\n" * 200), (3, None, "\r\n\r\n" + fake("x" * 3000) + "tail"),
    (4, "u", "WARC/1.1\r\nContent-Length: 99999999999\r\n\r\n"), (5, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
    (6, "u", fake(fake(fake("deep") + "\r\n\r\n"))), (7, "é", "é" * 700), (8, "", "WARC/1.1\r\nno colon\r\n\r\n"),
]


def test_payloads_that_hold_records(spark):
    check(spark, MAGIC_ROWS)


def test_copies_nulls_and_repeats(spark):
    long = "same " * 300
    rows = [(i, "u", long) for i in (3, 9, 4)] + [(9, "u", long), (None, "u", long), (10, "u", "short"), (11, "u", "short"), (12, None, None), (13, "u", "")]
    rows += [(None, None, "other " * 300)] * 2 + [(20, "u", "é" * 499), (21, "u", "é" * 499), (22, "u", "é" * 500), (23, "u", "é" * 500)]
    check(spark, rows)


def test_hot_payload_and_empty_table(spark):
    check(spark, [(i, "u", "hot " * 400 if i % 3 else f"page {i} " * 200) for i in range(900)])
    check(spark, [])


def test_small_ranges_and_archives(spark):
    rows = MAGIC_ROWS + [(100 + i, f"http://{i}", f"<p>{i}" * (i * 7 % 400)) for i in range(150)] + [(500, "u", "long " * 500_000)]
    folder = scratch_path(spark)
    archives = warc.write(pages(spark, rows), folder, archive_bytes=20_000)
    found = warc.read(archives, range_bytes=500).select("archive", "at", "key", "payload", "url").collect()
    starts = {r.archive: sorted(x.at for x in found if x.archive == r.archive) for r in archives.collect()}
    for archive, at in starts.items():
        assert at == sequential(local_path(archive))
    assert {int(r.key): r.payload.decode() for r in found} == {p: t for p, _, t in rows}
    assert next(r.url for r in found if r.key == "2") == "http://b%0D%0AWARC-Type: x"
    assert archives.agg(F.sum("records")).first()[0] == len(rows)


def test_broken_archive_is_read_up_to_the_break(spark):
    folder = scratch_path(spark)
    (row,) = warc.write(pages(spark, [(i, "u", f"page {i}") for i in range(20)]).coalesce(1), folder).collect()
    path = local_path(row.archive)
    data = open(path, "rb").read()
    offsets = sequential(path)
    with open(path, "wb") as out:
        out.write(data[: offsets[12]] + b"XXXX" + data[offsets[12] + 4 :])
    archives = spark.createDataFrame([(row.archive, row.bytes)], "archive string, bytes bigint")
    assert sorted(r.at for r in warc.read(archives).collect()) == offsets[:12]


def test_headers_of_any_length(spark):
    rows = [(i, f"http://{i}" + "/x" * ((3 << 19) + i if i in (4, 9) else i), f"page {i}") for i in range(15)]
    archives = warc.write(pages(spark, rows).coalesce(1), scratch_path(spark))
    assert archives.count() == 1
    want = {str(i): u for i, u, _ in rows}
    assert {r.key: r.url for r in warc.read(archives).collect()} == want
    assert {r.key: r.url for r in warc.read(archives.select("archive", "bytes")).collect()} == want


def test_missing_records_are_an_error(spark):
    archives = warc.write(pages(spark, [(i, "u", f"page {i}") for i in range(20)]).coalesce(1), scratch_path(spark))
    path = local_path(archives.first().archive)
    data, at = open(path, "rb").read(), sequential(path)[12]
    with open(path, "wb") as out:
        out.write(data[:at] + b"XXXX" + data[at + 4 :])
    with pytest.raises(ValueError, match="20 records written, 12 found"):
        warc.read(archives)
