"""WARC archives written and read by tasks.

Writing: each task appends its rows' records to archives in the shared folder. Payloads do
not move between tasks; only their digests do, to find for each payload that occurs again
the record that holds it, and the others become revisits of that one.

Reading: an archive is cut in byte ranges. A task lists each offset in its range where a
record could begin, with the offset at which the next would have to, taken from the
header's Content-Length. A payload may hold such beginnings too, whole records even.
Pointer jumping from offset 0 of each archive, by joins that double the reach every round,
keeps the offsets on the chain of records and no others; then the records are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordspace.llm.removal import bounded
from wordspace.llm.shared import open_file, open_output
from wordspace.sources.scratch import materialize, scratch_path

#: Shortest payload that is not written again, in bytes.
REVISITED = 1000
#: Bytes after which a task begins another archive, and of the ranges in which archives are read.
ARCHIVE_BYTES, RANGE_BYTES = 64 << 20, 8 << 20
#: Bytes read at once.
READ_BYTES = 1 << 20

# Fixed values of the format.
MAGIC, LINE, AFTER = b"WARC/1.1\r\n", b"\r\n", b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
NAME = "urn:page:"


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub("[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> list[bytes]:
    """One record: the response with its payload, or a revisit with the response's header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = [http] if revisit else [http, payload]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Record-ID: <{NAME}{_clean(key) if key is not None else uuid.uuid4().hex + ':'}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{NAME}{_clean(refers_to)}>")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    head.append(f"Content-Length: {sum(map(len, body))}")
    return ["\r\n".join(head).encode() + AFTER, *body, AFTER]


def _write(folder: str, archive_bytes: int):
    schema = pa.schema([("archive", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("header", pa.int64())])

    def task(batches):
        out, name, size, count, longest, done = None, "", 0, 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
                key, url, html, digest, refers_to, revisit = (v.as_py() for v in row)
                if out is None:
                    name, size, count, longest = f"{folder}/{uuid.uuid4().hex}.warc", 0, 0, 0
                    out = open_output(name)
                parts = record(key, url, html, digest, refers_to, revisit)
                longest = max(longest, len(parts[0]))
                for part in parts:
                    out.write(part)
                    size += len(part)
                count += 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    done.append((name, size, count, longest))
        if out is not None:
            out.close()
            done.append((name, size, count, longest))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else ([],) * 4, schema)], schema=schema)

    return task


def write(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Archives of all pages under ``folder``; ``(archive, bytes, records, header)`` of those written.

    Of equal payloads of at least 1,000 bytes the row with the largest id is a response and
    the others revisit it; rows that share that id are all responses, and so are rows
    with equal payloads none of which has an id. Null html is empty. Archives that a task
    wrote before it was lost are not listed. ``header`` are the bytes of the longest header.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    digests = materialize(
        pages.select(F.col(key).alias("key"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
        .filter(F.col("size") >= REVISITED)
    )
    again = digests.groupBy("digest").agg(F.max("key").alias("held"), F.count("*").alias("rows")).filter("rows > 1 AND held IS NOT NULL")
    again = materialize(again.select(F.col("digest").alias("again"), "held"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("html"), F.sha1(payload).alias("digest"))
    rows = rows.join(bounded(again), F.col("digest") == F.col("again"), "left")
    revisit = F.col("held").isNotNull() & ~F.col("key").eqNullSafe(F.col("held"))
    rows = rows.select(
        F.col("key").cast("string"), F.col("url").cast("string"), "html", "digest",
        F.when(revisit, F.col("held").cast("string")).alias("held"), revisit.alias("revisit"),
    )
    return materialize(rows.mapInArrow(_write(folder, archive_bytes), "archive string, bytes bigint, records bigint, header bigint"))


def header(data: bytes) -> dict[str, str] | None:
    """The fields of a record header without its first line and end; None if it is not one."""
    fields: dict[str, str] = {}
    for line in data.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            return None
        fields.setdefault(name.strip().lower(), value.strip())
    return fields if fields.get("content-length", "").isascii() and fields.get("content-length", "").isdigit() else None


def _header_at(source, size: int, offset: int, longest: int) -> tuple[dict[str, str], int] | None:
    """The fields of a record at an offset and where its block begins."""
    source.seek(offset)
    most = min(longest, size - offset)
    data = bytearray(source.read(min(8192, most)))
    if not data.startswith(MAGIC):
        return None
    end = data.find(AFTER)
    while end < 0 and len(data) < most:
        # The mark may lie across what is read at once.
        known = max(0, len(data) - len(AFTER) + 1)
        more = source.read(min(max(len(data), 8192), most - len(data)))
        if not more:
            break
        data += more
        end = data.find(AFTER, known)
    if end < 0:
        return None
    fields = header(bytes(data[len(MAGIC) : end]))
    return None if fields is None else (fields, offset + end + len(AFTER))


def _candidates(batches):
    schema = pa.schema([("archive", pa.int64()), ("at", pa.int64()), ("next", pa.int64())])
    for batch in batches:
        out = []
        for archive, number, size, longest, begin, end in zip(*(batch.column(c).to_pylist() for c in ("archive", "number", "bytes", "header", "begin", "end"))):
            with open_file(archive) as source:
                place, kept = begin, b""
                while place < end:
                    source.seek(place)
                    data = source.read(min(READ_BYTES, end - place) + len(MAGIC) - 1)
                    limit = min(READ_BYTES, end - place)
                    found = data.find(MAGIC)
                    while 0 <= found < limit:
                        if (known := _header_at(source, size, place + found, longest)) is not None:
                            fields, block = known
                            after = block + int(fields["content-length"]) + len(AFTER)
                            if after <= size:
                                out.append((number, place + found, after))
                        found = data.find(MAGIC, found + 1)
                    place += limit
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ([],) * 3, schema)], schema=schema)


def chained(candidates: DataFrame) -> DataFrame:
    """The ``(archive, at)`` that the chain from offset 0 of each archive reaches.

    ``candidates`` has ``(archive, at, next)``. Each round joins the reached offsets with
    pointers twice as long as in the round before, so the number of rounds is that of the
    binary digits of the longest chain.
    """
    ends = candidates.select(F.col("archive").alias("a"), F.col("at").alias("b"))
    jumps = materialize(candidates.join(ends, (F.col("archive") == F.col("a")) & (F.col("next") == F.col("b"))).select("archive", "at", "next"))
    reached = candidates.filter("at = 0").select("archive", "at")
    while not jumps.isEmpty():
        further = reached.join(jumps, ["archive", "at"]).select("archive", F.col("next").alias("at"))
        reached = materialize(reached.unionByName(further))
        then = jumps.select("archive", F.col("at").alias("next"), F.col("next").alias("beyond"))
        jumps = materialize(jumps.join(then, ["archive", "next"]).select("archive", "at", F.col("beyond").alias("next")))
    return reached


RECORDS = pa.schema(
    [("archive", pa.string()), ("at", pa.int64()), ("key", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())]
)


def _id(value: str | None) -> str | None:
    value = (value or "").strip("<>").removeprefix(NAME)
    return None if not value or value.endswith(":") else value


def _records(sizes: bool):
    def task(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                out = []
                for archive, size, at in zip(*(batch.column(c).slice(begin, 64).to_pylist() for c in ("archive", "bytes", "at"))):
                    with open_file(archive) as source:
                        out.append((archive, at, *_read(source, size, at, sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RECORDS)], schema=RECORDS)

    return task


def _read(source, size: int, at: int, digests_only: bool):
    fields, block = _header_at(source, size, at, size)
    kind = fields.get("warc-type")
    source.seek(block)
    left = int(fields["content-length"])
    head = source.read(min(left, 8192))
    while (end := head.find(AFTER)) < 0 and len(head) < left:
        head += source.read(min(left - len(head), 8192))
    end = end + len(AFTER) if end >= 0 else 0
    length, digest, parts = left - end, hashlib.sha1(head[end:]), [head[end:]]
    left -= len(head)
    while left > 0 and (data := source.read(min(left, READ_BYTES))):
        digest.update(data)
        left -= len(data)
        if not digests_only:
            parts.append(data)
    found = digest.hexdigest()
    if kind == "revisit":
        said = re.search(rb"(?im)^content-length:\s*(\d+)", head[:end])
        length, found = int(said[1]) if said else None, fields.get("warc-payload-digest", "").removeprefix("sha1:")
    payload = None if digests_only or kind == "revisit" else b"".join(parts)
    return _id(fields.get("warc-record-id")), fields.get("warc-target-uri"), length, found, kind, _id(fields.get("warc-refers-to")), payload


def read(archives: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of archives ``(archive, bytes)``, with their payloads unless told otherwise.

    Length and digest are those of the payload as read; a revisit has those of the payload
    it stands for, from its headers. What follows a break in the chain of an archive is not
    read; where ``archives`` has the ``records`` written, fewer or more found are an error.
    A header ends within the ``header`` bytes given, or else anywhere in its archive.
    """
    spark = archives.sparkSession
    # As many tasks as asked for: rows are few bytes, what is read for them is not.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    longest = F.col("header") if "header" in archives.columns else F.col("bytes")
    records = F.col("records") if "records" in archives.columns else F.lit(None).cast("bigint")
    archives = materialize(
        archives.select("archive", "bytes", longest.alias("header"), records.alias("records"), F.monotonically_increasing_id().alias("number"))
    )
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint")))
    ranges = archives.select("archive", "bytes", "header", "number", starts.alias("begin"))
    ranges = ranges.withColumn("end", F.least(F.col("begin") + range_bytes, F.col("bytes")))
    found = ranges.repartition(tasks, "number", "begin").mapInArrow(_candidates, "archive bigint, at bigint, next bigint")
    kept = chained(materialize(found))
    counts = kept.groupBy(F.col("archive").alias("number")).agg(F.count("*").alias("found"))
    wrong = archives.join(counts, "number", "left").filter("records <> coalesce(found, 0)").select("archive", "records", "found").first()
    if wrong is not None:
        raise ValueError(f"{wrong.archive}: {wrong.records} records written, {wrong.found or 0} found")
    place = kept.withColumnRenamed("archive", "number").withColumn("begin", F.expr(f"at div {range_bytes}"))
    place = place.repartition(tasks, "number", "begin").join(bounded(archives.select("number", "archive", "bytes")), "number")
    place = place.sortWithinPartitions("number", "at").select("archive", "bytes", "at")
    ddl = "archive string, at bigint, key string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"
    return place.mapInArrow(_records(not payloads), ddl)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, payload_bytes, payload_digest, record_type, refers_to)`` per page, as read back from its archives."""
    archives = write(pages, scratch_path(pages.sparkSession), key, url, html)
    kind = pages.schema[key].dataType
    found = read(archives, payloads=False)
    return found.select(
        F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
