"""WARC writing, reading, and transaction assembly.

`write` makes a request, a response or revisit, and a metadata record of every page. Each record is a gzip member of its own, and archives
are cut by bytes. They go out through Spark's writer, so wherever Spark can write. Of equal payloads the row with the largest
page id is the response, the others revisit it. `read` parses archives member by member by Content-Length. `assemble` joins the records of a
capture through WARC-Concurrent-To, in whichever direction and over however many records it leads, and emits one nested row for each response or revisit.

Cases: a null payload is empty; a null url is written as an empty URI, line ends in it are percent-encoded; a null page id is
written as `null`; repeated rows are captures each, and one of them is the response; payloads of any length are whole; a
capture without request or metadata gets null or none; of several requests of a capture the one of least record id is taken; a record that names
two captures' records joins them into one capture for each of their responses; an empty table gives empty archives; extra columns are not read.
In archives from elsewhere a record without Content-Length ends at the next record's first line or at the archive's end, and a response
whose block is no HTTP has no status and its whole block as payload. An archive is one value of Spark's binary source, 2 GB at most.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, by_batches, keyed, materialize
from .components import connected_components

#: Compressed bytes from which an archive is closed, and bytes of blocks that a reader holds as one batch.
ARCHIVE_BYTES, READ_BYTES = 32 << 20, 4 << 20
#: Compressed bytes that a reader unzips at first, and the level of compression.
STEP_BYTES, LEVEL = 4096, 1
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_NEXT = re.compile(rb"\r\n\r\n(?=WARC/\d)")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, eight letters for every five bytes."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: Column | str, record_id: Column, headers: list[Column], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    size = F.octet_length(block).cast("string")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <"), record_id, F.lit(f">\r\nWARC-Date: {DATE}\r\n"), *headers, F.lit("Content-Length: "), size, F.lit(_END))
    return F.concat(head, block)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Archives of pages at path; payloads of under least_bytes bytes are responses all."""
    pages, row, _ = keyed(pages, key)
    html = F.coalesce(pages[payload], F.lit(""))
    rows = pages.select(pages[row].alias("seq"), pages[key].cast("long").alias("page_id"), F.coalesce(pages[url], F.lit("")).alias("url"), html.alias("html")).withColumn("digest", base32_sha1(F.col("html")))
    # (page id, row) of the response of every payload that occurs more than once
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "seq")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(groups.select("digest", "first"), "payloads")
    rows = rows.join(bounded_broadcast(shared, shared.count()), "digest", "left")
    revisit = F.coalesce((F.col("first.seq") != F.col("seq")) & (F.octet_length("html") >= least_bytes), F.lit(False))

    def name(page: Column, row: Column, kind: str) -> Column:
        return F.concat(F.lit("urn:capture:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"), F.lit(f":{kind}"))

    own, request, about = (name(F.col("page_id"), F.col("seq"), x) for x in ("response", "request", "metadata"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    target = _header("WARC-Target-URI", uri)
    refers = F.when(revisit, _header("WARC-Refers-To", F.concat(F.lit("<"), name(F.col("first.page_id"), F.col("first.seq"), "response"), F.lit(">")))).otherwise(F.lit(""))
    profile = F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit(""))
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: "), size, F.lit(_END))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    concurrent = F.lit("Content-Type: application/http;msgtype=")
    response = _record(kind, own, [target, refers, profile, _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), concurrent, F.lit("response\r\n")], F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html"))))
    asked = _record("request", request, [target, _header("WARC-Concurrent-To", F.concat(F.lit("<"), own, F.lit(">"))), concurrent, F.lit("request\r\n")], F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\nAccept: text/html" + _END)))
    noted = _record("metadata", about, [target, _header("WARC-Concurrent-To", F.concat(F.lit("<"), own, F.lit(">"))), F.lit("Content-Type: application/warc-fields\r\n")], F.concat(F.lit("payload-bytes: "), size, F.lit("\r\n")))
    _write_members(rows.select(asked.alias("a"), response.alias("b"), noted.alias("c")), path)


def _write_members(records: DataFrame, path: str) -> None:
    """Archives of about ARCHIVE_BYTES of records (columns of text), a gzip member each.

    Spark's text writer takes the members' bytes as they are; the separator that it puts at the end of every row, and so of every archive, is
    an empty member, which the Latin-1 encoding passes through unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.cast(pa.binary()) for c in batch.columns), strict=True):
                for record in row:
                    held.append(gzip.compress(record.as_buffer().to_pybytes() + _END.encode(), LEVEL, mtime=0))
                    size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    empty = gzip.compress(b"", 6, mtime=0).decode("latin-1")
    archives = by_batches(records).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("lineSep", empty).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


_RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, http_status int, payload_bytes long, fields string, payload binary"


def _parts(data: memoryview) -> Iterator[bytes]:
    """The bytes of an archive, member by member if it is gzip, else whole."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield bytes(data)
        return
    at = 0
    while bytes(data[at : at + 2]) == b"\x1f\x8b":
        one, out, step = zlib.decompressobj(31), [], STEP_BYTES
        while not one.eof and at < len(data):
            # by small steps first, as what a call is given beyond the member's end is copied
            out.append(one.decompress(data[at : at + step]))
            at, step = min(at + step, len(data)), min(2 * step, READ_BYTES)
        at -= len(one.unused_data)
        yield b"".join(out)


def records_of(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of every record; a record may go over several parts, and a part hold several records."""
    data, at, open_ = b"", 0, True

    def more() -> bool:
        nonlocal data, at, open_
        found = next(parts, None)
        if found is None:
            open_ = False
        else:
            data, at = data[at:] + found, 0
        return open_

    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at == len(data):
            if not more():
                return
            continue
        while (end := data.find(b"\r\n\r\n", at)) < 0 and more():
            pass
        first, *lines = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        # places from here on are counted from at, which more() moves
        start = (end + 4 if end >= 0 else len(data)) - at
        if headers.get("content-length", "").isdigit():
            stop = start + int(headers["content-length"])
            while len(data) - at < stop and more():
                pass
        else:
            # without a length the record ends where the next begins
            while (found := _NEXT.search(data, at + max(0, start - 4))) is None and more():
                pass
            stop = (found.start() if found else len(data.rstrip(b"\r\n"))) - at
        stop = max(start, stop)
        yield headers, data[at + start : at + stop]
        at = min(at + stop, len(data))


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, bare = headers.get("warc-type"), lambda x: x and x.strip("<>")
    digest, status, size, fields, payload = headers.get("warc-payload-digest", "").rpartition(":")[2] or None, None, None, None, None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        if found := re.match(rb"HTTP/\S+\s+(\d{1,9})\b", head):
            status, fields = int(found[1]), head.decode("utf-8", "replace")
        else:
            body = block
        if kind == "response":
            digest, size, payload = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body), body
    elif kind == "metadata":
        fields = block.decode("utf-8", "replace")
    return bare(headers.get("warc-record-id")), kind, bare(headers.get("warc-concurrent-to")), bare(headers.get("warc-refers-to")), headers.get("warc-target-uri"), digest, status, size, fields, payload if with_payload else None


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record. payload_digest and payload_bytes are taken from the payload where the record holds it."""
    names = [x.split()[0] for x in _RECORD.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in _RECORD.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for headers, block in records_of(_parts(memoryview(content.as_buffer()))):
                    rows.append(_row(headers, block, with_payload))
                    size += 500 + (len(block) if with_payload else len(rows[-1][8] or ""))
                    if size >= READ_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return by_batches(spark.read.format("binaryFile").load(path).select("content")).mapInArrow(run, _RECORD)


_MAIN = "record_type IN ('response', 'revisit')"


def capture_ids(records: DataFrame) -> DataFrame:
    """(record_id, capture_id) of records that no single step of WARC-Concurrent-To leads to a response: those that a response names, and those at the end of
    longer chains, which are resolved as components of the records' links. Ids alone are read."""
    ids = materialize(records.select("record_id", "record_type", "concurrent_to").where("record_id IS NOT NULL"), "records")
    main = ids.where(_MAIN).select(F.col("record_id").alias("main"))
    others = ids.where(f"NOT {_MAIN} AND concurrent_to IS NOT NULL")
    lost = others.join(main, others["concurrent_to"] == main["main"], "left_anti")
    named = ids.where(f"{_MAIN} AND concurrent_to IS NOT NULL")
    loose = materialize(lost.unionByName(named).select("record_id", "concurrent_to"), "loose")
    nothing = records.sparkSession.createDataFrame([], "record_id string, capture_id string")
    if loose.isEmpty():
        return nothing
    # every link that touches a loose one's component
    links = materialize(ids.where("concurrent_to IS NOT NULL").select(F.col("record_id").alias("a"), F.col("concurrent_to").alias("b")), "concurrent")
    found = connected_components(links)
    found = found.union(found.select("root", "root").distinct())
    mains = found.join(main, found["node"] == main["main"]).select("root", F.col("main").alias("capture_id"))
    return found.join(mains, "root").select(F.col("node").alias("record_id"), "capture_id").where("record_id <> capture_id")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response struct, request struct, metadata array).

    Requests and metadata mostly name their response, so all three meet under that id in one shuffle; `capture_ids` finds the others'."""
    more = capture_ids(records)
    step = F.when(F.expr(_MAIN), F.col("record_id")).otherwise(F.col("concurrent_to"))
    shape = F.struct("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "http_status", "payload_bytes", "fields", "payload")
    direct = records.withColumn("capture_id", step).where("capture_id IS NOT NULL")
    if not more.isEmpty():
        direct = direct.unionByName(records.where(f"NOT {_MAIN}").join(more, "record_id").select(*direct.columns))
    asked, noted = F.col("record_type") == "request", F.col("record_type") == "metadata"
    return (
        direct.groupBy("capture_id")
        .agg(
            F.first(F.when(F.expr(_MAIN), shape), ignorenulls=True).alias("response"),
            F.min(F.when(asked, F.struct("record_id", "target_uri"))).alias("request"),
            F.sort_array(F.collect_set(F.when(noted, F.struct("record_id", "fields")))).alias("metadata"),
        )
        .where("response IS NOT NULL")
    )


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives that `write` made at path."""
    whole = assemble(materialize(read(spark, path, with_payload=False), "records"))

    def page(name: str) -> Column:
        return F.expr(f"try_cast(split({name}, ':')[2] AS bigint)")

    # a revisit holds no payload: its length stands in the metadata record
    noted = F.regexp_extract(F.col("metadata")[0]["fields"], r"payload-bytes: (\d+)", 1).cast("long")
    return whole.select(page("capture_id").alias("page_id"), F.coalesce("response.payload_bytes", noted).alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), page("response.refers_to").alias("refers_to"))
