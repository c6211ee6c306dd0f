"""WARC files: an index first, then coalesced sorted byte-range reads of the records that were selected.

The index has file, offset, length, url, digest and record id of each response; building it streams each file once. A selection is any
filter or join on the index. Its records are sorted by file and offset, neighbours within `gap` bytes are read at once in ranges of
about `span` bytes, and the ranges are spread over the cluster.

Defined results: pages with null html get no record; a null url or id is written as an empty field and read as null; an empty html is a
record of 0 bytes; line breaks in a url are percent-encoded; a file's index ends at a record that is cut off or not WARC; several records of a digest
or url are all indexed; other columns of pages are ignored; empty tables give no records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

INDEX = "file string, offset long, length long, url string, digest string, record_id long, bytes long"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), store.local_path(uri))


def _record(page_id, url, html: str) -> bytes:
    body = html.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Target-URI: {target}\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(body)}\r\n\r\n"
    return head.encode() + http + body + b"\r\n\r\n"


def write(pages: DataFrame, path: str, file_bytes: int = 256 << 20, level: int = 6) -> DataFrame:
    """Write pages (page_id, url, html) as gzip members to files of about file_bytes; (file) of those that succeeded.

    A task that is run again leaves files that no row names.
    """

    def run(batches):
        out, name, size, names = None, "", 0, []
        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                    system, place = _open(name)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out, size = system.open_output_stream(place, compression=None), 0
                    names.append(name)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = z.compress(_record(page_id, url, html)) + z.flush()
                out.write(data)
                size += len(data)
                if size >= file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).filter("html is not null")
    return store.materialise(rows.mapInArrow(run, "file string"), "warc-files")


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each whole gzip member of a stream."""
    at, data = 0, stream.read(chunk)
    while data:
        z, parts, used = zlib.decompressobj(31), [], 0
        try:
            while True:
                parts.append(z.decompress(data))
                if z.eof:
                    used += len(data) - len(z.unused_data)
                    data = z.unused_data
                    break
                used += len(data)
                data = stream.read(chunk)
                if not data:
                    return
        except zlib.error:
            return
        yield at, used, b"".join(parts)
        at += used
        data = data or stream.read(chunk)


def parse(record: bytes) -> tuple[dict[str, str], bytes] | None:
    """(headers, payload) of a record; the payload of a response is what follows its HTTP headers."""
    head, found, rest = record.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        return None
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]))
    body = rest[: int(fields.get("content-length") or 0)]
    if fields.get("warc-type") == "response":
        body = body.partition(b"\r\n\r\n")[2]
    return fields, body


def _row(fields: dict[str, str], body: bytes) -> tuple:
    record = fields.get("warc-record-id", "").strip("<>").rpartition(":")[2]
    return fields.get("warc-target-uri") or None, fields.get("warc-payload-digest", "").partition(":")[2] or hashlib.sha256(body).hexdigest(), int(record) if record.lstrip("-").isdigit() else None, len(body)


def index(files: DataFrame) -> DataFrame:
    """The index of all responses in files (file), one task for each file."""

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                system, place = _open(name)
                with system.open_input_stream(place, compression=None) as stream:
                    for at, length, data in members(stream):
                        got = parse(data)
                        if got is None:
                            break
                        if got[0].get("warc-type") == "response":
                            rows.append((name, at, length, *_row(*got)))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    spark = files.sparkSession
    many = max(1, min(files.count(), 64 * store.partitions(spark)))
    return store.materialise(files.repartition(many, "file").mapInArrow(run, INDEX), "warc-index")


_TYPES = (("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_id", pa.int64()), ("bytes", pa.int64()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_TYPES)], [n for n, _ in _TYPES])


def ranges(selected: DataFrame, gap: int = 64 << 10, span: int = 4 << 20) -> DataFrame:
    """(file, start, end, records): sorted byte ranges that cover the selected records, of about span bytes at most."""
    by = Window.partitionBy("file").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(by)
    cut = (before.isNull() | (F.col("offset") - before > gap) | (F.floor(F.col("offset") / span) != F.floor(F.lag("offset").over(by) / span))).cast("int")
    part = selected.withColumn("cut", cut).withColumn("part", F.sum("cut").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy("file", "part").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")).select("file", "start", "end", "records")


def read(selected: DataFrame, **options) -> DataFrame:
    """(record_id, url, digest, bytes, html) of the selected index rows."""

    def run(batches):
        for b in batches:
            for name, start, end, records in zip(*(c.to_pylist() for c in b.columns)):
                system, place = _open(name)
                with system.open_input_file(place) as f:
                    data = f.read_at(end - start, start)
                out = []
                for r in records:
                    at = r["offset"] - start
                    fields, body = parse(zlib.decompress(data[at : at + r["length"]], 31))
                    url, digest, record_id, size = _row(fields, body)
                    out.append((record_id, url, digest, size, body.decode("utf-8", "replace")))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], ["record_id", "url", "digest", "bytes", "html"])

    plan = ranges(selected, **options)
    return plan.repartition(store.partitions(plan.sparkSession), "file", "start").mapInArrow(run, "record_id long, url string, digest string, bytes long, html string")


def first_of_digest(index: DataFrame) -> DataFrame:
    """The index row with the smallest record id (nulls last) of each digest."""
    rank = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("record_id").asc_nulls_last(), "file", "offset"))
    return index.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """pages written as WARC, indexed, and the first record of each digest read back."""
    files = write(pages, store.new_path(spark, "warc"))
    return read(first_of_digest(index(files)))
