"""WARC archives: written by Spark's text sink, read by a Python data source.

Writing is native. A record is one text value and the record separator is the line separator, so
archives come through Spark's commit protocol to any file system it writes to. Of pages with equal
payloads of ``min_bytes`` and more, the one with the largest id is stored as response and the others
as revisits of it. Payloads are compared by digest and length in a narrow pass; html itself is
shuffled only if the table of repeated payloads is too large to send along.

Reading plans whole files into partitions by their sizes. Each header is parsed first; a record whose
type or header fails a pushed predicate is passed over by seeking, and its payload is neither read
nor decoded (nor is any payload with the option ``payload`` set to false).

Defined cases: a null payload is empty; a null url has no target header; a row with a null id is a
response that nothing refers to; rows that repeat the id of a response with the same payload are
responses too; control characters and blanks in urls are percent-encoded; empty tables give empty
archives; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, In, InputPartition,
                                    IsNotNull, StringStartsWith)

from shelfmark.session import work_path

MIN_BYTES = 1000
#: Records per archive file and bytes per reading task.
FILE_RECORDS = 100_000
TASK_BYTES = 32 << 20
_BATCH_BYTES = 4 << 20
_URN = "urn:page:"
_END = "\r\n"

SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, "
          "payload_digest string, payload_length long, file string, offset long, payload binary")
_HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
            "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def _lines(*pairs) -> Column:
    return F.concat(*(F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(_END)))
                      if name else F.concat(value, F.lit(_END)) for name, value in pairs))


def _urn(id: Column) -> Column:
    return F.concat(F.lit(f"<{_URN}"), F.coalesce(id.cast("string"), F.lit("none")), F.lit(">"))


def _safe_uri(url: Column) -> Column:
    safe = F.replace(url, F.lit("%"), F.lit("%25"))
    for code in [*range(33), 127]:
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return safe


def with_revisits(pages: DataFrame, *, id: str = "page_id", payload: str = "html",
                  min_bytes: int = MIN_BYTES) -> DataFrame:
    """The rows with id, payload (never null), length, digest, and refers_to: the id they revisit."""
    body = F.coalesce(pages[payload], F.lit(""))
    # Payloads may be text or bytes; as text column bytes pass through unchanged.
    rows = pages.select(pages[id].cast("long").alias("id"), pages["url"].alias("url"),
                        body.cast("string").alias("payload"), F.octet_length(body).cast("long").alias("length"),
                        F.sha1(body.cast("binary")).alias("digest"))
    path = work_path(pages.sparkSession, "warc-repeats")
    (rows.where((F.col("length") >= min_bytes) & F.col("id").isNotNull()).groupBy("digest", "length")
     .agg(F.max("id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
     .select("digest", "length", "owner").write.parquet(path))
    owners = pages.sparkSession.read.parquet(path)
    return (rows.join(owners, ["digest", "length"], "left")
            .withColumn("refers_to", F.when(F.col("owner") != F.col("id"), F.col("owner"))).drop("owner"))


def write_archives(pages: DataFrame, path: str, *, id: str = "page_id", payload: str = "html",
                   min_bytes: int = MIN_BYTES, date: str = "2024-01-01T00:00:00Z",
                   compression: str = "none", file_records: int = FILE_RECORDS) -> None:
    """One WARC/1.1 record per row into archive files below ``path``."""
    rows = with_revisits(pages, id=id, payload=payload, min_bytes=min_bytes)
    again = F.col("refers_to").isNotNull()
    http = _lines((None, F.lit("HTTP/1.1 200 OK")), ("Content-Type", F.lit("text/html; charset=utf-8")),
                  ("Content-Length", F.col("length").cast("string")), (None, F.lit("")))
    rows = rows.withColumn("block", F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload"))))
    head = _lines(
        (None, F.lit("WARC/1.1")), ("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", _urn(F.col("id"))), ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", _safe_uri(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Refers-To", F.when(again, _urn(F.col("refers_to")))),
        ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("block").cast("string")), (None, F.lit("")))
    (rows.select(F.concat(head, F.col("block")).alias("value")).write
     .option("lineSep", _END * 2).option("compression", compression)
     .option("maxRecordsPerFile", file_records).text(path))


def read_archives(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """The records of all archives below ``path`` with the columns of ``SCHEMA``.

    Only names and sizes of the files are listed here; filters on record_type and on header columns
    reach the reader.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    files = [[r.path, r.length] for r in spark.read.format("binaryFile").load(path)
             .select("path", "length").orderBy("path").collect()]
    return (spark.read.format("warc").option("files", json.dumps(files))
            .option("payload", str(payload).lower()).load())


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.payload = options.get("payload", "true") == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:
        kinds = {EqualTo: "eq", In: "in", IsNotNull: "some", StringStartsWith: "starts"}
        for f in filters:
            kind, column = kinds.get(type(f)), f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if kind and column in _HEADERS:
                self.tests.append((kind, column, None if kind == "some" else f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        parts, held, size = [], [], 0
        for path, length in self.files:
            if held and size + length > TASK_BYTES:
                parts.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += length
        return parts + [Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, SCHEMA.split(", "))])
        rows, size = [], 0
        for path in partition.paths:
            for row in records(path, self.tests, self.payload):
                rows.append(row)
                size += 256 + len(row[-1] or b"")
                if size >= _BATCH_BYTES:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def _open(path: str):
    """Any file system that executors share, compressed archives decompressed on the way."""
    from pyarrow import fs
    if path.startswith("file:"):
        system, name = fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    else:
        system, name = fs.FileSystem.from_uri(path)
    packed = name.endswith((".gz", ".bz2", ".zst"))
    return (system.open_input_stream(name, buffer_size=1 << 20), False) if packed else (system.open_input_file(name), True)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def _holds(tests, values: dict) -> bool:
    for kind, column, wanted in tests:
        have = values[column]
        if have is None or not (kind == "some" or kind == "eq" and have == wanted
                                or kind == "in" and have in wanted
                                or kind == "starts" and have.startswith(wanted)):
            return False
    return True


class _Cursor:
    """Reads ahead in blocks; passes over what is not wanted by seeking where the file allows."""

    def __init__(self, file, seekable: bool):
        self.file, self.seekable, self.held, self.offset = file, seekable, b"", 0

    def _fill(self, more: int) -> bool:
        got = self.file.read(max(more, 1 << 18))
        self.held += got
        return bool(got)

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._fill(0):
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._fill(n - len(self.held)):
            pass
        got, self.held = self.held[:n], self.held[n:]
        self.offset += len(got)
        return got

    def skip(self, n: int) -> None:
        inside = min(n, len(self.held))
        self.held = self.held[inside:]
        self.offset += inside
        if rest := n - inside:
            if self.seekable:
                self.file.seek(rest, 1)
                self.offset += rest
            else:
                while rest and (got := len(self.take(min(rest, 1 << 20)))):
                    rest -= got


def records(path: str, tests, payload: bool) -> Iterator[tuple]:
    file, seekable = _open(path)
    with file:
        cursor = _Cursor(file, seekable)
        while True:
            start = cursor.offset
            head = cursor.until(b"\r\n\r\n")
            if head is None:
                if cursor.held.strip():
                    raise ValueError(f"{path}: a record at {start} breaks off")
                return
            if not head.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record at {start}")
            fields = _fields(head)
            length = int(fields["content-length"])
            values = {column: fields.get(name) for column, name in _HEADERS.items()}
            if not _holds(tests, values):
                cursor.skip(length + 4)
                continue
            block_end = cursor.offset + length
            http = _fields(cursor.until(b"\r\n\r\n")) if length else {}
            body = None
            if payload and values["record_type"] != "revisit":
                body = cursor.take(block_end - cursor.offset)
                if cursor.offset != block_end:
                    raise ValueError(f"{path}: the record at {start} breaks off")
            cursor.skip(block_end - cursor.offset + 4)
            yield (*values.values(), int(http["content-length"]) if "content-length" in http else None,
                   path, start, body)


def page_number(urn: Column) -> Column:
    """The id in a record id of ``write_archives``; null for a row without id."""
    return F.regexp_extract(urn, f"^<{_URN}(-?[0-9]+)>$", 1).try_cast("long")
