"""Web archives as a Spark data source, for reading and writing.

``read_warc`` plans one partition for each batch of files, reads a record's headers first and tests them against the
filters that Spark pushes down (equality, membership, beginnings and nullness of header columns); the content of a record
that fails is skipped undecoded. Records end where their declared length says, whatever the content holds; files may be
plain or compressed record by record, version 1.0 or 1.1.

``write_archives`` writes pages as records of compressed files. A payload seen before is written once, as a response; its
other records are revisits that name it. Every task writes files of its own under fresh names, and the driver lists the
files of the successful tasks in a manifest, which readers go by, so a task that ran twice leaves no record twice.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

MANIFEST = "_files.json"
FILE_BYTES = 64 << 20
PARTITION_BYTES = 32 << 20
BATCH_BYTES = 8 << 20

#: Column and header it comes from
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "record_date": "warc-date",
    "refers_to": "warc-refers-to", "declared_digest": "warc-payload-digest", "content_type": "content-type",
}
SCHEMA = ("record_type string, record_id string, target_uri string, record_date string, refers_to string, declared_digest string, "
          "content_type string, payload_bytes bigint, payload_digest string, complete boolean, payload binary")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# -- reading ------------------------------------------------------------------------------------------------------


@dataclass
class _Files(InputPartition):
    paths: list[str]


def _holds(test, headers: dict[str, str]) -> bool:
    value = headers.get(HEADERS[test.attribute[0]])
    if isinstance(test, EqualTo):
        return value == test.value
    if isinstance(test, In):
        return value in test.value
    if isinstance(test, StringStartsWith):
        return value is not None and value.startswith(test.value)
    return (value is None) == isinstance(test, IsNull)


def records(file, tests: Sequence = ()) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers (names in lower case) and content of the records of one file; None for an incomplete content."""
    while True:
        line = file.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins here: {line[:60]!r}")
        headers: dict[str, str] = {}
        name = ""
        while (line := file.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and name:  # a header goes on
                headers[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
        length = int(headers.get("content-length", "0"))
        if all(_holds(t, headers) for t in tests):
            content = file.read(length)
            yield headers, content if len(content) == length else None
        else:
            while length > 0:
                skipped = len(file.read(min(length, 1 << 20)))
                length = length - skipped if skipped else 0


def _payload(headers: dict[str, str], content: bytes) -> tuple[bytes, int | None]:
    """What follows the protocol's own headers, and the length these declare."""
    if not headers.get("content-type", "").startswith("application/http"):
        return content, None
    head, mark, body = content.partition(b"\r\n\r\n")
    declared = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    return (body if mark else b""), int(declared[1]) if declared else None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload, self.tests = path, with_payload, []

    def pushFilters(self, filters):
        for test in filters:
            if isinstance(test, (EqualTo, In, StringStartsWith, IsNull, IsNotNull)) and len(test.attribute) == 1 and test.attribute[0] in HEADERS:
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> Sequence[InputPartition]:
        store, root = _open(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [_Files([root])]
        found = {i.path: i.size for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File}
        manifest = f"{root.rstrip('/')}/{MANIFEST}"
        if manifest in found:
            with store.open_input_stream(manifest) as file:
                names = {f"{root.rstrip('/')}/{n}" for n in json.loads(file.read())}
            if missing := names - found.keys():
                raise FileNotFoundError(f"files of the archive are gone: {sorted(missing)[:3]}")
        else:
            names = {p for p in found if re.search(r"\.warc(\.gz)?$", p)}
        out: list[_Files] = []
        filled = PARTITION_BYTES
        for path in sorted(names):
            if filled + found[path] > PARTITION_BYTES:
                out.append(_Files([]))
                filled = 0
            out[-1].paths.append(path)
            filled += found[path]
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        schema = _arrow_schema()
        rows: dict[str, list] = {name: [] for name in schema.names}
        held = 0
        for path in partition.paths:
            with store.open_input_file(path) as raw:
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                plain = io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw, 1 << 18)
                for headers, content in records(plain, self.tests):
                    body, declared = _payload(headers, content or b"")
                    for column, name in HEADERS.items():
                        rows[column].append(headers.get(name))
                    revisit = headers.get("warc-type") == "revisit"
                    digest = headers.get("warc-payload-digest", "")
                    rows["payload_bytes"].append(declared if revisit else len(body))
                    rows["payload_digest"].append(digest.removeprefix("sha1:") or None if revisit else base32_sha1(body))
                    rows["complete"].append(content is not None)
                    rows["payload"].append(body if self.with_payload and not revisit else None)
                    held += 200 + len(body) * self.with_payload
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pydict(rows, schema=schema)
                        rows, held = {name: [] for name in schema.names}, 0
        if held:
            yield pa.RecordBatch.from_pydict(rows, schema=schema)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])


# -- writing ------------------------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


def _header(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, uri: str | None, date: str, digest: str, size: int, refers_to: str | None, payload: bytes) -> bytes:
    """One record; a revisit has the protocol's headers, with the full length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    content = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_header(uri)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(content)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    """Takes columns record_type, record_id, target_uri, record_date, digest (of the payload, hexadecimal), size, refers_to, payload."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        names, out, filled = [], None, 0
        for batch in iterator:
            for row in zip(*(batch.column(c) for c in ("record_type", "record_id", "target_uri", "record_date", "digest", "size", "refers_to", "payload"))):
                kind, own, uri, date, digest, size, refers_to, payload = (x.as_py() for x in row)
                if out is None or filled > FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, filled = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                packed = gzip.compress(record(kind, own, uri, date, base64.b32encode(bytes.fromhex(digest)).decode(), size, refers_to, payload or b""), compresslevel=1)
                out.write(packed)
                filled += len(packed)
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}", compression=None) as file:
            file.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list) -> None:
        store, root = _open(self.path)
        for m in messages:
            for name in m.names if m else []:
                store.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"])


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of a file or folder. Filters on the header columns are tested before a record's content is touched; with
    ``payload=False`` contents are measured and digested but not handed over. Switches on filter push-down for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload)).load(path)


def archive_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages as records: of equal payloads of at least ``least_bytes`` the one with the largest id is the response.

    A null page is an empty payload. Null ids come after all others; rows that share the largest id of a payload are all
    responses. A null address gives a record without one.
    """
    rows = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("target_uri"), F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("bigint"))
    known = pages.select(F.col(f"`{page_id}`").alias("id"), F.sha1(F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")).alias("digest"))
    first = known.groupBy("digest").agg(F.max("id").alias("first"))
    both = rows.join(first, "digest")
    again = (F.col("size") >= least_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.format_string("<urn:page:%s>", F.coalesce(F.col(c).cast("string"), F.lit("")))
    return both.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), name("id").alias("record_id"), "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("record_date"), "digest", "size", F.when(again, name("first")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Write pages into archive files under ``path``. Options as in :func:`archive_records`."""
    pages.sparkSession.dataSource.register(WarcSource)
    archive_records(pages, **options).write.format("warc").mode("append").save(path)
