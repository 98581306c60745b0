"""Web-archive files: listing, records and payload decoding.

Spark lists the files and deals them out in pieces; each task reads its pieces as streams, record by record. A record ends where its
declared length says, so a page may hold anything, and no more than one record is in memory.
"""

from __future__ import annotations

import codecs
import io
import itertools
import re
import time
import zlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RECORD_SCHEMA = ("record_type string, url string, download_date string, http_status int, content_type string, payload binary, "
                 "is_complete boolean, file string, record bigint, seconds double, error string")
BATCH_BYTES = 8 << 20
PIECE_BYTES = 4 << 20

# Fixed value: time stamp inside an archive file name.
FILE_STAMP = r"-(\d{14})-"


def archive_files(listing: DataFrame, start: str, now: str, path: str = "path") -> DataFrame:
    """Files whose name carries a time at or after ``start``, from the month folders ``yyyy/MM`` from then to ``now``.

    The folder test comes first: it is a plain set membership that prunes a partitioned listing.
    """
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz")
    months = F.transform(
        F.sequence(F.date_trunc("month", first).cast("date"), F.date_trunc("month", last).cast("date"), F.expr("INTERVAL 1 MONTH")),
        lambda m: F.date_format(m, "yyyy/MM"),
    )
    stamp = F.try_to_timestamp(F.regexp_extract(path, FILE_STAMP, 1), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    folder = F.regexp_extract(path, r"(\d{4}/\d{2})/[^/]*$", 1)
    return listing.where(F.array_contains(months, folder)).withColumn("stamp", stamp).where(F.col("stamp") >= first)


def list_archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names, sizes and times of the files of a folder tree, contents not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc*").load(folder)
    return files.select("path", "length", F.col("modificationTime").cast("timestamp_ntz").alias("modified"))


def _content(file, length: int) -> bytes:
    """What there is of ``length`` bytes; no memory is taken for more, whatever a record declares."""
    parts = []
    while length > 0 and (part := file.read(min(length, 1 << 20))):
        parts.append(part)
        length -= len(part)
    return b"".join(parts)


class _Slice(io.RawIOBase):
    """The bytes of a file from ``start``, as many as ``length`` or up to its end."""

    def __init__(self, file, start: int, length: int | None):
        file.seek(start)
        self.file, self.left = file, length

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        wanted = len(target) if self.left is None else min(len(target), self.left)
        data = self.file.read(wanted)
        target[: len(data)] = data
        if self.left is not None:
            self.left -= len(data)
        return len(data)


class _Members(io.RawIOBase):
    """Unpacked bytes of gzip members one after another; damage is met when it is reached, not ahead. ``starts`` lists, as far as read, where each begins: place in
    the unpacked bytes, place in the file."""

    def __init__(self, file):
        self.file, self.at, self.data, self.taken = file, 0, b"", 0
        self.starts, self.member = deque(), None

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while True:
            if not self.data:
                self.data = self.file.read(1 << 18)
                self.taken += len(self.data)
                if not self.data:
                    if self.member is not None:
                        raise EOFError
                    return 0
            if self.member is None:
                if self.taken > len(self.data):  # padding between members and behind the last
                    self.data = self.data.lstrip(b"\0")
                    if not self.data:
                        continue
                self.member = zlib.decompressobj(31)
                self.starts.append((self.at, self.taken - len(self.data)))
            part = self.member.decompress(self.data, len(target))
            self.data = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if self.member.eof:
                self.member = None
            if part:
                target[: len(part)] = part
                self.at += len(part)
                return len(part)


class _Placed:
    """A file read in order that knows how far it has been read."""

    def __init__(self, file):
        self.file, self.at = file, 0

    def readline(self) -> bytes:
        line = self.file.readline()
        self.at += len(line)
        return line

    def read(self, length: int) -> bytes:
        data = self.file.read(length)
        self.at += len(data)
        return data


def _records(file, begun=lambda line: None) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Headers (names in lower case), content, and whether the content has its declared length. ``begun`` hears the first
    line of every record."""
    while line := file.readline():
        if not line.startswith(b"WARC/"):  # blank lines between records, or the rest of a record that was too long
            continue
        begun(line)
        headers: dict[str, str] = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        declared = headers.get("content-length", "")
        if re.fullmatch(r"[0-9]{1,18}", declared):
            length = int(declared)
            content = _content(file, length)
            yield headers, content, len(content) == length
        else:
            yield headers, b"", False


def _fields(headers: dict[str, str], content: bytes) -> dict:
    """One row of the record table."""
    row = {"record_type": headers.get("warc-type"), "url": headers.get("warc-target-uri"), "download_date": headers.get("warc-date"),
           "http_status": None, "content_type": headers.get("content-type"), "payload": content}
    if content.startswith(b"HTTP/"):
        head, _, row["payload"] = content.partition(b"\r\n\r\n")
        status = re.match(rb"HTTP/\S+ (\d{3})\b", head)
        kind = re.search(rb"(?im)^content-type:[ \t]*([^\r\n]*)", head)
        row["http_status"] = int(status[1]) if status else None
        row["content_type"] = (kind[1].strip().decode("latin-1") or None) if kind else None
    return row


def _rows(file, path: str, number: int) -> Iterator[dict]:
    """Rows of a file. Packed data that can't be unpacked any further end it with a row that has nothing but the error;
    errors of the storage are no property of the file, they fail the task, which Spark tries again."""
    begun = time.perf_counter()
    try:
        for headers, content, whole in _records(file):
            row = {**_fields(headers, content), "is_complete": whole, "file": path, "record": number}
            yield {**row, "seconds": time.perf_counter() - begun}
            number, begun = number + 1, time.perf_counter()
    except (EOFError, zlib.error) as error:
        reason = "cut" if isinstance(error, EOFError) else "damaged"
        yield {"payload": None, "file": path, "record": number, "seconds": time.perf_counter() - begun, "error": reason}


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD_SCHEMA.split(", ")])
    rows, held = [], 0
    for batch in batches:
        for path, start, length, first in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as raw:
                packed = raw.read(2) == b"\x1f\x8b"
                part = io.BufferedReader(_Slice(raw, start, length), 1 << 18)
                for row in _rows(io.BufferedReader(_Members(part), 1 << 18) if packed else part, path, first):
                    rows.append(row)
                    held += 200 + len(row["payload"] or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archive records as ``(record_type, url, download_date, http_status, content_type, payload, is_complete, file, record,
    seconds, error)``: ``record`` is the number within the file, ``seconds`` what reading it took.

    Plain or gzipped files, of any version. A record whose file ends before its declared length, or that declares none or no
    number, is not ``is_complete``; reading goes on at the next line that begins a record. A gzipped file that is cut or damaged gives
    the records before the damage and one row that has only the ``error``: cut or damaged.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path")
    return records_of(files)


def records_of(files: DataFrame, path: str = "path") -> DataFrame:
    """The records of a table of file addresses. Files of more than ``PIECE_BYTES`` are read by several tasks."""
    return records_in_ranges(record_ranges(files, path, PIECE_BYTES))


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Addresses over a fixed number of tasks: they are so few bytes that adaptive execution would put all into one."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


RANGE_SCHEMA = "path string, start bigint, length bigint, first bigint"


def record_ranges(files: DataFrame, path: str = "path", size: int = 64 << 20) -> DataFrame:
    """An index of archive files: ``(path, start, length, first)``, pieces of ``size`` bytes or a record more.

    A piece begins with a record, and in gzipped files also with a gzip member, so it can be read without what is before it; a file
    that is one single member is one piece. ``first`` is the number of its first record. The last piece goes to the end of the
    file (``length`` null), with whatever damage is there. Making the index reads each file that is larger than ``size`` once, in
    one task; write it down. From then on large files are read by many tasks, and a job that keeps the pieces it has done goes
    on inside a file.
    """
    spread = _dealt(files.select(F.col(path).alias("path")), "path")
    return spread.mapInArrow(_index_files(size), RANGE_SCHEMA)


def records_in_ranges(ranges: DataFrame) -> DataFrame:
    """The records of the pieces of :func:`record_ranges`, the same rows as :func:`records_of` gives for whole files."""
    spread = _dealt(ranges.select("path", "start", "length", "first"), "path", "start")
    return spread.mapInArrow(_read_files, RECORD_SCHEMA)


def _index_files(size: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                cuts = _cuts(path, size)
                ends = [None if after is None else after[0] - cut[0] for cut, after in zip(cuts, [*cuts[1:], None], strict=True)]
                columns = [[path] * len(cuts), [start for start, _ in cuts], ends, [first for _, first in cuts]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "start", "length", "first"])

    return index


def _cuts(path: str, size: int) -> list[tuple[int, int]]:
    """Where the pieces of a file begin, and the number of the first record of each."""
    store, name = fs.FileSystem.from_uri(path)
    if (store.get_file_info(name).size or 0) <= size:
        return [(0, 0)]
    with store.open_input_file(name) as raw:
        packed = raw.read(2) == b"\x1f\x8b"
        whole = _Slice(raw, 0, None)
        members = _Members(io.BufferedReader(whole, 1 << 18)) if packed else None
        file = _Placed(io.BufferedReader(members if packed else whole, 1 << 18))
        cuts, records = [(0, 0)], itertools.count()

        def begun(line: bytes) -> None:
            """A record begins with ``line``; where its place is one in the file, and far enough, a piece begins."""
            place, number = file.at - len(line), next(records)
            if packed:
                while members.starts and members.starts[0][0] < place:
                    members.starts.popleft()
                place = members.starts[0][1] if members.starts and members.starts[0][0] == place else 0
            if place - cuts[-1][0] >= size:
                cuts.append((place, number))

        try:
            for _ in _records(file, begun):
                pass
        except (EOFError, zlib.error):
            pass  # the last piece has the damage
    return cuts




def declared_charset(content_type: Column, payload: Column) -> Column:
    """Charset of the header, else of the page itself."""
    text = F.decode(payload, "ISO-8859-1")
    return F.lower(F.coalesce(
        F.nullif(F.regexp_extract(content_type, r"(?i)charset=[\"']?([\w-]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(text, r"(?i)<meta[^>]*charset=[\"']?([\w-]+)", 1), F.lit("")),
    ))


def is_valid_utf8(payload: Column) -> Column:
    return F.is_valid_utf8(payload.cast("string"))


UTF8_NAMES = ["utf-8", "utf8"]


def _decoder(errors: str):
    @F.pandas_udf("string")
    def decoded(payload: pd.Series, charset: pd.Series) -> pd.Series:
        out = []
        for data, name in zip(payload, charset):
            text = None
            if data is not None:
                for known in (name, "utf-8"):
                    try:
                        codecs.lookup(known or "utf-8")
                        text = bytes(data).decode(known or "utf-8", errors)
                        break
                    except (LookupError, UnicodeDecodeError, ValueError):
                        continue
            out.append(text)
        return pd.Series(out, dtype=object)

    return decoded


def decode_payload(payload: Column, charset: Column, errors: str = "strict") -> Column:
    """Bytes to text: by the declared charset, else as UTF-8.

    ``errors`` is ``"strict"`` (null when neither fits) or ``"replace"`` (what doesn't fit becomes the replacement sign).
    Valid UTF-8 that is declared so or not at all is decoded by Spark; only other rows go through Python.
    """
    if errors not in ("strict", "replace"):
        raise ValueError(f"errors is strict or replace, not {errors}")
    plain = F.coalesce(charset.isin(UTF8_NAMES), F.lit(True)) & is_valid_utf8(payload)
    other = _decoder(errors)(F.when(~plain, payload), charset)
    return F.when(plain, F.decode(payload, "UTF-8")).otherwise(other)


def decoded_pages(records: DataFrame, errors: str = "strict") -> DataFrame:
    """Complete response records with decodable, non-empty payload as ``html``; :func:`discarded_records` counts the others."""
    pages = _with_text(records, errors)
    return pages.where(_is_usable(pages)).drop("payload", "is_complete", "record", "seconds", "error")


def discarded_records(records: DataFrame, errors: str = "strict") -> DataFrame:
    """How many response records :func:`decoded_pages` leaves out, by reason."""
    pages = _with_text(records, errors)
    reason = F.when(~_complete(pages), "incomplete").when(F.length("payload") == 0, "empty").otherwise("undecodable")
    return pages.where(~_is_usable(pages)).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def page_records(records: DataFrame, errors: str = "strict") -> DataFrame:
    """Every response record, and the row of every damaged file, with its text ``html`` and why it has none in ``fault``: ``damaged``,
    ``incomplete``, ``empty``, ``undecodable``, null where nothing is wrong."""
    pages = _with_text(records.where((F.col("record_type") == "response") | F.col("error").isNotNull()).drop("record_type"), errors)
    fault = F.when(F.col("error").isNotNull(), "damaged").when(~_complete(pages), "incomplete")
    fault = fault.when(F.coalesce(F.length("payload"), F.lit(0)) == 0, "empty").when(F.coalesce(F.length("html"), F.lit(0)) == 0, "undecodable")
    return pages.withColumn("fault", fault).drop("payload", "is_complete", "error")


def _with_text(records: DataFrame, errors: str) -> DataFrame:
    wanted = records.where(F.col("record_type") == "response") if "record_type" in records.columns else records
    text = decode_payload(F.col("payload"), declared_charset(F.col("content_type"), F.col("payload")), errors)
    # a generator is not repeated by the filters above it: every payload is decoded once
    return wanted.withColumn("html", F.explode(F.array(text)))


def _complete(pages: DataFrame) -> Column:
    return F.coalesce(F.col("is_complete"), F.lit(False)) if "is_complete" in pages.columns else F.lit(True)


def _is_usable(pages: DataFrame) -> Column:
    return F.coalesce(_complete(pages) & (F.length("html") > 0), F.lit(False))
