"""Archived responses (WARC files) as a data source, in batch and as a stream.

A file is read in byte ranges, a task for each. A record belongs to the range in which it begins: a task goes to the
first record at or behind its start and reads on until a record begins behind its end. The classes travel to the
workers by value.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from silkgraph.sources.readers import FETCH_LOG

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the format.
VERSION = b"WARC/1."
BREAK = b"\r\n\r\n"
RANGE = 64 << 20
CHUNK, FIRST_CHUNK = 1 << 20, 1 << 16
# Small ranges are widened up to RANGE where files would give more tasks than this.
TASKS = 1000
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20

STEP = pa.struct([("url", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string()))])
ROWS = pa.schema([
    ("url", pa.string()), ("status", pa.int32()), ("final_url", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
    ("text", pa.string()), ("redirect_chain", pa.list_(STEP)), ("fetched_at", pa.timestamp("us", tz="UTC")), ("seq", pa.int64()),
])


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def opened(path: str):
    files, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return files, place


def listed(path: str) -> list[tuple[int, str, int]]:
    """(time of change in ns, path, size) of the files at or below a path, hidden ones left out."""
    files, place = opened(path)
    infos = files.get_file_info(fs.FileSelector(place, recursive=True)) if files.get_file_info(place).type == fs.FileType.Directory else [files.get_file_info(place)]
    head = path[: len(path) - len(place)] if path.endswith(place) else ""
    return sorted((i.mtime_ns, head + i.path, i.size) for i in infos if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))


def ranges(files: list[tuple[int, str, int]], size: int) -> list[Range]:
    """The byte ranges of the files, of ``size`` bytes; wider ones for files that have very many of them."""
    size = max(size, min(RANGE, -(-sum(whole for _, _, whole in files) // TASKS)))
    return [Range(path, low, min(low + size, whole)) for _, path, whole in files for low in range(0, whole, size)]


def fields_of(block: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the last of a name counts."""
    lines = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n"))
    return {name.strip().lower(): value.strip() for name, colon, value in lines if colon}


class Records:
    """Records of one open file."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size

    def bytes_at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(max(0, min(size, self.size - at)))

    def head(self, at: int) -> tuple[dict[str, str], int, int] | None:
        """Fields, first byte of the content and first byte behind it of the record at ``at``; None if none is there."""
        block, step = b"", 4096
        while BREAK not in block:
            more = self.bytes_at(at + len(block), step)
            if not more or (len(block) >= len(VERSION) and not block.startswith(VERSION)):
                return None
            block, step = block + more, step * 2
        block = block[: block.index(BREAK)]
        fields = fields_of(block)
        if not block.startswith(VERSION) or "warc-type" not in fields or not fields.get("content-length", "").isdigit():
            return None
        first = at + len(block) + len(BREAK)
        end = first + int(fields["content-length"])
        # behind the content stands a break, and then the next record or the end of the file
        behind = self.bytes_at(end, len(BREAK) + len(VERSION))
        whole = end <= self.size and behind.startswith(BREAK) and behind[len(BREAK) :] in (b"", VERSION)
        return (fields, first, end) if whole else None

    def first(self, at: int) -> int | None:
        """Where the first record at or behind ``at`` begins."""
        if at == 0 and self.head(0):
            return 0
        low, held, step = max(0, at - len(BREAK)), b"", FIRST_CHUNK
        mark = BREAK + VERSION
        while True:
            more = self.bytes_at(low + len(held), step)
            held, step = held + more, min(2 * step, CHUNK)
            place = held.find(mark)
            while place >= 0:
                start = low + place + len(BREAK)
                if self.head(start):
                    return start
                place = held.find(mark, place + 1)
            if not more:
                return None
            keep = held[-len(mark) + 1 :]
            low, held = low + len(held) - len(keep), keep


def response(fields: dict[str, str], content: bytes, at: int) -> tuple | None:
    """The row of a response record, or None for other records."""
    url = fields.get("warc-target-uri")
    if fields["warc-type"] != "response" or not url or not content.startswith(b"HTTP/"):
        return None
    head, _, body = content.partition(BREAK)
    line, _, rest = head.partition(b"\r\n")
    code = line.split()[1] if len(line.split()) > 1 else b""
    status = int(code) if code.isdigit() else 0
    headers = list({k: v for k, _, v in ((n.strip(), c, v.strip()) for n, c, v in (x.partition(":") for x in rest.decode("utf-8", "replace").split("\r\n"))) if k}.items())
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    charset = kind.lower().partition("charset=")[2].split(";")[0].strip().strip('"') or "utf-8"
    try:
        text = body.decode(charset, "ignore")
    except LookupError:
        text = body.decode("utf-8", "ignore")
    try:
        when = datetime.fromisoformat(fields.get("warc-date", "").replace("Z", "+00:00"))
        when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    except ValueError:
        when = None
    return url, status, url, headers, text, [{"url": url, "status": status, "headers": headers}], when, at


def rows_of(part: Range) -> Iterator[pa.RecordBatch]:
    files, place = opened(part.path)
    with files.open_input_file(place) as file:
        records = Records(file, file.size())
        at, held, size = records.first(part.start), [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ROWS, strict=True)], schema=ROWS)

        while at is not None and at < part.end:
            found = records.head(at)
            if found is None:  # a broken record: on to the next whole one
                at = records.first(at + 1)
                continue
            fields, first, end = found
            row = response(fields, records.bytes_at(first, end - first), at)
            if row:
                held.append(row)
                size += end - first
            if held and (len(held) == BATCH_ROWS or size > BATCH_BYTES):
                yield batch()
                held, size = [], 0
            at = end + len(BREAK) if end + len(BREAK) < records.size else None
        if held:
            yield batch()


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[Range]:
        return ranges(listed(self.path), self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows_of(partition)


class CaptureStream(DataSourceStreamReader):
    """New files by their time of change. An offset is the last time seen with the files of that time, so that
    files of one time that come one after the other are all read."""

    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE))

    def initialOffset(self) -> dict:
        return {"time": -1, "names": []}

    def latestOffset(self) -> dict:
        files = listed(self.path)
        last = max((t for t, _, _ in files), default=-1)
        return {"time": last, "names": [p for t, p, _ in files if t == last]}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        def past(t: int, p: str, offset: dict) -> bool:
            return t < offset["time"] or (t == offset["time"] and p in offset["names"])

        return ranges([f for f in listed(self.path) if past(f[0], f[1], end) and not past(f[0], f[1], start)], self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows_of(partition)

    def commit(self, end: dict) -> None:
        pass


class Captures(DataSource):
    """``spark.read.format("captures").load(path)``: the responses of uncompressed WARC files as fetch results.

    Option ``rangeBytes``: bytes of a task, more where that would be thousands of tasks. The path may be local to all machines or any that Arrow's file systems
    open. ``seq`` is the place of the record in its file. Records of other kinds, and broken or cut-off ones, give no row. A body
    that itself holds a whole record between the same breaks may be taken for one by a range that begins inside it.
    """

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return FETCH_LOG

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream(self.options)


def register_captures(spark: SparkSession) -> None:
    spark.dataSource.register(Captures)


def write_captures(fetches: DataFrame, path: str) -> None:
    """Fetch results (url, status, headers, text, fetched_at) as WARC files, one for each partition; built by columns."""
    lines = F.array_join(F.transform(F.map_entries("headers"), lambda h: F.concat(h["key"], F.lit(": "), h["value"])), "\r\n")
    content = F.concat(F.lit("HTTP/1.1 "), F.col("status").cast("string"), F.lit("\r\n"), lines, F.lit("\r\n\r\n"), F.coalesce("text", F.lit("")))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"\r\n{name}: "), value)

    date = F.date_format(F.to_utc_timestamp("fetched_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response"), field("WARC-Target-URI", F.col("url")), field("WARC-Date", date),
        field("Content-Type", F.lit("application/http; msgtype=response")), field("Content-Length", F.octet_length(content).cast("string")), F.lit("\r\n\r\n"), content,
    )
    fetches.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
