"""Lines of text files as a data source of its own, with their exact order.

Spark's text readers don't say which line of a file a row is.  Here a file is cut into parts of a given size, also a gzipped
one if it was written as several members (as concatenated or block-wise compressed files are), and a row is named by file,
start of its part and number in the part, whatever task reads it and however often.  A line belongs to the part in which the
byte before it lies; so a reader skips to the first line break, but at the start of a file, and reads on to the end of the line
that it began."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, start long, line long, value string"
#: The first bytes of a member: a fixed value of the format.
MEMBER = b"\x1f\x8b\x08"
CHUNK, BATCH = 1 << 20, 4 << 20


def _opened(path: str) -> tuple[files.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return (files.LocalFileSystem(), path) if "://" not in path else files.FileSystem.from_uri(path)


@dataclass
class Part(InputPartition):
    file: str
    start: int
    stop: int


def _plain(source: BinaryIO, start: int, stop: int) -> Iterator[tuple[bytes, bool]]:
    """(bytes from start on, whether they lie before stop)."""
    source.seek(start)
    at = start
    while data := source.read(min(CHUNK, stop - at) if at < stop else CHUNK):
        yield data, at < stop
        at += len(data)


def _is_member(data: bytes, at: int) -> bool:
    """Whether a member begins here: the same bytes can stand inside compressed data, which then don't unpack."""
    try:
        return data[at + 3] < 32 and len(zlib.decompressobj(31).decompress(data[at : at + 8192], 1 << 16)) >= 0
    except (zlib.error, IndexError):
        return False


def _first_member(source: BinaryIO, start: int, stop: int) -> int | None:
    """The start of the first member in [start, stop), read piece by piece."""
    ahead = 16_384
    for at in range(start, stop, CHUNK):
        source.seek(at)
        data = source.read(min(CHUNK, stop - at) + ahead)
        found = data.find(MEMBER)
        while 0 <= found < min(CHUNK, stop - at):
            if _is_member(data, found):
                return at + found
            found = data.find(MEMBER, found + 1)
    return None


def _unpacked(source: BinaryIO, start: int, stop: int) -> Iterator[tuple[bytes, bool]]:
    """The unpacked bytes from the first member in the range on, and whether their member begins before stop."""
    at = 0 if start == 0 else _first_member(source, start, stop)
    if at is None:
        return
    source.seek(at)
    member, own, unread = zlib.decompressobj(31), True, b""
    while True:
        data = unread or source.read(CHUNK)
        out = member.decompress(data, CHUNK) if data else member.flush()
        unread = member.unconsumed_tail
        if out:
            yield out, own
        if member.eof:
            unread = member.unused_data or source.read(CHUNK)
            if not unread:
                return
            begins = source.tell() - len(unread)
            member, own = zlib.decompressobj(31), begins < stop
        elif not data:
            raise EOFError("a gzipped file ends within a member")


def _lines(source: Iterator[tuple[bytes, bool]], skip: bool) -> Iterator[bytes]:
    """Lines of which the byte before lies in the own part; skip: the first one belongs to the part before."""
    rest = b""
    for data, own in source:
        if not own:
            # the line that was begun, or that begins with the next part, ends at the first break
            line, broken, _ = data.partition(b"\n")
            rest += line
            if broken:
                if not skip:
                    yield rest
                return
            continue
        *pieces, rest = (rest + data).split(b"\n")
        for line in pieces:
            if skip:
                skip = False
            else:
                yield line
    if rest and not skip:
        yield rest


class LineReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Part]:
        out = []
        system, root = _opened(self.path)
        found = system.get_file_info(root)
        if found.type == files.FileType.NotFound:
            raise FileNotFoundError(self.path)
        entries = [found] if found.is_file else system.get_file_info(files.FileSelector(root, recursive=True))
        for entry in sorted(entries, key=lambda e: e.path):
            if entry.is_file and not entry.base_name.startswith(("_", ".")):
                out += [Part(entry.path, k, min(entry.size, k + self.split)) for k in range(0, entry.size, self.split)]
        return out or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = _opened(self.path)
        numbers, values, size = [], [], 0

        def batch() -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays([pa.array([partition.file] * n, pa.string()), pa.array([partition.start] * n, pa.int64()), pa.array(numbers, pa.int64()), pa.array(values, pa.string())], ["file", "start", "line", "value"])

        with system.open_input_file(partition.file) as source:
            data = (_unpacked if partition.file.endswith(".gz") else _plain)(source, partition.start, partition.stop)
            for number, line in enumerate(_lines(data, partition.start > 0)):
                numbers.append(number)
                values.append(line.rstrip(b"\r").decode("utf-8", "replace"))
                size += len(line) + 16
                if size > BATCH:
                    yield batch()
                    numbers, values, size = [], [], 0
        if values:
            yield batch()


class LineSource(DataSource):
    """Options: path, a file or folder of any file system that Arrow opens, and split, the bytes of a part."""

    @classmethod
    def name(cls) -> str:
        return "fragmill_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:  # noqa: ANN001
        return LineReader(self.options["path"], int(self.options.get("split", 64 << 20)))


def read_lines(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """(file, start, line, value) of every line."""
    spark.dataSource.register(LineSource)
    return spark.read.format("fragmill_lines").option("path", path).option("split", split).load()


def line_order() -> Column:
    """Sorts lines by file, and in a file as they stand."""
    return F.struct("file", "start", "line")


def read_json_lines(spark: SparkSession, path: str, schema: str, order: str = "ordinal", split: int = 64 << 20) -> DataFrame:
    """JSON lines with a fixed schema, and their order; blank lines are left out, and a line that is no such object has null in every
    column."""
    rows = read_lines(spark, path, split).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), line_order().alias(order))
    return rows.select("r.*", order)


def numbered(lines: DataFrame) -> DataFrame:
    """lines with their number in the whole file (from 0) as number: the counts of parts, one row each, are added up."""
    parts = lines.groupBy("file", "start").agg(F.max("line").alias("last")).collect()
    before, starts = {}, []
    for file, start, last in sorted(parts):
        starts.append((file, start, before.get(file, 0)))
        before[file] = before.get(file, 0) + last + 1
    known = lines.sparkSession.createDataFrame(starts, "file string, start long, _before long")
    return lines.join(F.broadcast(known), ["file", "start"]).withColumn("number", F.col("_before") + F.col("line")).drop("_before")
