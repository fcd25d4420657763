"""Text files of word vectors as a data source: lines by byte ranges, without header lines."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmill.plans.shipping import ship

RANGE = 64 << 20  # bytes a task reads
CHUNK = 1 << 20
HEADER = re.compile(rb"\d+ \d+\s*")
PACKED = (".gz", ".bz2", ".zst")  # these can only be read from their start


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), str(Path(path).absolute())


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files in a folder, or of those that a pattern names in one.

    Names that begin with a dot or an underscore are left out, as Spark does.
    """
    folder, _, pattern = path.rpartition("/")
    if not re.search(r"[*?\[]", pattern):
        folder, pattern = path, "*"
    system, place = located(folder)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    if info.type == fs.FileType.File:
        return [(folder, info.size)]
    found = system.get_file_info(fs.FileSelector(place))
    return sorted(
        (f"{folder.rstrip('/')}/{f.base_name}", f.size)
        for f in found
        if f.type == fs.FileType.File and f.base_name[0] not in "._" and fnmatch.fnmatchcase(f.base_name, pattern)
    )


class ByteRange(InputPartition):
    """The lines of a file that begin in ``[start, end)``."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def lines_in(part: ByteRange) -> Iterator[list[bytes]]:
    """The range's lines, some at a time; the first line of the file stays away if it is a header."""
    system, place = located(part.path)
    if place.endswith(PACKED):
        file, at = system.open_input_stream(place), 0
    else:
        file = system.open_input_file(place)
        at = max(part.start - 1, 0)
        file.seek(at)
    # a later range begins a byte early: what stands before the first break belongs to the range before
    rest, skip, first = b"", part.start > 0, part.start == 0
    with file:
        while at < part.end:
            chunk = file.read(CHUNK)
            lines = (rest + chunk).split(b"\n")
            rest = lines.pop() if chunk else b""
            kept = []
            for line in lines:
                begins, at = at, at + len(line) + 1
                if skip or begins >= part.end:
                    skip = False
                elif not (first and HEADER.fullmatch(line)):
                    kept.append(line)
                first = False
            if kept:
                yield kept
            if not chunk:
                return


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[ByteRange]:
        parts = []
        for path, size in listed(self.path):
            step = max(size, 1) if path.endswith(PACKED) else self.size
            end = (1 << 62) if path.endswith(PACKED) else None
            parts += [ByteRange(path, start, end or min(start + step, size)) for start in range(0, size, step)]
        return parts or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        for lines in lines_in(partition):
            texts = [line.decode("utf-8", "replace") for line in lines if line.strip()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])


class VectorLines(DataSource):
    """``value``: one line per vector."""

    @classmethod
    def name(cls) -> str:
        return "vector_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)


def vector_lines(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The lines of one file, of a folder's files, or of those a pattern names, but for their headers.

    A header is the *first* line of a file, if it is two whole numbers; the same line anywhere
    else is a word that happens to be a number. Each range of bytes is a task, so one large
    file is read by many; a compressed file is one task. Blank lines are left out.
    """
    ship(spark)
    spark.dataSource.register(VectorLines)
    return spark.read.format(VectorLines.name()).option("rangeBytes", range_bytes).load(path)
