"""Logs as a data source: the last lines read from the end, and a stream by byte offsets that goes on over rotation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window as W

from .scratch import ship

SCHEMA = "line string, at long"
BLOCK = 65_536  #: bytes read at once
RANGE = 32_000_000  #: bytes of a task of the stream
MARK = 256  #: bytes at the start and before an offset that tell one file from another
ROTATED = ".prev"  #: what a rotated log's name ends in (fixed value)


def opened(path: str):
    """A file that can be read at any place, on any file system that Arrow knows."""
    system, plain = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(plain)


def _opened(path: str):
    """The same, or none if it isn't there."""
    try:
        return opened(path)
    except FileNotFoundError:
        return None


def _bytes(f, a: int, b: int) -> bytes:
    return f.read_at(b - a, a) if b > a else b""


def _batch(rows: list[tuple[bytes, int]]) -> pa.RecordBatch:
    lines = [x[:-1] if x.endswith(b"\r") else x for x, _ in rows]
    return pa.record_batch([pa.array([x.decode("utf-8", "replace") for x in lines], pa.string()), pa.array([a for _, a in rows], pa.int64())], names=["line", "at"])


def last_lines(f, n: int, keep_empty: bool = False, block: int = BLOCK) -> list[tuple[bytes, int]]:
    """The last n lines of an open file in order, each with its first byte's place. Blocks are read from the end till there are n."""
    end, size = f.size(), f.size()
    out: list[tuple[bytes, int]] = []
    parts: list[bytes] = []  # of the line that begins before ``end``, last part first
    ended = True  # what follows the last newline is a line only if it has bytes
    while end > 0 and len(out) < n:
        start = max(0, end - block)
        pieces = _bytes(f, start, end).split(b"\n")
        at = end
        for piece in reversed(pieces[1:]):
            at -= len(piece)
            line = b"".join([piece, *reversed(parts)])
            parts = []
            if not (ended and not line) and (line.rstrip(b"\r") or keep_empty):
                out.append((line, at))
            ended = False
            at -= 1
            if len(out) == n:
                return out[::-1]
        parts.append(pieces[0])
        end = start
    line = b"".join(reversed(parts))
    if len(out) < n and size and not (ended and not line) and (line.rstrip(b"\r") or keep_empty):
        out.append((line, 0))
    return out[::-1]


def lines_from(f, a: int, b: int, first: int = 0, block: int = 1 << 20) -> Iterator[tuple[bytes, int]]:
    """Lines whose first byte lies in [a, b), each with its place; lines begin at ``first`` and after each newline. Holds a block and one line."""
    size, at, skip = f.size(), a, a > first
    if skip:
        at -= 1  # a newline just before a begins a line at a
    parts: list[bytes] = []
    begin = at
    while at < size and (begin < b or skip):
        pieces = _bytes(f, at, min(size, at + block)).split(b"\n")
        here = at
        for piece in pieces[:-1]:
            here += len(piece) + 1
            if not skip and begin < b:
                yield b"".join([*parts, piece]), begin
            skip, parts, begin = False, [], here
            if begin >= b:
                return
        parts.append(pieces[-1])
        at += sum(map(len, pieces)) + len(pieces) - 1
    if not skip and begin < b and begin < size:
        yield b"".join(parts), begin


def ended_at(f, block: int = BLOCK) -> int:
    """Where the last whole line ends: a line without its newline is still being written."""
    end = f.size()
    while end > 0:
        start = max(0, end - block)
        cut = _bytes(f, start, end).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        end = start
    return 0


def mark(f, at: int) -> int:
    """A checksum of the bytes at the start and before ``at``."""
    return zlib.crc32(_bytes(f, max(0, at - MARK), at), zlib.crc32(_bytes(f, 0, min(MARK, at))))


def _state(path: str) -> dict | None:
    f = _opened(path)
    if f is None:
        return None
    with f:
        at = ended_at(f)
        return {"at": at, "mark": mark(f, at)}


def _is(path: str, state: dict) -> bool:
    f = _opened(path)
    if f is None:
        return False
    with f:
        return f.size() >= state["at"] and mark(f, state["at"]) == state["mark"]


def _found(path: str, state: dict, loss: bool = True) -> str | None:
    for p in (path, path + ROTATED):
        if _is(p, state):
            return p
    if not loss:
        return None
    raise ValueError(f"{path} was rotated away or cut before its lines up to byte {state['at']} were read")


@dataclass
class _Range(InputPartition):
    state: dict  # tells the file, whatever its name is by now
    a: int
    b: int


class _Stream(DataSourceStreamReader):
    """An offset says where the log and the rotated one end, with marks; it is made of the files only, so a restart needs nothing else."""

    def __init__(self, options: dict):
        self.path, self.range, self.loss = options["path"], int(options.get("rangeBytes", RANGE)), options.get("failOnDataLoss", "true") == "true"
        self.first = options.get("startingOffsets", "earliest") == "earliest"

    def initialOffset(self) -> dict:
        now = self.latestOffset()
        return {"log": {"at": 0, "mark": 0}, "rotated": now["rotated"]} if self.first else now

    def latestOffset(self) -> dict:
        return {"log": _state(self.path) or {"at": 0, "mark": 0}, "rotated": _state(self.path + ROTATED)}

    def segments(self, start: dict, end: dict) -> list[tuple[dict, int]]:
        """(file's state, first byte) of what is new between two offsets: each is read up to the state's place."""
        was, old, now, prev = start["log"], start["rotated"], end["log"], end["rotated"]
        if prev == old:  # not rotated: the log has grown, or was cut and begun again
            file = _found(self.path, now, self.loss)
            same = file is not None and now["at"] >= was["at"] and _is(file, was)
            return [(now, was["at"] if same else 0)]
        file = _found(self.path, prev, self.loss) if prev else None
        if file and old and old["at"] and prev["at"] >= old["at"] and _is(file, old):  # its writer went on after it was renamed
            return [(prev, old["at"]), *self.segments({"log": was, "rotated": prev}, end)]
        if file and prev["at"] >= was["at"] and _is(file, was):
            return [(prev, was["at"]), (now, 0)]
        if self.loss:
            raise ValueError(f"{self.path} was rotated twice, or its rotated file removed, before its lines after byte {was['at']} were read")
        return [*([(prev, 0)] if prev else []), (now, 0)]

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        if start == end:  # asked at a restart, when the files may be others
            return []
        there = [(s, first) for s, first in self.segments(start, end) if first < s["at"] and _found(self.path, s, self.loss)]
        return [_Range(s, a, min(a + self.range, s["at"])) for s, first in there for a in range(first, s["at"], self.range)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int]] = []
        held = 0
        with _opened(_found(self.path, partition.state)) as f:
            for line, at in lines_from(f, partition.a, partition.b):
                if line.rstrip(b"\r"):
                    rows.append((line, at))
                    held += len(line)
                if len(rows) == 1000 or held > 4_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


class _Tail(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.n, self.empty = options["path"], int(options.get("last", 8)), options.get("keepEmpty", "false") == "true"

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        f = _opened(self.path)
        if f is not None:
            with f:
                yield _batch(last_lines(f, self.n, self.empty))


class LogLines(DataSource):
    """Format ``log_lines``: read, the ``last`` lines of a log; streamed, all its lines as they come. Columns: line, at (place of its first byte)."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Tail(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(LogLines)


def tail(spark: SparkSession, path: str, n: int = 8, keep_empty: bool = False) -> DataFrame:
    """The last n lines of a log in order: (nth, line) with nth from 1. A file that isn't there has none.

    Lines end in a newline, also one with a carriage return; the last may lack it. What is read is a few blocks from the end,
    however long the log is: lines that are empty are passed over unless ``keep_empty``. Bytes that aren't UTF-8 become a replacement mark.
    """
    register(spark)
    rows = spark.read.format("log_lines").option("path", path).option("last", n).option("keepEmpty", str(keep_empty).lower()).load()
    return rows.select(F.row_number().over(W.partitionBy(F.lit(0)).orderBy("at")).alias("nth"), "line")  # n rows


def followed(spark: SparkSession, path: str, from_start: bool = True, fail_on_loss: bool = True) -> DataFrame:
    """Stream (line, at) of a log: each whole line that isn't empty once, over rotation to ``.prev`` and over restarts.

    A batch is cut into ranges of bytes, so a long backlog is many tasks. A rotated file is told by its bytes, not by its name: what was
    not yet read of it comes before the new log's lines. A log that was cut is read from its start again. Lines that no file holds
    any more (rotated twice between two batches) stop the stream unless ``fail_on_loss`` is off. A last line without a newline waits.
    """
    register(spark)
    reader = spark.readStream.format("log_lines").option("path", path).option("failOnDataLoss", str(fail_on_loss).lower())
    return reader.option("startingOffsets", "earliest" if from_start else "latest").load()
