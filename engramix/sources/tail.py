"""A streaming source of lines appended to files.

The offset of the stream is a map of file to byte position, so a file may grow,
be truncated or be replaced while it is followed, and new files may appear below
a watched folder. Only whole lines are taken; what follows the last line break
waits. A file that became shorter, or whose first line is another one than
before, is read from its start again. Positions live in the checkpoint: a
restarted query goes on where it ended, and a repeated micro-batch reads the same
byte ranges.

A batch is cut into ranges of at most about ``maxPartitionBytes``; each task
seeks to its own and reads the lines that begin there.

Options: ``path`` (files and folders, separated by commas), ``suffix`` of files
in folders (default .jsonl), ``from`` (``start`` or ``end`` of the files that are
there when the query first starts), ``maxPartitionBytes``.

Defined results: blank lines are left out, a carriage return at a line's end too;
bytes that are no UTF-8 become replacement characters; missing paths are empty
until they appear; a file that is gone and comes back is read from its start; a
file that was rewritten to begin with the same line and is not shorter is taken as
grown.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import readers

#: What is read at once, and how much of a first line tells a file from another.
_CHUNK, _HEAD = 1 << 20, 4096
SCHEMA = "path string, at long, value string"


@dataclass
class Range(InputPartition):
    """Lines of ``path`` that begin at ``begin`` or later and before ``end``; ``first``: where the file's new lines begin."""

    path: str
    first: int
    begin: int
    end: int


def _open(path: str):
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store, inner


def _last_line_end(f, size: int) -> int:
    """Position after the last line break before ``size``; 0 if there is none."""
    end = size
    while end > 0:
        begin = max(0, end - _CHUNK)
        f.seek(begin)
        at = f.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return 0


def files(paths: list[str], suffix: str = ".jsonl") -> dict[str, int]:
    """Files at and below the paths, with their sizes."""
    out = {}
    for path in paths:
        store, inner = _open(path)
        scheme = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        info = store.get_file_info(inner)
        if info.type == fs.FileType.File:
            out[path] = info.size
        elif info.type == fs.FileType.Directory:
            for found in store.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)):
                if found.type == fs.FileType.File and found.path.endswith(suffix):
                    out[scheme + found.path] = found.size
    return out


def position(path: str, size: int) -> dict | None:
    """Where a file's whole lines end and a checksum of its first line; None while it has none."""
    store, inner = _open(path)
    try:
        with store.open_input_file(inner) as f:
            end = _last_line_end(f, min(size, f.size()))
            if not end:
                return None
            f.seek(0)
            return {"at": end, "head": zlib.crc32(f.read(min(end, _HEAD)).split(b"\n", 1)[0])}
    except FileNotFoundError:
        return None


def new_range(path: str, start: dict | None, end: dict) -> tuple[int, int]:
    """Bytes from where a file is read on to where it is read."""
    same = start is not None and start["head"] == end["head"] and start["at"] <= end["at"]
    return (start["at"] if same else 0), end["at"]


def lines(part: Range) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin within a range."""
    store, inner = _open(part.path)
    with store.open_input_file(inner) as f:
        at = part.begin
        if at > part.first:  # a line that began before belongs to the range before
            at -= 1
            f.seek(at)
            while True:
                chunk = f.read(_CHUNK)
                cut = chunk.find(b"\n")
                if cut >= 0 or not chunk:
                    at += cut + 1
                    break
                at += len(chunk)
        f.seek(at)
        rest = b""
        while at < part.end:
            chunk = f.read(_CHUNK)
            if not chunk:
                return
            *whole, rest = (rest + chunk).split(b"\n")
            for line in whole:
                if at >= part.end:
                    return
                yield at, line
                at += len(line) + 1


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(dict(self.options))


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.paths = [p.strip() for p in low["path"].split(",") if p.strip()]
        self.suffix = low.get("suffix", ".jsonl")
        self.from_end = low.get("from", "start") == "end"
        self.most = int(low.get("maxpartitionbytes", 128 << 20))

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.from_end else {}

    def latestOffset(self) -> dict:
        found = {path: position(path, size) for path, size in files(self.paths, self.suffix).items()}
        return {path: at for path, at in sorted(found.items()) if at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, to in end.items():
            first, last = new_range(path, start.get(path), to)
            out += [Range(path, first, begin, min(begin + self.most, last)) for begin in range(first, last, self.most)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str]] = []
        size = 0
        for at, line in lines(partition):
            line = line.removesuffix(b"\r")
            if line.strip():
                rows.append((at, line.decode(errors="replace")))
                size += len(line)
            if size >= _CHUNK:
                yield _batch(partition.path, rows)
                rows, size = [], 0
        if rows:
            yield _batch(partition.path, rows)


def _batch(path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["path", "at", "value"])


def follow(spark: SparkSession, paths: list[str], start: str = "start", **options: str) -> DataFrame:
    """Stream of (path, at, value): lines appended to files and to files below folders."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(path=",".join(paths), **{"from": start}, **options).load()


def follow_logs(spark: SparkSession, paths: list[str], start: str = "start", **options: str) -> DataFrame:
    """Stream of parsed entries of followed logs."""
    return readers.log_entries(follow(spark, paths, start, **options))
