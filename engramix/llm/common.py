"""Shared plumbing: scratch tables, word kernels over Arrow buffers, block sums.

The word kernels work on whole Arrow string buffers with numpy, so no Python
string is made per row or per word.
"""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- scratch


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share.

    It lies under ``spark.checkpoint.dir`` of the session; only where that is
    unset (single-machine tests) a folder under /tmp is set and used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/engramix-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> DataFrame:
    """Write a frame as Parquet and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def trim() -> None:
    """Give memory that a task has freed back to the machine; its Python worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


# ---------------------------------------------------------------- word kernels


def _table(separators: Iterable[int]) -> bytes:
    """A byte map that lower-cases A-Z and turns every separator into a space."""
    to = list(range(256))
    for b in range(0x41, 0x5B):
        to[b] = b + 0x20
    for b in separators:
        to[b] = 0x20
    return bytes(to)


#: Words are runs of anything but ASCII white space; A-Z in lower case.
SPACED = _table([0x20, *range(0x09, 0x0E)])
#: Words are runs of ASCII letters, digits and non-ASCII characters; A-Z in lower case.
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_RNG = np.random.Generator(np.random.PCG64(20240201))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[0x20] = 0
_P = 0x9E3779B97F4A7C15 | 3
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 1 << 21)
        for name, base in (("p", _P), ("i", _P_INV)):
            a = np.ones(size, np.uint64)
            filled = 1
            while filled < size:
                more = min(filled, size - filled)
                a[filled : filled + more] = a[:more] * np.uint64(pow(base, filled, 1 << 64))
                filled += more
            _POWERS[name] = a
    return _POWERS["p"], _POWERS["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the len+1 offsets into them; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    if not len(col) or col.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, (offsets - offsets[0]).astype(np.int64)


def blocks(batch: pa.RecordBatch, text: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``size`` bytes of text (one row at least)."""
    _, off = utf8(batch.column(batch.schema.get_field_index(text)))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield batch.slice(a, min(b, n) - a)
        a = b


@dataclass
class Words:
    """The words of a block of texts: byte ranges into ``norm``, hashes, and where each document's begin."""

    norm: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    docs: np.ndarray  # len(texts)+1 offsets into the words


def words(col: pa.Array, table: bytes = SPACED, hashed: bool = True) -> Words:
    """Find all words of a string column and hash them (64 bits)."""
    data, off = utf8(col)
    n = len(data)
    if not n:
        e = np.empty(0, np.int64)
        return Words(b"", e, e, np.empty(0, np.uint64), np.zeros(len(off), np.int64))
    norm = data.tobytes().translate(table)
    a = np.frombuffer(norm, np.uint8)
    w = a != 0x20
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1] | edge[1:n]
    end[:-1] &= ~w[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = np.empty(0, np.uint64)
    if hashed and len(starts):
        p, inv = _powers(n + 1)
        hashes = mix(np.add.reduceat(_BYTE[a] * p[:n], starts) * inv[starts])
    return Words(norm, starts, ends, hashes, np.searchsorted(starts, off))


# ---------------------------------------------------------------- sums of fixed-size count arrays

BLOCK_SCHEMA = "block int, counts binary"


def emit_blocks(counts: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """A task's dense counts as compressed blocks of 64-bit numbers; empty blocks are left out."""
    ids, blobs = [], []
    for i in range(0, len(counts), block):
        part = counts[i : i + block]
        if part.any():
            ids.append(i // block)
            blobs.append(zlib.compress(part.astype("<u8").tobytes(), 1))
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["block", "counts"])


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), "<u8")


def add_blocks(df: DataFrame) -> DataFrame:
    """Sum blocks of equal number. The array is of fixed size, so is the result.

    Each task holds one running sum a block number it is dealt; nothing is
    gathered per group first. Counts have 64 bits.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = unpack(blob.as_py())
                sums[i] = sums[i] + part if i in sums else part
        for i, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(s.astype("<u8").tobytes(), 1)], pa.binary())], ["block", "counts"])

    return df.repartition("block").mapInArrow(run, BLOCK_SCHEMA)


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def text_column(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name; a clash of other columns does no harm."""
    return docs.select(*[F.col(f"`{n}`") for n in names])
