"""Token-id shards with a minimal perfect hash index.

A data set is a folder of shards in ascending document order. A shard is three
files: ``ids-NNNNN.bin`` holds nothing but the ids of its documents one after
the other (little-endian, unsigned, of 16 bits if the vocabulary fits and else
of 32), ``len-NNNNN.bin`` the number of ids of each (little-endian, 64 bits),
and ``idx-NNNNN.mph`` maps document keys to places: a minimal perfect hash gives
each distinct key a slot without storing the keys, the slot holds a fingerprint
(to reject absent keys), the offset, and the number of ids and rows of that key.
Documents are read by asking the index for their keys.

Shards hold at most about ``SHARD_BYTES`` of text. They are written by tasks,
each to a temporary name and then moved, so a repeated or speculative task
leaves one whole file. The folder is one that all executors share;
``pyarrow.fs`` opens it by its URI.

Defined results: null text is an empty text (only the end id); rows without a
key come first and are stored but have no index entry (they are found by
place); rows that repeat a key lie next to each other, ordered by a hash of the
text, and the index leads to the first of the run; an empty table gives no
shards; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

END_ID = 1
#: Text in a shard, at most about; and at least, as long as there are fewer shards than shuffle partitions.
SHARD_BYTES, LEAST_SHARD_BYTES = 64 << 20, 1 << 20
_MAGIC = b"EGXIDX02"
_GAMMA = 2.0
_LEVELS = 48
#: Pieces of text whose ids a worker remembers before it starts anew.
MEMORY = 1 << 21
#: Pieces the library is given at once.
AT_ONCE = 1 << 12


# ---------------------------------------------------------------- minimal perfect hash


def _level_slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (common.mix(keys + np.uint64((level * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Cascade of bit arrays: a key that is alone in its cell of a level stops there; its rank among set bits is its slot."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # boolean arrays
        self.ranks = []
        total = 0
        for bits in levels:
            self.ranks.append(total + np.cumsum(bits) - bits)
            total += int(bits.sum())
        self.n = total

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64."""
        levels, rest = [], keys
        while len(rest):
            if len(levels) == _LEVELS:
                raise ValueError("keys are not distinct")
            bits = max(8, int(_GAMMA * len(rest)))
            at = _level_slot(rest, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return PerfectHash(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for keys that were not built in."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = _level_slot(keys[rest], i, len(bits))
            here = bits[at]
            out[rest[here]] = self.ranks[i][at[here]]
            rest = rest[~here]
        return out

    def dump(self) -> bytes:
        parts = [struct.pack("<I", len(self.levels))]
        for bits in self.levels:
            parts += [struct.pack("<Q", len(bits)), np.packbits(bits).tobytes()]
        return b"".join(parts)

    @staticmethod
    def load(data: bytes, at: int) -> tuple[PerfectHash, int]:
        (n,) = struct.unpack_from("<I", data, at)
        at, levels = at + 4, []
        for _ in range(n):
            (bits,) = struct.unpack_from("<Q", data, at)
            size = -(-bits // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at + 8), count=bits).astype(bool))
            at += 8 + size
        return PerfectHash(levels), at


_SLOT = np.dtype([("print", "<u4"), ("rows", "<u4"), ("offset", "<u8"), ("ids", "<u8")])


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (common.mix(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)


class ShardIndex:
    """The index file of one shard."""

    def __init__(self, data: bytes):
        if data[:8] != _MAGIC:
            raise ValueError("not an index file")
        self.hash, at = PerfectHash.load(data, 8)
        self.table = np.frombuffer(data, _SLOT, self.hash.n, at)
        (self.width,) = struct.unpack_from("<I", data, at + self.hash.n * _SLOT.itemsize)

    @staticmethod
    def dump(keys: np.ndarray, keyed: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
        offsets = np.cumsum(lengths) - lengths
        own = np.flatnonzero(keyed)
        distinct, first, rows = np.unique(keys[own], return_index=True, return_counts=True)
        u = distinct.view(np.uint64)
        ph = PerfectHash.build(u)
        table = np.zeros(ph.n, _SLOT)
        if ph.n:
            at = ph.slots(u)
            table["print"][at], table["rows"][at] = _fingerprint(u), rows
            table["offset"][at] = offsets[own[first]]
            table["ids"][at] = np.add.reduceat(lengths[own], first) if len(first) else 0
        return b"".join([_MAGIC, ph.dump(), table.tobytes(), struct.pack("<I", width)])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, ids, rows) of keys; constant time for each."""
        u = np.ascontiguousarray(keys, np.int64).view(np.uint64)
        slot = self.hash.slots(u)
        found = slot >= 0
        slot = np.where(found, slot, 0)
        if not self.hash.n:
            return found, slot, slot, slot
        found &= self.table["print"][slot] == _fingerprint(u)
        return found, *[self.table[x][slot].astype(np.int64) for x in ("offset", "ids", "rows")]


# ---------------------------------------------------------------- encoding

_SPLIT_AT = np.zeros(256, bool)
_SPLIT_AT[[0x2E, 0x2C]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _spaced() -> bytes:
    to = list(range(256))
    for b in [0x20, *range(0x09, 0x0E)]:
        to[b] = 0x20
    return bytes(to)


_SPACES = _spaced()
#: Fixed value: the word pattern of tokenizers whose words hold no white space and end before a full stop or comma.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def takes_pieces(spec: dict) -> bool:
    """Whether a tokenizer (as its JSON) gives a text's ids as those of its pieces.

    So it is if it normalises character by character, drops white space, splits
    words by ``_WORDS``, and has no special token that a cut could divide.
    """
    normal = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = normal["normalizers"] if normal["type"] == "Sequence" else [normal]
    split = spec.get("pre_tokenizer") or {}
    first = split["pretokenizers"][0] if split.get("type") == "Sequence" else split
    words = first.get("type") == "Split" and first.get("pattern") == {"Regex": _WORDS} and first.get("behavior") == "Removed" and bool(first.get("invert"))
    whole = all(not any(c.isspace() or c in ".," for c in t["content"]) for t in spec.get("added_tokens") or [])
    plain = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in steps)
    return words and whole and plain


class Encoder:
    """Ids of whole texts by the tokenizers library.

    If the tokenizer never joins across ASCII white space, nor across the end of
    a run of ASCII letters or digits before a full stop or comma
    (``takes_pieces``), a text's ids are those of its pieces, and each distinct
    piece is encoded once. Any other tokenizer encodes the texts as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = takes_pieces(json.loads(self.tokenizer.to_str()))
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self._clear()

    def _clear(self) -> None:
        self.keys, self.starts, self.sizes, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        if len(self.keys) > MEMORY:
            self._clear()
        parts = []
        for i in range(0, len(pieces), AT_ONCE):  # the library's own results are far larger than the ids
            got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[i : i + AT_ONCE], add_special_tokens=False)]
            n = np.fromiter(map(len, got), np.int64, len(got))
            parts.append((n, np.fromiter((i for x in got for i in x), np.uint32, int(n.sum()))))
        sizes, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts = keys[order], np.concatenate([self.starts, starts])[order]
        self.sizes, self.ids = np.concatenate([self.sizes, sizes])[order], np.concatenate([self.ids, flat])

    def encode(self, col: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, each text's followed by ``end``, and ids per text."""
        if not self.by_piece:
            got = [[*e.ids, end] for e in self.tokenizer.encode_batch_fast([t or "" for t in col.to_pylist()], add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum())), sizes
        data, off = common.utf8(col)
        n, docs = len(data), len(off) - 1
        if not n:
            return np.full(docs, end, np.uint32), np.ones(docs, np.int64)
        raw = data.tobytes().translate(_SPACES)
        a = np.frombuffer(raw, np.uint8)
        w = a != 0x20
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        cut = np.zeros(n, bool)  # a piece begins here within a word
        cut[1:] = _SPLIT_AT[a[1:]] & _ALNUM[a[:-1]] & ~edge[1:n]
        start, stop = w.copy(), w.copy()
        start[1:] &= ~w[:-1] | edge[1:n] | cut[1:]
        stop[:-1] &= ~w[1:] | edge[1:n] | cut[1:]
        starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        p, inv = common._powers(n + 1)
        vals = common._BYTE[a]
        vals[~w] = 0
        keys = common.mix(np.add.reduceat(vals * p[:n], starts) * inv[starts]) if len(starts) else np.empty(0, np.uint64)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        for _ in range(2):
            at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
            new = np.flatnonzero(self.keys[at] != distinct) if len(self.keys) else np.arange(len(distinct))
            if not len(new):
                break
            if len(self.keys) > MEMORY:  # forgets: all of this block must be learnt
                self._clear()
                new = np.arange(len(distinct))
            self._learn(distinct[new], [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[new]])
        sizes = self.sizes[at][back] if len(distinct) else np.empty(0, np.int64)
        places = self.starts[at][back] if len(distinct) else sizes
        # the end id is one more piece after each text's pieces
        bounds = np.searchsorted(starts, off)
        per_doc = np.add.reduceat(np.append(sizes, 0), bounds[:-1]) if docs else np.empty(0, np.int64)
        per_doc = np.where(bounds[1:] > bounds[:-1], per_doc, 0)
        total = int(sizes.sum())
        reach = np.cumsum(sizes) - sizes
        flat = self.ids[np.repeat(places - reach, sizes) + np.arange(total)]
        out = np.full(total + docs, end, np.uint32)
        hole = np.zeros(total + docs, bool)
        hole[np.cumsum(per_doc + 1) - 1] = True
        out[~hole] = flat
        return out, per_doc + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- writing and reading


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file:" + uri)


def _place(store: fs.FileSystem, tmp: str, final: str) -> None:
    if store.get_file_info(final).type != fs.FileType.NotFound:
        store.delete_file(final)
    store.move(tmp, final)


def _shards(docs: DataFrame) -> int:
    """How many shards the text makes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // SHARD_BYTES), min(tasks, -(-size // LEAST_SHARD_BYTES)))


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END_ID) -> DataFrame:
    """Encode docs (doc_id, text) into shards in ``folder``; a row a shard: shard, rows, ids, unkeyed rows, lo, hi."""
    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common.trim()
        ctx = TaskContext.get()
        shard = ctx.partitionId()
        store, root = _store(folder)
        tmp = f"{root}/tmp-{shard:05d}-{ctx.taskAttemptId()}"
        enc = encoder(tokenizer)
        keys, keyed, lengths, out = [], [], [], None
        for batch in batches:
            for b in common.blocks(batch, "text"):
                out = out or store.open_output_stream(f"{tmp}.bin")
                ids, n = enc.encode(b.column(1), end)
                out.write(ids.astype(f"<u{enc.width}").tobytes())
                keyed.append(b.column(0).is_valid().to_numpy(zero_copy_only=False))
                keys.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                lengths.append(n)
        if out is None:
            return
        out.close()
        common.trim()
        k, has, n = np.concatenate(keys), np.concatenate(keyed), np.concatenate(lengths)
        for suffix, data in (("len", n.astype("<u8").tobytes()), ("mph", ShardIndex.dump(k, has, n, enc.width))):
            with store.open_output_stream(f"{tmp}.{suffix}") as f:
                f.write(data)
        _place(store, f"{tmp}.bin", f"{root}/ids-{shard:05d}.bin")
        _place(store, f"{tmp}.len", f"{root}/len-{shard:05d}.bin")
        _place(store, f"{tmp}.mph", f"{root}/idx-{shard:05d}.mph")
        lo, hi = (int(k[has].min()), int(k[has].max())) if has.any() else (None, None)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (shard, len(k), int(n.sum()), int((~has).sum()), lo, hi)], ["shard", "rows", "ids", "unkeyed", "lo", "hi"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    ordered = keyed.repartitionByRange(_shards(docs), F.col("doc_id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h")
    return common.save(ordered.select("doc_id", "text").mapInArrow(run, "shard long, rows long, ids long, unkeyed long, lo long, hi long"), f"{folder}/manifest")


class Shard:
    """The three files of a shard, opened."""

    def __init__(self, folder: str, shard: int):
        store, root = _store(folder)
        with store.open_input_stream(f"{root}/idx-{shard:05d}.mph") as f:
            self.index = ShardIndex(f.read())
        self.ids = store.open_input_file(f"{root}/ids-{shard:05d}.bin")
        self.len = store.open_input_file(f"{root}/len-{shard:05d}.bin")
        self._rows = None

    def rows(self, offset: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each of the ``times`` rows from a place on. Only rows that share a key, or have none, need them."""
        if self._rows is None:
            self.len.seek(0)
            n = np.frombuffer(self.len.read(), "<u8").astype(np.int64)
            self._rows = np.cumsum(n) - n, n
        place, n = self._rows
        at = np.repeat(np.searchsorted(place, offset), times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return place[at], n[at]

    def read(self, offset: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
        """The ids at ascending places; those that lie close are read at once."""
        a = 0
        while a < len(offset):
            b = min(len(offset), a + 4096)
            while b > a + 1 and offset[b - 1] + ids[b - 1] - offset[a] > 2 * ids[a:b].sum() + 4096:
                b = (a + b) // 2
            self.ids.seek(int(offset[a]) * self.index.width)
            data = np.frombuffer(self.ids.read(int(offset[b - 1] + ids[b - 1] - offset[a]) * self.index.width), f"<u{self.index.width}")
            for o, n in zip((offset[a:b] - offset[a]).tolist(), ids[a:b].tolist(), strict=True):
                yield data[o : o + n]
            a = b


def _asked(spark: SparkSession, manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """(shard, doc_id): the shards whose key bounds hold each distinct key; rows of one key may lie in several."""
    bounds = manifest.where("lo is not null").orderBy("shard").select("shard", "lo", "hi").collect()  # one row a shard
    shard, lo, hi = (np.array([r[i] for r in bounds], np.int64) for i in range(3))

    def run(batches):
        for b in batches:
            k = b.column(0).to_numpy()
            first, last = np.searchsorted(hi, k, "left"), np.searchsorted(lo, k, "right")
            many = np.maximum(last - first, 0)
            at = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(np.repeat(k, many))], ["shard", "doc_id"])

    keys = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    asked = keys.mapInArrow(run, "shard long, doc_id long")
    tasks = max(len(bounds), 1)
    return asked.repartition(tasks, "shard").sortWithinPartitions("shard", "doc_id")


def _runs(batches) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, keys) of batches sorted by shard."""
    for batch in batches:
        shards, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero(np.diff(shards)) + 1
        for own, s in zip(np.split(docs, cut), shards[np.concatenate([[0], cut]).astype(int)].tolist() if len(shards) else [], strict=False):
            yield s, own


def read(spark: SparkSession, folder: str, manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents of ``keys`` (doc_id, asked once each) from the files: doc_id, start, n_tokens, ids_crc32.

    Every row of a key is given. If a null is among the keys, so are all rows
    without one.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = {r.shard: r.before for r in manifest.select("shard", before.alias("before")).collect()}  # one row a shard
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def rows(shard: int, opened: Shard, docs: np.ndarray, keyed: bool, offset: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in opened.read(offset, ids)]
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=np.full(len(docs), not keyed)), pa.array(starts[shard] + offset, pa.int64()), pa.array(ids), pa.array(crc, pa.int64())], names)

    def run(batches):
        held = None
        for shard, own in _runs(batches):
            if held is None or held[0] != shard:
                held = shard, Shard(folder, shard)
            found, offset, ids, times = held[1].index.find(own)
            own, offset, ids, times = own[found], offset[found], ids[found], times[found]
            if (times > 1).any():
                own, (offset, ids) = np.repeat(own, times), held[1].rows(offset, times)
            yield rows(shard, held[1], own, True, offset, ids)

    def unkeyed(batches):
        for batch in batches:
            for shard, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                opened = Shard(folder, shard)
                offset, ids = opened.rows(np.array([0]), np.array([n]))
                yield rows(shard, opened, np.zeros(n, np.int64), False, offset, ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    out = _asked(spark, manifest, keys).mapInArrow(run, schema)
    bare = manifest.where("unkeyed > 0").select("shard", "unkeyed")
    return out.union(bare.join(keys.where("doc_id is null").select(F.lit(1).alias("_any")).limit(1), how="left_semi").mapInArrow(unkeyed, schema))


def lookup(spark: SparkSession, folder: str, manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """ids (array<long>, all rows of the key) for each distinct doc_id of ``wanted`` that the data set holds."""

    def run(batches):
        held = None
        for shard, own in _runs(batches):
            if held is None or held[0] != shard:
                held = shard, Shard(folder, shard)
            found, offset, ids, _ = held[1].index.find(own)
            got = [x.astype(np.int64) for x in held[1].read(offset[found], ids[found])]
            yield pa.RecordBatch.from_arrays([pa.array(own[found], pa.int64()), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _asked(spark, manifest, wanted).mapInArrow(run, "doc_id long, ids array<long>")
