"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are all 13-word windows of the benchmark's items; an item of fewer
words is one shorter window. Per window length there is one search machine:
a block shift table says how far a position can be skipped, buckets of windows
that share their last block select the test strings to try, and a direct
comparison of the words themselves confirms each occurrence. All documents of a
block of text are searched in step, so the tables are probed with whole numpy
vectors.

The machine is broadcast. Its size is bounded: distinct items are dealt into
parts of at most about ``part_bytes`` of text. Every part is a pass over the rows
of its own, saved before the next, so one machine is in memory at a time (no
shuffle). The tables have as many slots as the part's windows need.

Defined results: null texts and texts without words have no hits and are clean;
items without words are no test strings; an item without an id marks words but
is not listed; repeated items count once; repeated documents each get a row; an
empty benchmark leaves everything clean; other columns are ignored. When tables
are built, windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Slots a table has for each distinct block, and the bounds of its size (as powers of two).
_ROOM = 8
_LEAST_BITS, _MOST_BITS = 12, 24
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _block(h: np.ndarray, at: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Table slot of the block of ``width`` words that ends at each position."""
    v = h[at] * _M1
    if width == 2:
        v = v ^ (h[at - 1] * _M2)
    return (common.mix(v) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Machine:
    """Wu-Manber tables for windows of one length over the words ``w`` of the items."""

    w: common.Words
    length: int
    width: int  # words in a block
    bits: int
    shift: np.ndarray  # slot -> words to skip
    at: np.ndarray  # first word of each distinct window, ordered by the slot of its last block
    last: np.ndarray  # those slots
    heads: np.ndarray  # window -> first entry of ``items``
    items: np.ndarray  # item numbers

    @staticmethod
    def build(w: common.Words, length: int, at: np.ndarray, item: np.ndarray) -> Machine:
        """Windows of ``length`` words that begin at words ``at``, of items ``item`` (-1: not listed)."""
        width = min(2, length)
        powers = np.array([pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) for j in range(length)], np.uint64)
        key = common.mix((w.hashes[at[:, None] + np.arange(length)] * powers).sum(1, dtype=np.uint64))
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        at = at[first]
        bits = int(np.clip(np.ceil(np.log2(_ROOM * len(at) + 1)), _LEAST_BITS, _MOST_BITS))
        shift = np.full(1 << bits, length - width + 1, np.uint8 if length < 256 else np.int64)
        for j in range(width - 1, length):
            np.minimum.at(shift, _block(w.hashes, at + j, width, bits), length - 1 - j)
        last = _block(w.hashes, at + length - 1, width, bits)
        order = np.argsort(last, kind="stable")
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        named = item >= 0
        pairs = np.unique(np.column_stack([place[back[named]], item[named]]), axis=0) if named.any() else np.empty((0, 2), np.int64)
        return Machine(w, length, width, bits, shift, at[order], last[order], np.searchsorted(pairs[:, 0], np.arange(len(at) + 1)), pairs[:, 1])

    def items_of(self, window: int) -> list[int]:
        return self.items[self.heads[window] : self.heads[window + 1]].tolist()

    def search(self, w: common.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence in a block of texts."""
        h, m = w.hashes, self.length
        lo, hi = w.docs[:-1], w.docs[1:]
        # long documents are searched from several starting points at once
        step = 256
        pieces = np.maximum(0, -(-(hi - lo - m + 1) // step))
        doc = np.repeat(np.arange(len(lo)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = lo[doc] + nth * step + m - 1
        stop = np.minimum(lo[doc] + (nth + 1) * step + m - 1, hi[doc])
        found_at, found_window = [], []
        while len(at):
            slot = _block(h, at, self.width, self.bits)
            skip = self.shift[slot].astype(np.int64)
            hit = np.flatnonzero(skip == 0)
            if len(hit):
                head = np.searchsorted(self.last, slot[hit], "left")
                many = np.searchsorted(self.last, slot[hit], "right") - head
                ends = np.repeat(at[hit], many)
                window = np.repeat(head, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                same = h[ends - m + 1] == self.w.hashes[self.at[window]]
                for e, p in zip(ends[same].tolist(), window[same].tolist(), strict=True):
                    a = self.at[p]
                    if w.norm[w.starts[e - m + 1] : w.ends[e]].split() == self.w.norm[self.w.starts[a] : self.w.ends[a + m - 1]].split():
                        found_at.append(e - m + 1)
                        found_window.append(p)
            at = at + np.maximum(skip, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.array(found_at, np.int64), np.array(found_window, np.int64)


def machines(item_ids: list, texts: list[str | None], window: int = WINDOW) -> tuple[list, list[Machine]]:
    """Item ids by number, and a machine for each length of window."""
    w = common.words(pa.array(texts, pa.large_string()), common.ALNUM)
    ids = sorted({i for i in item_ids if i is not None}, key=str)
    number = {x: i for i, x in enumerate(ids)}
    item = np.array([number.get(i, -1) for i in item_ids], np.int64)
    n = np.diff(w.docs)
    length = np.minimum(n, window)
    out = []
    for m in np.unique(length[length > 0]).tolist():
        own = np.flatnonzero(length == m)
        many = n[own] - m + 1
        at = np.repeat(w.docs[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out.append(Machine.build(w, m, at, np.repeat(item[own], many)))
    return ids, out


_OUT = "n_words long, hit_words array<int>, items array<string>"


def _search(rows: DataFrame, carried: str, ids: list, built: list[Machine], again: bool) -> DataFrame:
    """One pass: add the words hit and the items found to what earlier passes found."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, built))
    names = rows.drop("n_words", "hit_words", "items").columns

    def run(batches):
        ids, built = shared.value
        for batch in batches:
            for b in common.blocks(batch, "text"):
                w = common.words(b.column(b.schema.get_field_index("text")), common.ALNUM)
                n = np.diff(w.docs)
                hit = np.zeros(len(w.starts) + 1, np.int64)
                found: dict[int, set] = {}
                for m in built:
                    at, window = m.search(w)
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + m.length, -1)
                    for d, p in zip((np.searchsorted(w.docs, at, "right") - 1).tolist(), window.tolist(), strict=True):
                        found.setdefault(d, set()).update(m.items_of(p))
                marks = np.flatnonzero(np.cumsum(hit[:-1]) > 0) if found or hit.any() else np.empty(0, np.int64)
                cut = np.searchsorted(marks, w.docs)
                words_hit = [marks[cut[i] : cut[i + 1]] - w.docs[i] for i in range(b.num_rows)]
                items = [sorted(str(ids[x]) for x in found.get(i, ())) for i in range(b.num_rows)]
                if again:
                    old = b.column(b.schema.get_field_index("hit_words")).to_pylist()
                    words_hit = [np.union1d(x, y) for x, y in zip(words_hit, old, strict=True)]
                    items = [sorted({*x, *y}) for x, y in zip(items, b.column(b.schema.get_field_index("items")).to_pylist(), strict=True)]
                cols = [b.column(b.schema.get_field_index(x)) for x in names]
                cols += [pa.array(n, pa.int64()), pa.array([x.astype(np.int32) for x in words_hit], pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, [*names, "n_words", "hit_words", "items"])

    return rows.mapInArrow(run, f"{carried}, {_OUT}")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, part_bytes: int = 8 << 20) -> DataFrame:
    """Columns of docs with n_words, hit_words (places of words in occurrences) and items found."""
    spark = docs.sparkSession
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    own = items.select("item_id", "text").where("text is not null").distinct()
    parts = int((own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes) + 1
    if parts > 1:
        folder = common.shared_dir(spark)
        own = common.save(own.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), f"{folder}/items")
    out = docs
    for part in range(parts):
        rows = (own if parts == 1 else own.where(F.col("part") == part).drop("part")).collect()  # at most about part_bytes of text
        ids, built = machines([r[0] for r in rows], [r[1] for r in rows], window)
        out = _search(out, carried, ids, built, part > 0)
        if part + 1 < parts:
            out = common.save(out, f"{folder}/pass{part}")
            if part:
                common.drop(spark, f"{folder}/pass{part - 1}")
    return out


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 5, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document.

    A document is contaminated if at least ``percent`` of its words lie within
    occurrences of benchmark windows (and one does).
    """
    found = occurrences(docs.select("doc_id", "text"), items, **how)
    hits = F.size("hit_words").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        ((hits > 0) & (100 * hits >= percent * F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, percent: int = 5, **how) -> DataFrame:
    """The rows of docs that are not contaminated, columns unchanged."""
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    found = occurrences(plain, items, **how)
    hits = F.size("hit_words")
    keep = ~((hits > 0) & (100 * hits >= percent * F.col("n_words")))
    return found.where(keep).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def digest(item_ids: list) -> str:
    """The digest of a list of items, as ``decontaminate`` gives it."""
    return hashlib.sha256(",".join(sorted(map(str, item_ids))).encode()).hexdigest()
