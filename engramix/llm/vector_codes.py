"""Compression of vectors to codes of product codebooks, trained by exponion search.

A vector is cut into equal parts; each part is coded by the nearest entry of its
position's codebook. Training moves the entries to the floor of their parts'
mean, twice. All arithmetic is over integers, so results are exact.

Exponion search: a part starts at the entry it had before (at first: entry 0).
An entry as near as that one lies at most twice as far from it as the part does
(triangle inequality), so of the entry's neighbours, sorted by their distance,
only the leading ones within that radius are compared; a part whose radius holds
no neighbour keeps its entry unseen. In squares: a neighbour is compared if its
squared distance is at most four times the part's own. Equal distances go to the
lower index; such entries lie within the radius too.

In Spark: entries, at most parts x entries x width numbers, go to tasks; each
round maps the rows to new codes and saves them, and adds up counts and sums a
(part, entry) inside each task before anything is shuffled.

Defined results: vectors that are null, hold null or non-finite components or
components beyond 65536, or have another number of components than most take no
part; a number of components that is no multiple of the parts is filled up with
zeros; fewer rows than entries give that many entries; seeds are taken by vec_id,
then vector, rows without vec_id last; repeated rows are coded each; of errors
those of equal labels are summed, null labels together; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .intvec import integer_rows, matrix, of_usual_length

PARTS = 16
ENTRIES = 64
ROUNDS = 2
_BATCH = 4096


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every entry: the others by distance (ties by index), and those squared distances."""
    d = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    n = len(book)
    order = np.lexsort((np.broadcast_to(np.arange(n), (n, n)), d), axis=1)
    order = order[order != np.arange(n)[:, None]].reshape(n, n - 1)
    return order, np.take_along_axis(d, order, 1)


def exponion(parts: np.ndarray, book: np.ndarray, before: np.ndarray, near: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry and squared distance of every part, and how many entries were compared beyond the first."""
    order, far = near
    best = before.astype(np.int64)
    least = ((parts - book[best]) ** 2).sum(1)
    # how many neighbours of its entry lie within twice the part's distance; rows by entry, so each list is searched once
    by = np.argsort(best, kind="stable")
    ends = np.searchsorted(best[by], np.arange(len(book) + 1))
    within = np.zeros(len(parts), np.int64)
    for e in np.flatnonzero(np.diff(ends)).tolist():
        own = by[ends[e] : ends[e + 1]]
        within[own] = np.searchsorted(far[e], 4 * least[own], "right")
    start = best.copy()
    rows = np.argsort(-within, kind="stable")
    left = np.searchsorted(-within[rows], -np.arange(1, within.max(initial=0) + 1), "right")  # rows that reach each place of the lists
    for place, n in enumerate(left.tolist()):
        own = rows[:n]
        entry = order[start[own], place]
        d = ((parts[own] - book[entry]) ** 2).sum(1)
        wins = (d < least[own]) | ((d == least[own]) & (entry < best[own]))
        won = own[wins]
        best[won], least[won] = entry[wins], d[wins]
    return best, least, int(within.sum())


def _assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (vec_id, label, v, code) with new codes and ``error`` added."""
    near = [neighbours(b) for b in books]
    sent = rows.sparkSession.sparkContext.broadcast((books, near))  # parts x entries x (width + 2 x entries) numbers

    def run(batches):
        books, near = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                b = batch.slice(at, _BATCH)
                v, codes = _parts(b.column(2), books), matrix(b.column(3), np.uint8) if b.column(3).null_count == 0 else np.zeros((b.num_rows, len(books)), np.uint8)
                error = np.zeros(b.num_rows, np.int64)
                new = np.empty_like(codes)
                for p in range(len(books)):
                    new[:, p], d, _ = exponion(v[:, p], books[p], codes[:, p], near[p])
                    error += d
                code = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(books), pa.int32()), pa.array(new.ravel().astype(np.int16)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), code, pa.array(error)], ["vec_id", "label", "v", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("vec_id", "label", "v", "code").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>, code array<short>, error long")


def _parts(col: pa.Array, books: np.ndarray) -> np.ndarray:
    """Rows by parts by components, filled up with zeros."""
    v = matrix(col)
    short = books.shape[0] * books.shape[2] - v.shape[1]
    return np.pad(v, ((0, 0), (0, short))).reshape(len(v), books.shape[0], books.shape[2])


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries at the floor of the mean of the parts that have them; unused entries stay."""
    parts, entries, width = books.shape
    shape = np.empty_like(books)  # only its shape is used by tasks

    def run(batches):
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            if b.num_rows:
                v, codes = _parts(b.column(0), shape), matrix(b.column(1))
                for p in range(parts):
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(sums[p], codes[:, p], v[:, p])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(counts.ravel()[used]), pa.array(list(sums.reshape(-1, width)[used]), pa.list_(pa.int64()))],
            ["entry", "n", "sums"],
        )

    seen = rows.select("v", "code").mapInArrow(run, "entry int, n long, sums array<long>")
    total = seen.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    out = books.reshape(-1, width).copy()
    for r in total.collect():  # parts x entries rows at most
        out[r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out.reshape(books.shape)


def train(rows: DataFrame, folder: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Coded rows (vec_id, label, v, code, error) and the codebooks (parts, entries, width) of (vec_id, label, v)."""
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # ENTRIES rows
    first = np.array([r.v for r in seeds], np.int64)
    width = max(1, -(-first.shape[1] // parts))
    books = np.ascontiguousarray(np.pad(first, ((0, 0), (0, parts * width - first.shape[1]))).reshape(len(first), parts, width).transpose(1, 0, 2))
    coded = rows.withColumn("code", F.lit(None).cast("array<short>"))
    for i in range(rounds):
        last, coded = i, common.save(_assign(coded, books), f"{folder}/round{i}")
        books = _moved(coded, books)
        if last:
            common.drop(rows.sparkSession, f"{folder}/round{last - 1}")
    return common.save(_assign(coded, books), f"{folder}/coded"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(code: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The integer vectors that codes stand for."""
    return books[np.arange(len(books)), code].reshape(len(code), -1)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    folder = common.shared_dir(spark)
    usable, size = of_usual_length(common.save(integer_rows(vectors, F.col("vec_id"), F.col("label")), f"{folder}/integers"))
    if not size:
        none = F.lit(None)
        return usable.limit(0).select("vec_id", none.cast("string").alias("code"), none.cast("long").alias("error"), none.cast("long").alias("label_error"), none.cast("string").alias("codebooks_sha256"))
    coded, books = train(usable, folder, parts, entries, rounds)
    # a row a label: Spark broadcasts it if it is small, else splits hot labels of the join
    of = common.save(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), f"{folder}/labels")
    hexed = F.concat_ws("", F.transform("code", lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")))
    return coded.join(of, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
