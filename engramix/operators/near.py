"""Neighbours above a similarity, found without comparing pairs that cannot pass.

Vectors are dealt to cells by their nearest pivot. By the triangle inequality on
angles a pair within angle t has a cell in common only if the query is no further
from the cell's pivot than the cell reaches plus t, no nearer than it begins less
t, and no further than from its own nearest pivot plus 2 t. A query goes to the cells of
which all three hold, and to no other; the bounds are exact, so no neighbour is
lost. Cells next to each other share a shard and large cells are cut into several,
and the queries that have to look into a shard are dealt to blocks. A query is sent
once to each such shard, whatever the number of cells in it; a task holds one block
and one shard as matrices and multiplies, for each cell, the queries that go there.
Products are made in single precision and told from the k best so far with a margin
wider than its error; those that may be among them are computed again in double.

What this saves depends on the vectors: clusters are told apart, vectors without
direction lie in reach of all cells and all pairs are compared. ``work`` reports the
share. Rows sent are queries times shards and vectors times blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch

#: Pivots: vectors of least hash. A bounded sample.
PIVOTS = 128
#: Vectors of a shard and queries of a block, at most about, and numbers in them.
SHARD, BLOCK, NUMBERS = 65536, 32768, 1 << 22
#: Fewer rows are cut into so many shards and blocks, but for so few rows.
SIDES, LEAST = 6, 2048
#: Queries and vectors that are multiplied at once.
HEIGHT, WIDTH = 512, 4096
_PAIRS = "memory_id string, neighbour string, similarity double"


def _unit(col: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths at length one; zeros stay."""
    x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _near(x: np.ndarray, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, reach: float) -> np.ndarray:
    """Which cells (columns) hold a vector that can be within reach of each row."""
    if reach >= np.pi:
        return np.tile(np.isfinite(low), (len(x), 1))
    out = np.empty((len(x), len(pivots)), bool)
    for at in range(0, len(x), 4096):
        a = _angles(x[at : at + 4096], pivots)
        out[at : at + 4096] = np.isfinite(low) & (a <= high + reach) & (a >= low - reach) & (a - a.min(1, keepdims=True) <= 2 * reach)
    return out


def _spans(near: np.ndarray, cell: np.ndarray):
    """(first, end, rows): columns that the same rows look into, at most ``WIDTH`` at once; ``cell`` is each column's, ascending."""
    cells, first = np.unique(cell, return_index=True)
    ends = [*first[1:], len(cell)]
    at = 0
    while at < len(cells):
        to = at + 1
        while to < len(cells) and np.array_equal(near[:, cells[to]], near[:, cells[at]]):
            to += 1
        rows = np.flatnonzero(near[:, cells[at]])
        if len(rows):
            for low in range(first[at], ends[to - 1], WIDTH):
                yield low, min(low + WIDTH, ends[to - 1]), rows
        at = to


def _best(a: np.ndarray, b: np.ndarray, cell: np.ndarray, near: np.ndarray, rank: np.ndarray, own: np.ndarray, asked: np.ndarray, k: int, least: float, most: float):
    """(row of b, row of a, similarity): the k best of each row of b; equal ones by rank, and never of equal code (``own``, ``asked``)."""
    small, few = a.astype(np.float32), b.astype(np.float32)
    # twice the error of a product of unit vectors in single precision, and of rounding to six places
    slack = (a.shape[1] + 8) * 2.0**-23 + 1e-6
    piece = max(1, NUMBERS // max(1, a.shape[1]))
    for at in range(0, len(b), HEIGHT):
        n = min(HEIGHT, len(b) - at)
        floor = np.full(n, least - slack, np.float64)
        row, col, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        new, waiting = [], 0

        def settled(row, col, sim, new, floor):
            row, col, sim = (np.concatenate([x, *y]) for x, y in zip((row, col, sim), zip(*new, strict=True), strict=True))
            by = np.lexsort((rank[col], -sim, row))
            row, col, sim = row[by], col[by], sim[by]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            last = place == k - 1
            floor[row[last]] = sim[last] - slack
            return row[place < k], col[place < k], sim[place < k]

        for low, high, rows in _spans(near[at : at + n], cell):
            s = few[at + rows] @ small[low:high].T
            hits = np.flatnonzero(s >= floor[rows].astype(np.float32)[:, None])
            for i in range(0, len(hits), piece):
                r, c = np.divmod(hits[i : i + piece], high - low)
                r, c = rows[r], c + low
                v = np.round(np.einsum("ij,ij->i", b[at + r], a[c]), 6)
                keep = (v >= least) & (v <= most) & (own[c] != asked[at + r])
                new.append((r[keep], c[keep], v[keep]))
                waiting += int(keep.sum())
                if waiting >= n * k:
                    row, col, sim = settled(row, col, sim, new, floor)
                    new, waiting = [], 0
        if new:
            row, col, sim = settled(row, col, sim, new, floor)
        yield at + row, col, sim


class Cells:
    """Where vectors lie and queries go."""

    def __init__(self, vectors: DataFrame, least: float):
        """vectors: (memory_id, embedding)."""
        self.spark = vectors.sparkSession
        # wider than rounding of similarities to six places and of angles can matter
        self.reach = np.pi if least <= 0 else float(np.arccos(np.clip(least - 1e-6, -1.0, 1.0)) + 1e-6)
        usable = vectors.where("memory_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))").select("memory_id", F.col("embedding").cast("array<double>").alias("embedding"))
        self.folder = scratch.folder(self.spark)
        self.rows = scratch.save(usable, f"{self.folder}/rows")
        most = self.rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).limit(1).collect()
        self.size = most[0]["n"] if most else 0
        self.rows = self.rows.where(F.size("embedding") == self.size)
        sample = self.rows.orderBy(F.xxhash64("memory_id"), "memory_id").limit(PIVOTS).select("embedding").collect()  # PIVOTS rows
        x = np.array([r.embedding for r in sample], np.float64).reshape(len(sample), self.size)
        n = np.sqrt((x * x).sum(1, keepdims=True))
        self.pivots = np.divide(x, n, out=np.zeros_like(x), where=n > 0)[(n > 0).ravel()]
        if not len(self.pivots):
            self.pivots = np.eye(max(self.size, 1))[:1]
        self.homes = self._home()
        reach = self.homes.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).collect()  # PIVOTS rows
        k = len(self.pivots)
        self.low, self.high, self.count = np.full(k, np.inf), np.full(k, -np.inf), np.zeros(k, np.int64)
        for r in reach:
            self.low[r.cell], self.high[r.cell], self.count[r.cell] = r.low, r.high, r.n

    def _home(self) -> DataFrame:
        pivots = self.pivots

        def run(batches):
            for b in batches:
                if b.num_rows:
                    a = _angles(_unit(b.column(1)), pivots)
                    cell = a.argmin(1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(a[np.arange(len(a)), cell])], ["memory_id", "embedding", "cell", "angle"])

        return scratch.save(self.rows.mapInArrow(run, "memory_id string, embedding array<double>, cell int, angle double"), f"{self.folder}/homes")

    def shards(self, most: int) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
        """((cell, its first shard, its number of shards), cells of each shard): at most about ``most`` vectors a shard."""
        left, order = set(np.flatnonzero(self.count).tolist()), []
        while left:  # each next to the one before
            at = min(left) if not order else min(left, key=lambda c: (-float(self.pivots[order[-1]] @ self.pivots[c]), c))
            left.remove(at)
            order.append(at)
        dealt, parts, held = [], [], 0
        for c in order:
            n = int(self.count[c])
            if parts and held + n <= most:
                parts[-1].append(c)
                held += n
                dealt.append((c, len(parts) - 1, 1))
                continue
            cuts = -(-n // most)
            dealt.append((c, len(parts), cuts))
            parts += [[c] for _ in range(cuts)]
            held = n if cuts == 1 else most
        return dealt, parts

    def visits(self, queries: DataFrame, parts: list[list[int]]) -> DataFrame:
        """(memory_id, embedding, visits): the parts, lists of cells, that a query has to look into."""
        pivots, low, high, reach = self.pivots, self.low, self.high, self.reach

        def run(batches):
            for b in batches:
                near = _near(_unit(b.column(1)), pivots, low, high, reach)
                seen = np.stack([near[:, p].any(1) for p in parts], 1) if parts else np.zeros((len(near), 0), bool)
                ends = np.concatenate([[0], seen.sum(1).cumsum()]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(seen)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["memory_id", "embedding", "visits"])

        own = queries.where(F.size("embedding") == self.size).select("memory_id", F.col("embedding").cast("array<double>").alias("embedding"))
        return own.mapInArrow(run, "memory_id string, embedding array<double>, visits array<int>")


def _part(rows: int, most: int, size: int) -> int:
    """Rows of a shard or block."""
    return max(1, min(most, NUMBERS // max(1, size), max(LEAST, -(-rows // SIDES))))


def neighbours(embeddings: DataFrame, queries: DataFrame, k: int, least: float, most: float = 1.0) -> DataFrame:
    """(memory_id, neighbour, similarity, place): each query's k most similar other vectors within a band of cosines.

    ``queries`` is a stated set of any size. Ties go to the smaller id.
    Vectors that are null or empty, hold null or non-finite components or have
    another number of them than most take no part; a zero vector has similarity 0
    to all; an empty table gives an empty result.
    """
    cells = Cells(embeddings, least)
    spark = cells.spark
    vectors = int(cells.count.sum())
    dealt, parts = cells.shards(_part(vectors, SHARD, cells.size))
    asked = scratch.save(cells.visits(queries, parts), f"{cells.folder}/visits")
    sizes = {r.shard: r["count"] for r in asked.select(F.explode("visits").alias("shard")).groupBy("shard").count().collect()}  # a row a shard
    block = _part(max(sizes.values(), default=0), BLOCK, cells.size)
    plan = spark.createDataFrame([(s, -(-n // block)) for s, n in sizes.items()], "shard int, blocks int")
    where = spark.createDataFrame(dealt, "cell int, first int, cuts int")

    x = cells.homes.join(F.broadcast(where), "cell").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("memory_id"), F.col("cuts"))).cast("int"))
    x = x.join(F.broadcast(plan), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    q = asked.withColumn("shard", F.explode("visits")).join(F.broadcast(plan), "shard").withColumn("block", F.pmod(F.xxhash64("memory_id"), F.col("blocks")).cast("int"))
    keys = ["shard", "block"]
    pivots, low, high, reach = cells.pivots, cells.low, cells.high, cells.reach

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"memory_id": pa.array([], pa.string()), "neighbour": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})]
        if left.num_rows and right.num_rows:
            left = left.sort_by([("cell", "ascending"), ("memory_id", "ascending")]).combine_chunks()
            right = right.combine_chunks()
            ids, asks = (t.column("memory_id").combine_chunks() for t in (left, right))
            a, b = (_unit(t.column("embedding").combine_chunks()) for t in (left, right))
            near = _near(b, pivots, low, high, reach)
            home = np.full(len(b), -1) if reach >= np.pi else (b @ pivots.T).argmax(1)
            by = np.argsort(home, kind="stable")  # queries of a cell mostly look into the same ones
            b, near, asks = b[by], near[by], asks.take(pa.array(by))
            rank = np.empty(len(a), np.int64)
            rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(a))
            own, asked = (pc.fill_null(pc.index_in(i, value_set=ids), -1).to_numpy(zero_copy_only=False) for i in (ids, asks))
            for row, col, sim in _best(a, b, left.column("cell").to_numpy(), near, rank, own, asked, k, least, most):
                out.append(pa.table({"memory_id": asks.take(pa.array(row)), "neighbour": ids.take(pa.array(col)), "similarity": pa.array(sim + 0.0)}))
        return pa.concat_tables(out)

    found = x.select(*keys, "memory_id", "embedding", "cell").groupBy(*keys).cogroup(q.select(*keys, "memory_id", "embedding").groupBy(*keys)).applyInArrow(pairs, _PAIRS)
    place = F.row_number().over(Window.partitionBy("memory_id").orderBy(F.col("similarity").desc(), "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("memory_id", "neighbour", "similarity", "place")


def work(embeddings: DataFrame, queries: DataFrame, least: float) -> float:
    """Share of all pairs of a query and a vector that ``neighbours`` compares."""
    cells = Cells(embeddings, least)
    visits = cells.visits(queries, [[c] for c in range(len(cells.count))]).select(F.explode("visits").alias("cell")).groupBy("cell").count().collect()  # PIVOTS rows
    return sum(r["count"] * int(cells.count[r.cell]) for r in visits) / max(1, queries.count() * int(cells.count.sum()))
