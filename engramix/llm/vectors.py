"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by the order
of its ``posted`` nearest pivots and posted in the inverted files of those, and
only those, with the pivot's place in its order. A query opens the files of its
own ``reads`` nearest pivots and ranks what is posted there by footrule distance:
the sum over its pivots of how far the places lie apart, where a pivot that a
vector is not posted under counts as the place after the last. The nearest
candidates by that distance are ranked again by the exact measure.

The index is built once, in shards of at most about ``SHARD_ROWS`` distinct
vectors (dealt by hash, equal vectors are one entry), and saved in the shared
folder. Queries are saved in blocks. Every task searches one block in one shard
and gives only its own best; nothing but pivots and counts comes to the driver.

The measure is the inner product. Pivots order vectors by cosine after a
coordinate is added that brings all to one length, under which the largest inner
product is the nearest vector, so vectors of any length are served.

What is ranked exactly is, at every size, ``least`` candidates for each result
asked for and a share of the shard besides, and only entries that are posted under
a pivot the query reads.

Defined results: vectors that are null, zero, of another number of components
than most vectors have (of equally many, the larger number), or hold null or
non-finite components take no part; ties go to the smaller id; rows without id
take no part; a query id that comes with several vectors asks for the least of
them, and a candidate's id counts once with its best score; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Pivots: the vectors of least hash. A documented bound: what is fitted on a sample.
PIVOTS = 512
#: Files a vector is posted in, and files a query opens.
POSTED = 192
READS = 96
#: A query ranks exactly LEAST entries for each result asked for and this share of a shard's besides.
SHARE = 0.05
LEAST = 4
SHARD_ROWS = 8192
QUERY_BLOCK = 4096

#: More than twice the sum of all places that a query reads.
_MET = 1 << 24

_FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id long, v array<double>: rows that may take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


class Index:
    """Inverted pivot files over a shard of distinct vectors.

    ``rows``: the vectors; ``ids`` from ``heads[i]`` to ``heads[i + 1]``: ids of
    the i-th, rising; ``posts`` from ``files[p]`` to ``files[p + 1]``: entries
    posted under pivot p, and ``places`` p's place in their orders.
    """

    PARTS = ("rows", "ids", "heads", "files", "posts", "places", "pivots")

    def __init__(self, rows, ids, heads, files, posts, places, pivots):
        self.rows, self.ids, self.heads, self.files, self.posts, self.places, self.pivots = rows, ids, heads, files, posts, places, pivots

    @staticmethod
    def build(rows: np.ndarray, ids: list[np.ndarray], pivots: np.ndarray, longest: float, posted: int) -> Index:
        heads = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
        extra = np.sqrt(np.maximum(longest - (rows * rows).sum(1), 0.0))
        near = rows @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1][None, :]
        order = np.argsort(-near, axis=1, kind="stable")[:, :posted]
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        files = np.searchsorted(flat[by], np.arange(len(pivots) + 1))
        return Index(rows, np.concatenate(ids), heads, files, (by // order.shape[1]).astype(np.int32), (by % order.shape[1]).astype(np.int16), pivots)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{p: getattr(self, p) for p in self.PARTS})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Index:
        with np.load(io.BytesIO(data)) as got:
            return Index(*[got[p] for p in Index.PARTS])

    def candidates(self, q: np.ndarray, want: int, posted: int, reads: int) -> np.ndarray:
        """Posted entries of least footrule distance to the query's order; all that tie with the last."""
        n = len(self.rows)
        order = np.argsort(-(self.pivots[:, :-1] @ q), kind="stable")[:reads]  # queries are directions: their added coordinate is zero
        absent = min(posted, len(self.pivots))
        at = [slice(self.files[p], self.files[p + 1]) for p in order.tolist()]
        own = np.repeat(np.arange(len(order), dtype=np.int16), [x.stop - x.start for x in at])
        # against what an entry that is not posted there counts; a posting counts _MET besides, so that entries met are told from others
        far = (np.abs(np.concatenate([self.places[x] for x in at]) - own) - np.abs(absent - own)).astype(np.float64) + _MET
        total = np.bincount(np.concatenate([self.posts[x] for x in at]), weights=far, minlength=n)
        times = np.rint(total / _MET)
        foot, met = total - times * _MET, times > 0
        entries = np.flatnonzero(met)
        if not len(entries):
            return entries
        own = foot[entries]
        last = min(want, len(own)) - 1
        return entries[own <= np.partition(own, last)[last]]

    def search(self, q_ids: np.ndarray, q_rows: np.ndarray, k: int, share: float, least: int, posted: int, reads: int):
        """(query id, id, score) arrays: this shard's k best for each query."""
        want = least * k + int(np.ceil(share * len(self.rows)))
        for qid, q in zip(q_ids.tolist(), q_rows, strict=True):
            cand = self.candidates(q, want, posted, reads)
            s = self.rows[cand] @ q
            if len(cand) > k + 1:
                # keep ties with the last in, ids decide between them
                keep = s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                cand, s = cand[keep], s[keep]
            if not len(cand):
                continue
            own = [self.ids[self.heads[c] : self.heads[c + 1]] for c in cand.tolist()]
            i, x = np.concatenate(own), np.repeat(s, [len(o) for o in own])
            i, x = i[i != qid], x[i != qid]
            best = np.lexsort((i, -x))[:k]
            yield np.full(len(best), qid), i[best], x[best]


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file:" + uri)


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file under a temporary name and move it, so a repeated task leaves one whole file."""
    from pyspark import TaskContext

    store, root = _store(folder)
    tmp = f"{root}/tmp-{name}-{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(tmp) as f:
        f.write(data)
    store.move(tmp, f"{root}/{name}")


def _get(folder: str, name: str) -> bytes:
    store, root = _store(folder)
    with store.open_input_stream(f"{root}/{name}") as f:
        return f.read()


def build(vectors: DataFrame, folder: str, k: int, pivots: int = PIVOTS, posted: int = POSTED) -> list[int]:
    """Write the index of ``vectors`` (id, v of equal lengths) to ``folder`` as files index-N; the numbers N."""
    # of equal vectors no more than the k + 1 smallest ids can be among k nearest
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = vectors.distinct().withColumn("_place", place).where(F.col("_place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = common.save(entries, f"{folder}/entries")
    n, longest = entries.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n:
        return []
    p = np.array([r.v for r in entries.orderBy(F.xxhash64("v"), "v").limit(pivots).select("v").collect()])  # PIVOTS rows
    p = np.column_stack([p, np.sqrt(np.maximum(longest - (p * p).sum(1), 0.0))])
    p /= np.sqrt(longest)
    shards = -(-n // SHARD_ROWS)
    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("head")
        shard = table.column("shard")[0].as_py()
        ids = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for x in table.column("ids")]
        _put(folder, f"index-{shard}", Index.build(_matrix(table.column("v")), ids, p, longest, posted).dump())
        return pa.table({"shard": pa.array([shard], pa.int64()), "entries": pa.array([table.num_rows], pa.int64())})

    dealt = entries.select("v", "ids", F.col("ids")[0].alias("head"), F.pmod(F.xxhash64(F.lit(3), "v"), F.lit(shards)).alias("shard"))
    made = common.save(dealt.groupBy("shard").applyInArrow(run, "shard long, entries long"), f"{folder}/manifest")
    return sorted(r.shard for r in made.select("shard").collect())  # a number for each SHARD_ROWS vectors


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, share: float = SHARE, least: int = LEAST, posted: int = POSTED, reads: int = READS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other vectors found.

    ``vectors`` and ``queries`` come from ``usable``.
    """
    spark = vectors.sparkSession
    folder = common.shared_dir(spark)
    base = common.save(vectors, f"{folder}/vectors")
    lengths = base.groupBy(F.size("v").alias("size")).count().orderBy(F.col("count").desc(), F.col("size").desc()).limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return empty
    shards = build(base.where(F.size("v") == lengths[0]["size"]), folder, k, pivots, posted)
    asked = common.save(queries.where(F.size("v") == lengths[0]["size"]).groupBy("id").agg(F.min("v").alias("v")), f"{folder}/queries")
    blocks = -(-asked.count() // QUERY_BLOCK)
    if not blocks:
        return empty

    def keep(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        block = table.column("block")[0].as_py()
        out = io.BytesIO()
        np.savez(out, ids=table.column("id").to_numpy(), rows=_matrix(table.column("v")))
        _put(folder, f"queries-{block}", out.getvalue())
        return pa.table({"block": pa.array([block], pa.int64())})

    dealt = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(blocks)))
    kept = common.save(dealt.groupBy("block").applyInArrow(keep, "block long"), f"{folder}/blocks")
    # every block of queries meets every shard: two numbers a task
    cells = kept.withColumn("shard", F.explode(F.lit(shards).cast("array<long>")))
    cells = cells.repartition(min(10000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(shards))), "shard", "block").sortWithinPartitions("shard")

    def run(batches):
        held = None
        for batch in batches:
            for block, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is None or held[0] != shard:
                    held = shard, Index.load(_get(folder, f"index-{shard}"))
                with np.load(io.BytesIO(_get(folder, f"queries-{block}"))) as asked:
                    q_ids, q_rows = asked["ids"], asked["rows"]
                for a in range(0, len(q_ids), 256):
                    got = list(held[1].search(q_ids[a : a + 256], q_rows[a : a + 256], k, share, least, posted, reads))
                    if not got:
                        continue
                    q, i, s = (np.concatenate([g[j] for g in got]) for j in range(3))
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    # k rows a query and shard
    found = common.save(cells.select("block", "shard").mapInArrow(run, _FOUND), f"{folder}/found")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", best.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
