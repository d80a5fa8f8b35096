"""Repeats within a window, where one key may fill many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch

_KEPT, _OPEN, _HEAD, _TAIL = range(4)


def _next(t: np.ndarray, width: int) -> np.ndarray:
    """For each time (sorted) the place of the first that lies ``width`` later."""
    return np.maximum(np.searchsorted(t, t + width, side="left"), np.arange(1, len(t) + 1))


def _kept(t: np.ndarray, width: int, first: int = 0) -> list[int]:
    """Places kept when the fold keeps ``first``."""
    after, out, i = _next(t, width), [], first
    while i < len(t):
        out.append(i)
        i = int(after[i])
    return out


def _steps(t: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(times, last kept time if the fold first keeps the row of that time), for the rows that can be the first kept."""
    places = np.arange(len(t))
    after = _next(t, width)
    last = np.where(after < len(t), np.minimum(after, len(t) - 1), places)
    while not np.array_equal(last, last[last]):
        last = last[last]
    reach = int(np.searchsorted(t, t[0] + width, side="left")) + 1
    at, end = t[:reach], t[last[:reach]]
    turn = np.append(end[1:] != end[:-1], True)  # of rows with the same end the latest says it for all
    return at[turn], end[turn]


def _ranges(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of sorted rows: what it keeps for sure, its open first chain, and how times pass through it."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    rows = pa.Table.from_batches(got).combine_chunks()
    key, order, part = rows["_k"].combine_chunks(), rows["_o"].combine_chunks(), rows["_part"][0].as_py()
    t = rows["_t"].to_numpy()
    new = np.ones(len(t), bool)
    new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False) | (np.diff(t) >= width)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(t))
    kept, single = [], ends - starts == 1
    single[0] = False  # the first chain may go on from the range before
    kept.append(starts[single])
    for a, b in zip(starts[1:], ends[1:], strict=True):
        if b - a > 1:
            kept.append(a + np.array(_kept(t[a:b], width)))
    kept = np.concatenate(kept).astype(np.int64)
    at, end = _steps(t[: ends[0]], width)

    def out(kind, k, times, orders, lists=(None, None)):
        n = len(times)
        columns = [pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), k, pa.array(times, pa.int64()), orders]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array([x] * n, pa.list_(pa.int64())) for x in lists]], names=["kind", "part", "k", "t", "o", "at", "end"])

    none = pa.nulls(1, order.type)
    yield out(_KEPT, pa.nulls(len(kept), pa.string()), t[kept], order.take(pa.array(kept)))
    yield out(_OPEN, pa.nulls(int(ends[0]), pa.string()), t[: ends[0]], order[: ends[0]])
    yield out(_HEAD, key[:1], t[:1], none, (at.tolist(), end.tolist()))
    if len(starts) > 1:
        a = starts[-1]
        yield out(_TAIL, key[len(t) - 1 :], [int(t[a:][_kept(t[a:], width)[-1]])], none)


def _entries(width: int, ends: pa.Table) -> pa.Table:
    """(part, last): the last kept time before each range of one key, through its ranges in their order."""
    last, out = None, []
    for row in ends.sort_by([("part", "ascending"), ("kind", "ascending")]).to_pylist():
        if row["kind"] == _TAIL:
            last = row["t"]
            continue
        out.append({"part": row["part"], "last": last})
        place = 0 if last is None else int(np.searchsorted(row["at"], last + width, side="left"))
        if place < len(row["at"]):
            last = row["end"][place]
    return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("last", pa.int64())]))


def _opened(width: int, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("t", "ascending"), ("o", "ascending")])
    t, last = rows["t"].to_numpy(), rows["last"][0].as_py()
    first = 0 if last is None else int(np.searchsorted(t, last + width, side="left"))
    return rows.select(["o"]).take(pa.array(_kept(t, width, first), pa.int64()))


def first_in_window(rows: DataFrame, keys: list[str], at: str, order: str, seconds: int, ranges: int | None = None) -> DataFrame:
    """Rows kept when a repeat within ``seconds`` of the last *kept* row is dropped.

    A dropped repeat does not move the window, so this is a fold over each key's
    rows by time, then ``order``. Rows are sorted in ranges of key and time, so
    that a hot key is spread over as many ranges as it fills. A gap as long as
    the window starts the fold anew, so only the first chain of a range depends
    on what was kept before it. Each range tells which last kept time comes out
    for each row its fold may start with (folds that start apart soon meet, so
    these are a few); that is strung together for each key, and the open chains
    are folded from where they start.

    Rows without a time are kept. ``order`` is taken to be unique; rows without
    it are left out. Nulls in keys are a key of their own. No rows give no rows.
    """
    width, spark = seconds * 1_000_000, rows.sparkSession
    kind = dict(rows.dtypes)[order]
    # named fields, so that no key looks like another
    key = F.to_json(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]))
    slim = rows.select(key.alias("_k"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), F.col(order).alias("_o")).where("_t is not null and _o is not null")
    by = ("_k", "_t", "_o")
    dealt = slim.repartitionByRange(ranges, *by) if ranges else slim.repartitionByRange(*by)
    placed = dealt.sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    folder = scratch.folder(spark)
    schema = f"kind int, part int, k string, t long, o {kind}, at array<long>, end array<long>"
    told = scratch.save(placed.mapInArrow(lambda batches: _ranges(width, batches), schema), folder)
    ends = told.where(F.col("kind").isin(_HEAD, _TAIL)).select("k", "kind", "part", "t", "at", "end")
    entries = ends.groupBy("k").applyInArrow(lambda table: _entries(width, table), "part int, last long")
    opened = told.where(F.col("kind") == _OPEN).select("part", "t", "o").join(entries, "part")
    kept = told.where(F.col("kind") == _KEPT).select("o").unionByName(opened.groupBy("part").applyInArrow(lambda table: _opened(width, table), f"o {kind}"))
    timeless = F.col(at).cast("timestamp").isNull()
    kept = rows.where(~timeless).join(kept.withColumnRenamed("o", order), order, "left_semi").select(*[F.col(f"`{c}`") for c in rows.columns])
    return kept.unionByName(rows.where(timeless & F.col(order).isNotNull()))
