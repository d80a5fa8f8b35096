"""Structured Streaming jobs: log ingestion, windows of repeats, sessions, daily counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import readers


def log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Entries of the JSONL files that appear in a folder; the checkpoint keeps what was read."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(folder)
    return readers.log_entries(lines.select(F.col("_metadata.file_path").alias("path"), "value").where(F.trim("value") != ""))


def first_in_window(rows: DataFrame, keys: list[str], at: str, order: str, seconds: int) -> DataFrame:
    """Repeats within ``seconds`` of the last kept row of their key are dropped.

    Same rule as the batch fold; the state of a key is the time of its last kept
    row. A state that no repeat can meet any more times out with the watermark.
    """
    kind = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kind[k]}" for k in keys), f"{order} {kind[order]}"])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values([at, order])
        micros = pdf[at].astype("datetime64[us]").astype("int64")
        kept = []
        for t, o in zip(micros, pdf[order], strict=True):
            if last is None or t - last >= seconds * 1_000_000:
                last = int(t)
                kept.append((*key, o))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(kept, columns=[*keys, order])

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def session_counts(events: DataFrame, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, started, ended, n): sessions that an idle gap ends."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("day"), "event_type", "n")


def into(rows: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand micro-batches to ``store``, which must be idempotent by batch number."""
    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A store that writes each batch into its own folder: a repeated batch replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return store
