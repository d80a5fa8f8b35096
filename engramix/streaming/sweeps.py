"""Sweeps: jobs that come round and do what is still to do.

A sweep keeps a log of what it did, a part a run: the ids done and how far it
came in the order of its rows. The next run takes rows that are pending and not in
the log, the oldest first, so it goes on where the last one ended, and a row that
comes late is still done. The log entry of a run is written after its work; a run
that fails leaves no entry, and its rows are taken again, so the work must be
idempotent by id.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds between the runs of each sweep.
EVERY = {"gc": 3600, "curation": 86400, "enrichment": 3600, "promotion": 3600, "backfill": 300}
LOG = "id string, at timestamp, run int, ran_at timestamp"


class Sweep:
    def __init__(self, spark: SparkSession, path: str, name: str, lateness: str | None = None):
        """``lateness``: rows that are older than the furthest row done by more than this are not waited for (an interval); None waits for all."""
        self.spark, self.path, self.name, self.lateness = spark, f"{path.rstrip('/')}/{name}", name, lateness

    def log(self) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.path)

    def progress(self) -> tuple[int, datetime | None, datetime | None]:
        """Number of the last run (-1 for none), when it ran, and how far rows were done."""
        run, ran, at = self.log().agg(F.max("run"), F.max("ran_at"), F.max("at")).first()
        return (-1 if run is None else run), ran, at

    def left(self, pending: DataFrame) -> DataFrame:
        """Rows of pending (id, at, ...) that no run has done."""
        rows = pending.join(self.log().select("id").distinct(), "id", "left_anti")
        at = self.progress()[2]
        if self.lateness is not None and at is not None:
            rows = rows.where(F.col("at") >= F.lit(at) - F.expr(f"INTERVAL {self.lateness}"))
        return rows

    def run(self, pending: DataFrame, work: Callable[[DataFrame], None], now: datetime, most: int | None = None) -> int:
        """Do what is left, ``most`` rows at most; the number of rows done."""
        rows = self.left(pending)
        if most is not None:
            rows = rows.orderBy("at", "id").limit(most)
        number = self.progress()[0] + 1
        rows = rows.select("*", F.lit(number).alias("run"), F.lit(now).cast("timestamp").alias("ran_at"))
        # what this run takes is fixed before the work changes the tables it was found in
        taken = f"{self.path}.taken/run={number}"
        rows.write.mode("overwrite").parquet(taken)
        rows = self.spark.read.schema(rows.schema).parquet(taken)
        work(rows.drop("run", "ran_at"))
        done = rows.select("id", "at", "ran_at")
        done.write.mode("overwrite").parquet(f"{self.path}/run={number}")
        return self.log().where(F.col("run") == number).count()

    def due(self, now: datetime, every: int | None = None) -> bool:
        """Whether the time between runs is over; a sweep that never ran is due."""
        last = self.progress()[1]
        return last is None or (now - last).total_seconds() >= (EVERY[self.name] if every is None else every)
