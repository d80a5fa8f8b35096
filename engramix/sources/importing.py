"""Imports that can be stopped and resumed.

A plan of chunks is dealt into batches by content, so a chunk is in the same
batch whenever the plan is made again. A batch is written as a whole and then
entered in the manifest with a digest of what it holds. A restarted import leaves
out batches that the manifest has with the same digest; of the others it writes
the chunks that the batch's earlier parts do not hold. A chunk is stored once,
however often an import is stopped, restarted, or run over a source that grew.

Below ``path`` lie ``store/batch=N/part=DIGEST``, ``manifest/entry=N-DIGEST``,
``filtered/run=ID`` and the plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from . import writers

MANIFEST = "batch int, digest string, rows long, at timestamp"


class Import:
    def __init__(self, spark: SparkSession, path: str, batches: int = 64):
        """``batches``: of how many batches an import consists; to be kept for all runs of one import."""
        self.spark, self.path, self.batches = spark, path.rstrip("/"), batches

    def _there(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def manifest(self) -> DataFrame:
        if not self._there("manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest")

    def stored(self) -> DataFrame | None:
        """Chunks of all batches in the manifest; parts of a batch that was being written when an import stopped do not count."""
        if not self._there("store"):
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/store").parquet(f"{self.path}/store")
        done = self.manifest().select("batch", F.col("digest").alias("part"))
        return rows.join(F.broadcast(done), ["batch", "part"], "left_semi").drop("part")  # a row a batch and run

    def filtered(self) -> DataFrame | None:
        """What was filtered in all runs, a chunk once, with the reason of the last run."""
        if not self._there("filtered"):
            return None
        rows = self.spark.read.parquet(f"{self.path}/filtered")
        return rows.groupBy("hash").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("hash", "run")]), "run").alias("r")).select("hash", "r.*")

    def plan(self, chunks: DataFrame, others: DataFrame, since: Column | None = None, noise: list[str] = ()) -> tuple[DataFrame, DataFrame]:
        """(chunks with their batch, filtered chunks); ``others``: what stores hold besides this import."""
        return self._dealt(writers.judged(chunks, others, since, noise))

    def _dealt(self, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
        keep, out = writers.sorted_out(judged)
        return keep.withColumn("batch", F.pmod(F.xxhash64("hash"), F.lit(self.batches)).cast("int")), out

    def pending(self, planned: DataFrame) -> list[tuple[int, str, int]]:
        """(batch, digest, rows) of batches that the manifest does not hold as they are now."""
        now = planned.groupBy("batch").agg(F.hex(F.bit_xor(F.xxhash64("hash"))).alias("digest"), F.count("*").alias("rows"))
        left = now.join(self.manifest().select("batch", "digest"), ["batch", "digest"], "left_anti")
        return sorted((r.batch, r.digest, r.rows) for r in left.collect())  # ``batches`` rows at most

    def run(self, chunks: DataFrame, others: DataFrame, since: Column | None = None, noise: list[str] = (), most: int | None = None, before_commit: Callable[[int], None] = lambda batch: None) -> int:
        """Import what is left, ``most`` batches at most; the number of batches written. ``before_commit`` is called between a batch's rows and its entry."""
        run = uuid.uuid4().hex
        # both parts are written from here, so contents are normalised and hashed once a run
        judged = scratch.save(writers.judged(chunks, others, since, noise), f"{self.path}/judged/{run}")
        planned, out = self._dealt(judged)
        out.write.mode("overwrite").parquet(f"{self.path}/filtered/run={self._next()}-{run}")
        # a batch is written by 16 tasks
        planned.repartition("batch", F.substring("hash", 1, 1)).write.mode("overwrite").partitionBy("batch").parquet(f"{self.path}/plan/{run}")
        planned = self.spark.read.schema(planned.schema).parquet(f"{self.path}/plan/{run}")
        scratch.drop(self.spark, f"{self.path}/judged/{run}")
        todo = self.pending(planned)[:most]
        for batch, digest, n in todo:
            own = planned.where(F.col("batch") == batch).drop("batch")
            old = self.stored()
            if old is not None:
                own = own.join(old.where(F.col("batch") == batch).select("hash"), "hash", "left_anti")
            own.write.mode("overwrite").parquet(f"{self.path}/store/batch={batch}/part={digest}")
            before_commit(batch)
            entry = self.spark.createDataFrame([(batch, digest, n)], "batch int, digest string, rows long").withColumn("at", F.current_timestamp())
            entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/entry={batch}-{digest}")
        return len(todo)

    def _next(self) -> str:
        """Runs sort by the number of manifest entries they found."""
        return f"{self.manifest().count():09d}"

    def rescue(self, hashes: DataFrame) -> DataFrame:
        """Filtered chunks of ``hashes`` (hash), to be stored after all, tagged as imported."""
        rows = self.filtered().join(hashes.select("hash").distinct(), "hash", "left_semi")
        return rows.withColumn("tags", F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.concat(F.lit("imported:"), F.coalesce("source", F.lit("unknown")))))).drop("reason")

    def report(self) -> DataFrame:
        """One row: chunks stored, batches, and filtered chunks by reason."""
        stored, out = self.stored(), self.filtered()
        n = stored.count() if stored is not None else 0
        reasons = {r.reason: r["count"] for r in out.groupBy("reason").count().collect()} if out is not None else {}
        return self.spark.createDataFrame([(n, self.manifest().select("batch").distinct().count(), *[reasons.get(x, 0) for x in ("old", "noise", "known")])], "imported long, batches long, old long, noise long, known long")
