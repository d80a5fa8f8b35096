"""Imports that are stopped and resumed; sweeps over growing tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from engramix.sources.importing import Import
from engramix.streaming.sweeps import Sweep


def chunks(spark, n, start=0):
    rows = [(f"chunk number {i} with words enough to be no noise at all, {i}", "s", ["t"]) for i in range(start, n)] + [("short", "s", None), ("already there, a text that is long enough to stay otherwise", "s", None)]
    return spark.createDataFrame(rows + rows[:3], "content string, source string, tags array<string>").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))


@pytest.fixture
def others(spark):
    return spark.createDataFrame([("Already there, a text that is LONG enough to stay otherwise",)], "content string")


class Killed(Exception):
    pass


def test_resumes_after_it_was_killed(spark, tmp_path, others):
    job = Import(spark, str(tmp_path), 5)
    seen = []

    def kill(batch):
        seen.append(batch)
        if len(seen) == 3:  # rows are written, the entry is not
            raise Killed

    with pytest.raises(Killed):
        job.run(chunks(spark, 40), others, before_commit=kill)
    assert job.manifest().count() == 2
    half = job.stored().count()
    assert 0 < half < 40
    again = Import(spark, str(tmp_path), 5)
    assert again.run(chunks(spark, 40), others) == 3
    texts = [r.content for r in again.stored().collect()]
    assert len(texts) == len(set(texts)) == 40
    assert again.run(chunks(spark, 40).repartition(7), others) == 0
    # the source grows
    assert again.run(chunks(spark, 50), others) > 0
    texts = [r.content for r in again.stored().collect()]
    assert len(texts) == len(set(texts)) == 50
    report = again.report().first()
    assert (report.imported, report.batches, report.noise, report.known, report.old) == (50, 5, 1, 1, 0)


def test_filtered_items_are_kept_and_rescued(spark, tmp_path, others):
    job = Import(spark, str(tmp_path), 2)
    assert job.stored() is None and job.filtered() is None
    job.run(chunks(spark, 3), others)
    job.run(chunks(spark, 3), others)
    out = {r.content: r for r in job.filtered().collect()}
    assert {k: r.reason for k, r in out.items()} == {"short": "noise", "already there, a text that is long enough to stay otherwise": "known"}
    back = job.rescue(spark.createDataFrame([(out["short"].hash,), (out["short"].hash,)], "hash string")).collect()
    assert [(r.content, r.tags) for r in back] == [("short", ["imported:s"])]


def test_limits_and_empty(spark, tmp_path, others):
    job = Import(spark, str(tmp_path), 4)
    assert job.run(chunks(spark, 0).limit(0), others) == 0
    assert job.run(chunks(spark, 30), others, most=1) == 1
    assert job.run(chunks(spark, 30), others, most=99) == 3
    assert job.stored().count() == 30


T0 = dt.datetime(2024, 1, 1)


def pending(spark, ids):
    return spark.createDataFrame([(f"m{i:03d}", T0 + dt.timedelta(minutes=i)) for i in ids], "id string, at timestamp")


def test_three_runs_over_growing_input(spark, tmp_path):
    sweep, done = Sweep(spark, str(tmp_path), "backfill"), []
    work = lambda rows: done.extend(r.id for r in rows.collect())
    assert sweep.due(T0) and sweep.progress() == (-1, None, None)
    assert sweep.run(pending(spark, range(10, 30)), work, T0, most=15) == 15
    assert done == [f"m{i:03d}" for i in range(10, 25)]
    assert not sweep.due(T0 + dt.timedelta(seconds=299)) and sweep.due(T0 + dt.timedelta(seconds=300))
    # more rows, also behind what was done
    assert sweep.run(pending(spark, range(0, 40)), work, T0 + dt.timedelta(hours=1)) == 25
    assert sweep.run(pending(spark, range(0, 45)), work, T0 + dt.timedelta(hours=2)) == 5
    assert sorted(done) == [f"m{i:03d}" for i in range(45)]
    assert sweep.progress() == (2, T0 + dt.timedelta(hours=2), T0 + dt.timedelta(minutes=44))
    assert sweep.run(pending(spark, range(45)), work, T0 + dt.timedelta(hours=3)) == 0


def test_failed_run_is_taken_again_and_lateness(spark, tmp_path):
    sweep, done = Sweep(spark, str(tmp_path), "gc", "10 minutes"), []

    def fail(rows):
        raise Killed

    with pytest.raises(Killed):
        sweep.run(pending(spark, range(20, 30)), fail, T0)
    work = lambda rows: done.extend(r.id for r in rows.collect())
    assert sweep.run(pending(spark, range(20, 30)), work, T0) == 10
    assert sweep.run(pending(spark, range(0, 31)), work, T0 + dt.timedelta(hours=1)) == 2  # m019 and m030
    assert sorted(done)[0] == "m019"


def test_work_may_change_what_it_was_found_in(spark, tmp_path):
    """Rows are fixed before the work: statuses that it writes do not shrink its own run."""
    table = str(tmp_path / "table")
    pending(spark, range(5)).withColumn("status", F.lit("pending")).write.parquet(table)
    sweep = Sweep(spark, str(tmp_path / "log"), "enrichment")

    def work(rows):
        ids = {r.id for r in rows.collect()}
        old = [(r.id, r.at, "complete" if r.id in ids else r.status) for r in spark.read.parquet(table).collect()]
        spark.createDataFrame(old, "id string, at timestamp, status string").write.mode("overwrite").parquet(table)

    assert sweep.run(spark.read.parquet(table).where("status = 'pending'"), work, T0) == 5
    assert sweep.run(spark.read.parquet(table).where("status = 'pending'"), work, T0) == 0


def test_a_run_reads_each_content_once(spark, tmp_path):
    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def content(i):
        met.add(1)
        return f"A long enough content of number {i}, which no filter takes for noise."

    chunks = spark.range(40).select(content("id").alias("content"), F.lit("s").alias("source"), F.array(F.lit("t")).alias("tags"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    others = spark.createDataFrame([("A long enough content of number 3, which no filter takes for noise.",)], "content string")
    job = Import(spark, str(tmp_path), 2)
    assert job.run(chunks, others) == 2
    assert met.value == 40
    assert job.stored().count() == 39 and [r.reason for r in job.filtered().collect()] == ["known"]
