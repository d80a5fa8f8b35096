"""Streams give what the batch forms give."""

import json

from pyspark.sql import functions as F

from engramix import views
from engramix.operators import repeats
from engramix.streaming import jobs

SF = "/root/testdata/sf0.001"


def events_stream(spark, tmp_path, parts=4):
    e = views.view(spark, SF, "auto_entries").orderBy("ts")
    n = e.count()
    rows = e.collect()
    step = -(-n // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], e.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, df, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql("SELECT * FROM out")


def test_first_in_window(spark, tmp_path):
    e, stream = events_stream(spark, tmp_path)
    batch = {r.event_id for r in repeats.first_in_window(e, ["content_key"], "ts", "event_id", 21600).collect()}
    got = run(spark, jobs.first_in_window(stream.withWatermark("ts", "30 days"), ["content_key"], "ts", "event_id", 21600), tmp_path)
    assert {r.event_id for r in got.collect()} == batch
    assert 0 < len(batch) < e.count()


def test_daily_counts(spark, tmp_path):
    e, stream = events_stream(spark, tmp_path)
    got = {(str(r.day), r.event_type): r.n for r in run(spark, jobs.daily_counts(stream), tmp_path, "complete").collect()}
    want = {(str(r.day), r.event_type): r.n for r in e.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_log_ingestion_resumes(spark, tmp_path):
    logs, out, ck = tmp_path / "logs", str(tmp_path / "store"), str(tmp_path / "ck2")
    logs.mkdir()

    def line(text):
        return json.dumps({"message": {"role": "user", "content": text}, "timestamp": "2024-01-01T00:00:00Z"}) + "\n"

    (logs / "a.jsonl").write_text(line("one") + "broken\n" + line("two"))
    jobs.into(jobs.log_stream(spark, str(logs)), jobs.append_once(out), ck).awaitTermination(60)
    (logs / "b.jsonl").write_text(line("three"))
    jobs.into(jobs.log_stream(spark, str(logs)), jobs.append_once(out), ck).awaitTermination(60)
    assert sorted(r.content for r in spark.read.parquet(out).collect()) == ["one", "three", "two"]
