"""The repeat window over ranges, against a fold in Python; places and percentiles."""

import random

import pytest
from pyspark.sql import functions as F

from engramix.functions import scoring as sc
from engramix.functions import text as tx
from engramix.operators import records as rc
from engramix.operators import repeats
from engramix.sources import readers


def folded(rows, seconds):
    last, kept = {}, set()
    for key, at, n in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2])):
        if at is None:
            kept.add(n)
        elif key not in last or at - last[key] >= seconds:
            last[key] = at
            kept.add(n)
    return kept


def cases():
    rng = random.Random(5)
    hot = [("hot", rng.randrange(20_000), i) for i in range(3000)]
    spread = [(rng.choice(["a", "b", None, "c"]), rng.randrange(40_000), 3000 + i) for i in range(1500)]
    return {
        "hot and others": hot + spread,
        "equal steps never meet": [("k", 7 * i, i) for i in range(2000)],
        "equal times": [("k", i // 50, i) for i in range(2000)],
        "no time": [("k", None if i % 3 else i, i) for i in range(60)],
        "one row": [("k", 5, 1)],
        "none": [],
    }


@pytest.mark.parametrize("name", cases())
@pytest.mark.parametrize("seconds", [37, 50_000])
def test_first_in_window(spark, name, seconds):
    rows = cases()[name]
    df = spark.createDataFrame(rows, "k string, s long, n long").withColumn("at", F.timestamp_seconds("s")).withColumn("t", F.lit("clash"))
    got = repeats.first_in_window(df.repartition(3), ["k"], "at", "n", seconds, 9)
    assert got.columns == df.columns
    assert sorted(r.n for r in got.collect()) == sorted(folded(rows, seconds))


def test_hot_key_fills_many_ranges(spark):
    df = spark.range(4000).select(F.lit("k").alias("k"), F.lit("x").alias("k2"), F.timestamp_seconds("id").alias("at"), F.concat(F.lit("e"), F.lpad("id", 5, "0")).alias("n"))
    got = sorted(r.n for r in repeats.first_in_window(df, ["k", "k2"], "at", "n", 1000, 16).collect())
    assert got == ["e00000", "e01000", "e02000", "e03000"]


def test_numbered(spark):
    rows = [(i % 7, i) for i in range(500)] + [(None, 500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    want = {b: p for p, (a, b) in enumerate(sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1])), 1)}
    assert {r.b: r.place for r in rc.numbered(df, "a", "b").collect()} == want
    assert rc.numbered(df.limit(0), "a").collect() == []


def test_percentiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, *range(40)])) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, v int")
    p = (0.5, 0.95, 0.99)
    want = {(r.k, r.a, r.b, r.c) for r in df.where("v is not null").groupBy("k").agg(*[F.expr(f"int(percentile_disc({q}) WITHIN GROUP (ORDER BY v))").alias(n) for q, n in zip(p, "abc", strict=True)]).collect()}
    assert {tuple(r) for r in rc.percentiles(df, "k", "v", *p).collect()} == want


def test_routed(spark):
    rows = spark.createDataFrame([(1, "a", 3.0, 10), (2, "a", None, 10), (3, "b", 3.0, 99), (4, None, None, None)], "i int, h string, s double, n int")
    rules = {"base": {"size": 0}, "one": {"types": ["a"], "stability": 2}, "two": {"size": 50, "types": []}}
    tier = sc.routed(rules, "base", F.col("h"), F.col("s"), F.col("n"))
    assert {r.i: r.t for r in rows.select("i", tier.alias("t")).collect()} == {1: "one", 2: "base", 3: "two", 4: "base"}
    assert rows.select(sc.routed({"base": {}}, "base", F.col("h"), F.col("s"), F.col("n")).alias("t")).first().t == "base"


def test_agent_name(spark):
    rows = [("sessions/vita/2026-01-15/chat", "sessions", "vita"), ("sessions/2026-01-15/chat", "sessions", "file"), ("memory/x", "memory", "file"), ("sessions", "sessions", "file"), (None, "sessions", "file"), ("p/q", None, "file")]
    df = spark.createDataFrame([(*r, "file") for r in rows], "path string, source string, want string, stem string")
    assert all(r.want == r.got for r in df.select("want", tx.agent_name(F.col("path"), F.col("source"), F.col("stem")).alias("got")).collect())


def test_history_chunks(spark):
    lines = ['{"type": "user", "message": {"role": "user", "content": "q"}}', '{"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}]}}', '{"content": "plain"}']
    entries = readers.log_entries(spark.createDataFrame([("p", x) for x in lines], "path string, value string"))
    assert [(r.content, r.type_hint) for r in readers.history_chunks(entries, "log").collect()] == [("a", "observation")]
    assert readers.history_chunks(entries, "log", assistant_only=False).count() == 2
