"""What a curation run sends and computes, and that its results stay those of plain Python."""

import re

import numpy as np
from pyspark.sql import functions as F

from engramix import scratch
from engramix.functions import text as tx
from engramix.operators import curation as cu
from engramix.operators import lifecycle as lc
from engramix.operators import near
from engramix.operators import search as se
from engramix.plans.registry import now


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_query_is_kept_and_sent_once_a_shard(spark, monkeypatch):
    """Vectors without direction lie in reach of all cells; a query used to be kept once for each of them."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 32))
    e = spark.createDataFrame([(f"m{i:04d}", v.tolist()) for i, v in enumerate(x)], "memory_id string, embedding array<double>")
    kept, save = {}, scratch.save
    monkeypatch.setattr(scratch, "save", lambda df, path: kept.setdefault(path.rsplit("/", 1)[1], save(df, path)))
    assert se.neighbours(e, e, 3, 0.3).select("memory_id").distinct().count() > 500
    assert kept["visits"].count() == 600 and {len(r.visits) for r in kept["visits"].collect()} == {1}
    monkeypatch.setattr(near, "SHARD", 100)
    kept.clear()
    cells = near.Cells(e, 0.3)
    dealt, parts = cells.shards(100)
    assert sorted(c for c, _, _ in dealt) == [c for c in range(near.PIVOTS) if cells.count[c]] and len(parts) <= 12
    assert all(sum(int(cells.count[c]) for c in p) <= 100 for p in parts)


def test_close_and_equal_similarities_against_all_pairs(spark, monkeypatch):
    """Similarities nearer to each other than single precision tells, copies, ties, bounds, one large cell."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=24)
    x = np.vstack([base + rng.normal(size=(150, 24)) * 1e-4, np.repeat(rng.normal(size=(3, 24)), 30, 0), rng.normal(size=(160, 24)), np.zeros((2, 24))])
    ids = [f"m{i:04d}" for i in rng.permutation(len(x))]
    e = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "memory_id string, embedding array<double>").repartition(3)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    s = np.round(u @ u.T, 6)
    for name, value in (("SHARD", 40), ("BLOCK", 50), ("PIVOTS", 12), ("HEIGHT", 16), ("WIDTH", 9), ("NUMBERS", 24 * 60)):
        monkeypatch.setattr(near, name, value)
    for k, least, most in ((7, 0.3, 1.0), (4, -1.0, 1.0), (5, 0.1, 0.999999)):
        got = {(r.memory_id, r.place): (r.neighbour, r.similarity) for r in se.neighbours(e, e, k, least, most).collect()}
        want = {}
        for i, own in enumerate(ids):
            best = sorted((-s[i, j], ids[j]) for j in range(len(x)) if j != i and least <= s[i, j] <= most)[:k]
            want |= {(own, p + 1): (other, -v) for p, (v, other) in enumerate(best)}
        assert got == want


def test_candidates_without_limit_are_not_sorted_and_texts_judged_once(spark):
    rows = spark.createDataFrame([("a", 1.0, "x")], "id string, stability double, content string").select("*", now().alias("created_at"), F.lit(0.5).alias("trust_level"), F.lit(0).alias("reinforcement_count"), now().alias("last_reinforced_at"))
    memories = rows.select("id", "content", "created_at", now().alias("deleted_at"), F.lit(False).alias("is_consolidated_original"), F.array(F.lit("t")).alias("tags"))
    salience = rows.select(F.col("id").alias("memory_id"), "stability", F.lit(5.0).alias("difficulty"), "reinforcement_count", "last_reinforced_at")
    assert "Sort [created_at" not in plan(lc.curation_candidates(memories, salience, None, None))
    assert "Sort [created_at" in plan(lc.curation_candidates(memories, salience, None, 5))
    policy = cu.Policy(merges=None, flags=None, strengthens=None)
    decided = cu.decide(rows.select(F.col("id").alias("cluster"), "id"), rows, now(), policy)
    assert plan(cu.capped(decided, policy)).count("disregard") == plan(decided).count("disregard")


def test_signals_are_those_of_the_patterns(spark):
    texts = [None, "", "IGNORE  all\nPrevious", "İgnore previous", "ıgnore previous", "Know", "you ARE\tNOW disregard Override YOUR instructions", "ΑΣ ignore previous", "Σ ACT AS IF", "system :", "ſystem:", "NEVER say", "always\x0bdo", "never", "new Instructions:", "act as", "forget ALL", "You Must", "KNOW you are now"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, content string")
    signals = tx.injection_signals(F.col("content"))
    want = {i: list(dict.fromkeys(name for name, p in tx.INJECTION if re.search(p, t or "", re.ASCII))) for i, t in enumerate(texts)}
    assert {r.n: r.x for r in df.select("n", signals.alias("x")).collect()} == want
    assert "lambda" not in plan(df.select(signals))
