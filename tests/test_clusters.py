"""Greedy clusters, neighbours and related counts against plain Python."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from engramix.operators import graph as gr
from engramix.operators import lifecycle as lc
from engramix.operators import near
from engramix.operators import search as se
from engramix.plans import catalog


def fold(edges, rows, most):
    near = {}
    for u, v, s in edges:
        near.setdefault(u, []).append((-s, v))
    left, out = {i for i, _ in rows}, set()
    for seed, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        if seed not in left:
            continue
        members = [seed, *[v for _, v in sorted(near.get(seed, [])) if v in left and v != seed]]
        left -= set(members)
        for i in range(0, len(members), most):
            out |= {(members[i], m) for m in members[i : i + most]}
    return out


def test_greedy_clusters(spark):
    rng = random.Random(3)
    rows = [(f"m{i:03d}", rng.choice([1, 2, 3, None])) for i in range(80)]
    pairs = {(f"m{rng.randrange(90):03d}", f"m{rng.randrange(90):03d}") for _ in range(260)}
    pairs |= {("m000", f"m{i:03d}") for i in range(1, 20)}
    edges = [(u, v, round(rng.random(), 1)) for u, v in sorted(pairs) if u != v]
    e = spark.createDataFrame(edges, "memory_id string, neighbour string, similarity double")
    c = spark.createDataFrame(rows, "id string, priority int")
    assert {tuple(r) for r in lc.greedy_clusters(e, c).collect()} == fold(edges, rows, 5)
    assert lc.greedy_clusters(e.limit(0), c).count() == 80
    assert lc.greedy_clusters(e, c.limit(0)).count() == 0


def test_neighbours_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"m{i:03d}", [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)] + [("z0", [0.0] * 4), ("z1", [1.0, 0.0]), ("z2", None)]
    e = spark.createDataFrame(rows, "memory_id string, embedding array<double>")
    whole = sorted(map(tuple, se.neighbours(e, e, 5, 0.2).collect()))
    monkeypatch.setattr(near, "BLOCK", 7)
    monkeypatch.setattr(near, "SHARD", 11)
    monkeypatch.setattr(near, "PIVOTS", 9)
    assert sorted(map(tuple, se.neighbours(e, e, 5, 0.2).collect())) == whole
    norm = {i: sum(x * x for x in v) ** 0.5 for i, v in rows[:120]}
    want = []
    for i, v in rows[:120]:
        s = [(-round(sum(x * y for x, y in zip(v, w, strict=True)) / (norm[i] * norm[j]), 6), j) for j, w in rows[:120] if j != i]
        want += [(i, j, -x, n + 1) for n, (x, j) in enumerate(sorted(p for p in s if -p[0] >= 0.2)[:5])]
    assert [(a, b, n) for a, b, _, n in whole] == [(a, b, n) for a, b, _, n in sorted(want)]


def test_cells_lose_no_neighbour_and_tell_clusters_apart(spark):
    """All thresholds against all pairs; on clusters a small share of the pairs is compared."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 24)) * 0.08
    x[1400:] = rng.normal(size=(100, 24))  # without direction
    e = spark.createDataFrame([(f"m{i:04d}", v.tolist()) for i, v in enumerate(x)], "memory_id string, embedding array<double>").repartition(5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    for least in (0.5, 0.95, 0.999):
        got = {(r.memory_id, r.neighbour): r.similarity for r in se.neighbours(e, e, 2000, least).collect()}
        assert got == {(f"m{i:04d}", f"m{j:04d}"): s[i, j] for i, j in zip(*np.nonzero(s >= least), strict=True)}
    assert near.work(e, e, 0.95) < 0.15
    assert near.work(e, e, -1.0) == 1.0
    assert se.neighbours(e.limit(0), e, 5, 0.5).collect() == se.neighbours(e, e.limit(0), 5, 0.5).collect() == []


def test_neighbours_asks_every_vector(spark, tmp_path):
    """Ids of any remainder, any label, current or not; rows without a vector or finite components ask nothing, as in the SQL."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(130, 6)).astype(np.float32)
    rows = [(i, v.tolist(), None if i % 9 == 0 else i % 4) for i, v in enumerate(x)]
    odd = [(200, None, 3), (250, [float("nan")] * 6, 3), (300, [0.0] * 6, 3)]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.memory_id, r.place): (r.neighbour, r.similarity) for r in catalog.QUERIES["neighbours"](spark, str(tmp_path)).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {}
    for i in range(130):
        best = sorted((-s[i, j], f"m{j:09d}") for j in range(130) if j != i and 0.2 <= s[i, j] <= 1.0)[:5]
        want |= {(f"m{i:09d}", p + 1): (other, -v) for p, (v, other) in enumerate(best)}
    assert got == want and len({i for i, _ in got}) == 130
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert {(r[0], r[3]): (r[1], r[2]) for r in con.execute(catalog.ORACLES["neighbours"]).fetchall()} == want


def test_related_counts(spark):
    rows = [("a", ["x", "en"], None), ("b", ["x", "y", "x"], None), ("c", ["y"], None), ("d", ["en"], None), ("e", None, None), ("f", ["x"], "2024-01-01"), ("g", ["q", None], None)]
    m = spark.createDataFrame(rows, "id string, tags array<string>, deleted_at string")
    assert {tuple(r) for r in gr.related_counts(m, m.select("id"), ["en"]).collect()} == {("a", 1), ("b", 2), ("c", 1)}


def test_related_counts_of_any_number_of_tags(spark):
    rng = random.Random(3)
    tags = [f"t{i}" for i in range(14)]
    rows = [(f"m{i}", rng.sample(tags, rng.choice([0, 1, 2, 3, 5, 6, 7, 9, 14])) + ["all"] * (i % 3 == 0)) for i in range(300)]
    m = spark.createDataFrame(rows, "id string, tags array<string>").withColumn("deleted_at", F.lit(None).cast("string"))
    asked = m.where("int(substring(id, 2)) % 5 = 0")
    own = {i: set(t) - {"t0"} for i, t in rows}
    want = {i: sum(1 for j in own if j != i and own[i] & own[j]) for i in own if int(i[1:]) % 5 == 0}
    assert {r.id: r.related for r in gr.related_counts(m, asked, ["t0"]).collect()} == {i: n for i, n in want.items() if n}
    assert gr.related_counts(m.limit(0), asked, []).collect() == gr.related_counts(m, asked.limit(0), []).collect() == []
