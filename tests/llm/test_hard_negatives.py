import math
import random

import numpy as np
import pytest

from engramix.llm import hard_negatives
from engramix.llm.hard_negatives import Asked, Tree, interval, search


def brute(rows, every, positives=5, negatives=10):
    """(vec_id, label, integer vector) rows, an id each."""
    out = []
    for i, label, v in rows:
        if i % every:
            continue
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in rows if j != i)
        for s, j, _ in [x for x in near if x[2] == label][:positives]:
            hard = [x for x in near if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(hard, 1)]
    return sorted(out)


def floors(rows):
    return [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]


@pytest.mark.parametrize("shape", ["noise", "clusters", "coarse"])
def test_against_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 60)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "RUNS", 3)
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    draw = {"noise": lambda: [rng.gauss(0, 0.4) for _ in range(8)], "clusters": lambda: [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], "coarse": lambda: [rng.choice([0.0, 0.25, -0.25]) for _ in range(8)]}[shape]
    rows = [(i - 20, rng.choice([0, 1, 1, 2, 3]), draw()) for i in range(420)]
    rows += [(500 + i, 1, rows[0][2]) for i in range(60)]  # equal vectors, anchors among them
    rows += [(600, 9, draw())]  # alone with its label
    extra = [(700, None, draw()), (None, 1, draw()), (710, 1, None), (720, 1, [math.nan] * 8), (730, 1, [math.inf] * 8), (740, 1, [None] * 8), (750, 1, [0.1]), (760, 1, [])]
    repeats = [(rows[3][0], rows[3][1] + 1, rows[4][2]), rows[5]]  # the smallest label counts
    df = spark.createDataFrame([(*r, "x", 2) for r in rows + extra + repeats], "vec_id long, label int, embedding array<double>, rank string, part int").repartition(5)
    got = sorted(map(tuple, hard_negatives.mine(df, 10).collect()))
    assert got == brute(floors(rows), 10)
    assert got


def test_few_and_none(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.mine(spark.createDataFrame([], schema), 10).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(3, 1, [0.5, 0.5])], schema), 10).collect() == []
    two = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.0]), (3, 2, [0.9, 0.0]), (4, 2, [0.25, 0.5]), (5, 2, [-1.0, 0.0])]
    got = [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(two, schema), 10).collect()]
    assert sorted(got) == brute(floors(two), 10)
    assert [r[3] for r in sorted(got)] == [3, 2]


def test_intervals_hold_every_pair():
    rng = np.random.default_rng(1)
    a, b = (Tree.build(rng.integers(-300, 300, (n, 5)), np.arange(n), rng.integers(0, 3, n), 8) for n in (50, 90))
    least, most = interval(a.mid, a.far, b.mid, b.far)
    for i in range(len(a.begin)):
        for j in range(len(b.begin)):
            s = a.rows[a.begin[i] : a.end[i]] @ b.rows[b.begin[j] : b.end[j]].T
            assert least[i, j] <= s.min() and s.max() <= most[i, j]


def test_groups_are_left_out():
    """On clustered vectors most pairs are never scored."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (40, 16))
    which = rng.integers(0, 40, 6000)
    which[:200] %= 8
    rows = centres[which] + rng.integers(-60, 60, (6000, 16))
    label = np.zeros(6000, np.int64)
    anchors, cand = Tree.build(rows[:200], np.arange(200), label[:200], 8), Tree.build(rows, np.arange(6000), label, 64)
    n = len(anchors.ids)
    asked = Asked(anchors, np.arange(n), np.zeros(n, np.int64), np.full(n, -(1 << 61)), np.full(n, 1 << 61), 5, True)
    scored = search(asked, cand)
    s = anchors.rows @ rows.T
    s[np.arange(n), anchors.ids] = -(1 << 61)
    assert (asked.scores == -np.sort(-s, axis=1)[:, :5]).all()
    assert scored < 0.35 * n * 6000
