import pytest
from pyspark.sql import functions as F

from engramix.llm import jaccard_join as jj


def brute(rows, words, k, percent):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_against_brute_force(docs, words, k, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jj.join(docs, k, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, words, k, percent)))


def test_dense_group_of_near_copies(spark, words):
    """Every text differs from the origin in a few words; lists are longer than a part."""
    import random

    rng = random.Random(1)
    origin = [f"t{i}" for i in range(120)]
    rows = []
    for d in range(150):
        t = list(origin)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            t[rng.randrange(120)] = f"e{rng.randrange(40)}"
        rows.append((d, " ".join(t)))
    before, jj.LIST_PART = jj.LIST_PART, 16
    try:
        got = jj.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_shingles", "component_id").collect()
    finally:
        jj.LIST_PART = before
    assert sorted(map(tuple, got)) == sorted(brute(rows, words, 3, 90))


@pytest.mark.parametrize(("k", "percent", "sizes"), [(3, 90, [(100, 11)]), (5, 80, [(100, 25)]), (3, 90, [(n, n // 9 - j) for n in (50, 100, 180, 300) for j in (0, 1, 2)]), (5, 80, [(n, n // 4 - j) for n in (40, 100, 200) for j in (-1, 0, 1)])])
def test_inserted_and_deleted_passages(spark, words, k, percent, sizes):
    """Copies near the threshold that differ by a passage only one of the two has."""
    rows = []
    for g, (n, more) in enumerate(sizes):
        text = [f"g{g}t{i}" for i in range(n + k - 1)]
        added = [f"g{g}e{i}" for i in range(more)]
        half = len(text) // 2
        rows += [(10 * g, " ".join(text)), (10 * g + 1, " ".join(text + added))]
        if len(sizes) > 1:
            rows += [(10 * g + 2, " ".join(text[:half] + added[: max(1, more - 2 * k)] + text[half:])), (10 * g + 3, " ".join(text[: half - 2] + text[half + 2 :]))]
    got = jj.join(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).select("doc_id", "n_shingles", "component_id").collect()
    want = brute(rows, words, k, percent)
    assert len({c for _, _, c in want}) < len(rows)
    assert sorted(map(tuple, got)) == sorted(want)


def test_keep_one(docs):
    kept = jj.keep_one(docs, 3, 90)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(300) + sum(100 <= (i or 0) < 112 for i in ids) >= 1
    assert {200, 201, 202, None} <= set(ids) and 205 not in ids and 203 in ids
    assert len(ids) == len({i for i in ids})


def test_empty(no_docs):
    assert jj.join(no_docs).collect() == []


def test_one_set_for_all(spark):
    same = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    assert jj.join(same).select("component_id", "n_shingles").distinct().collect() == [(0, 2)]
