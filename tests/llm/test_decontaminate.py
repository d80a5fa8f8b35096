import collections

import pytest

from engramix.llm import decontaminate as dc


def brute(docs, items, words, window=13):
    found = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            found[tuple(w[j : j + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, listed = words(text), set(), set()
        for n in {len(k) for k in found}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in found:
                    hit |= set(range(j, j + n))
                    listed |= found[tuple(w[j : j + n])] - {None}
        out.append((doc, len(w), len(hit), len(listed), dc.digest(list(listed)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("part_bytes", [16 << 20, 300])
def test_against_brute_force(spark, docs, plain_words, part_bytes):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    long = next(t for d, t in rows if d == 301)
    items = [(1, " ".join(long.split()[100:140])), (2, long.upper()[300:700]), (3, "one"), (4, "ONE,  two"), (5, None), (6, "..."), (None, "minus-seven"), (1, "w1 w2"), (10, "alpha beta gamma delta")]
    got = dc.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), part_bytes=part_bytes).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, items, plain_words)))
    assert any(r.contaminated for r in got) and not all(r.contaminated for r in got)


def test_clean_keeps_columns(spark, docs):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    kept = dc.clean(docs, items)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert {203, 205, 204} <= gone and 200 not in gone


def test_empty(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(no_docs, none).count() == 0
    assert dc.decontaminate(docs, none).where("contaminated or n_hit > 0").count() == 0


def test_repeated_items_are_one_test_string(spark, docs):
    """A thousand repeats of an item do not grow the parts, and its ids are all listed."""
    items = spark.createDataFrame([(i % 3, "gamma, delta. w1") for i in range(1000)] + [(9, "one two")], "item_id long, text string")
    few = spark.createDataFrame([(0, "gamma delta w1"), (1, "gamma delta w1"), (2, "gamma delta w1"), (9, "one two")], "item_id long, text string")
    got = dc.decontaminate(docs, items, part_bytes=40)
    assert sorted(map(str, got.collect())) == sorted(map(str, dc.decontaminate(docs, few).collect()))


def test_tables_skip_however_many_windows():
    """Most slots of a machine of 40,000 windows let a search skip."""
    texts = [" ".join(f"v{i * 31 + j * 7919 % 5003}" for j in range(40)) for i in range(1500)]
    _, (machine,) = dc.machines(list(range(1500)), texts)
    assert len(machine.at) > 40000 and (machine.shift == 0).mean() < 0.2 and (machine.shift > 1).mean() > 0.4
