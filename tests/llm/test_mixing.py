import collections
import math
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from engramix.llm import mixing


def test_targets_by_hand(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 100), (None, 1000), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(mixing.cyclic_weights(rows)).collect()}
    # weights 1, 2, 3 and 1 (null last); caps 30, 300, 0 and 3000
    total, weight, cap = 1110, {"a": 1, "b": 2, "c": 3, None: 1}, {"a": 30, "b": 300, "c": 0, None: 3000}
    fixed = {}
    while True:
        free = [s for s in weight if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap[s]]
        if not over:
            break
        fixed |= {s: cap[s] for s in over}
    for s, t in (share | fixed).items():
        assert abs(got[s] - t) < 1e-9


def test_mix(docs):
    out = mixing.mix(docs.select("doc_id", "text", "source")).collect()
    again = mixing.mix(docs.select("doc_id", "text", "source").repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert len(out) == docs.count()
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in out:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s]
    sizes = {(r.doc_id, r.source): len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert all(r["size"] == sizes[r.doc_id, r.source] for r in out)
    same = collections.defaultdict(set)
    for r in out:
        same[r.doc_id, r["size"], r.source].add(r.copies)
    assert all(len(c) == 1 for c in same.values())


def drawn(seed, doc_id):
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    if doc_id is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), h)
    return (h % (1 << 52) + 0.5) / (1 << 52)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_order_and_cut_against_brute_force(docs, seed):
    """Whole copies first, then the rest one by one in the order of random odds over inclusion odds."""
    sources = collections.defaultdict(list)
    for r in mixing.mix(docs.select("doc_id", "text", "source"), seed=seed).collect():
        sources[r.source].append(r)
    partly = 0
    for rows in sources.values():
        pull = {r: 2.0 ** (-0.125 * r["size"].bit_length()) for r in rows}
        # the level at which the expected words are the target, documents at the cap set aside one class after the other
        capped = set()
        while True:
            left = rows[0].target - sum(3 * r["size"] for r in rows if pull[r] in capped)
            free = sum(r["size"] * pull[r] for r in rows if pull[r] not in capped)
            level = left / free if free else 0.0
            over = {pull[r] for r in rows if r["size"] and pull[r] not in capped and level * pull[r] >= 3}
            if not over:
                break
            capped |= {max(over)}
        for r in rows:
            want = 0.0 if not r["size"] else 3.0 if pull[r] in capped else level * pull[r]
            assert r.inclusion == pytest.approx(want, abs=1e-9)
        whole = {r: math.floor(r.inclusion + 1e-9) for r in rows}
        room = rows[0].target - sum(whole[r] * r["size"] for r in rows)
        order = collections.defaultdict(list)
        for r in rows:
            part = r.inclusion - whole[r]
            if part > 1e-9:
                u = drawn(seed, r.doc_id)
                order[u / (1 - u) * ((1 - part) / part), -(1 << 63) if r.doc_id is None else r.doc_id].append(r)
        extra, before = set(), 0
        for key in sorted(order):
            words = sum(r["size"] for r in order[key])
            if before + words / 2 > room:
                break
            extra.update(order[key])
            before += words
        partly += 0 < len(extra) < sum(map(len, order.values()))
        assert all(r.copies == min(3, whole[r] + (r in extra)) for r in rows)
    assert partly


def test_remix_repeats_rows(docs):
    plain = docs.where("doc_id is not null and doc_id <> 300")
    mixed = mixing.remix(plain)
    assert mixed.columns == plain.columns
    copies = {r.doc_id: r.copies for r in mixing.mix(plain.select("doc_id", "text", "source")).collect()}
    n = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert n == {d: c for d, c in copies.items() if c}


def test_empty(no_docs):
    assert mixing.mix(no_docs.select("doc_id", "text", "source")).collect() == []


def test_hot_source_is_near_its_target(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.expr("repeat('w ', 1 + int(id % 40))").alias("text"))
    got = mixing.mix(rows).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 40 for r in got)
