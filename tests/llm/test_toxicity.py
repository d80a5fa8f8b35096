import collections
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from engramix.llm import common
from engramix.llm import toxicity as tx


def corpus(spark, n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(rng.randint(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(w) // 20)):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "filth", "rotten"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    scored = tx.score(docs, tx.train(docs, labels)).join(labels, "doc_id").where(tx.held_out())
    got = scored.select("toxic", (F.col("score") >= 0.5).cast("int").alias("p")).collect()
    assert sum(r.toxic == r.p for r in got) / len(got) > 0.95
    kept = tx.keep_clean(docs, labels)
    assert kept.columns == docs.columns and 400 < kept.count() < 500


def test_odd_rows(spark, docs, no_docs):
    some, labels = corpus(spark, 200)
    model = tx.train(some, labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema)))
    out = tx.score(docs, model)
    assert out.columns == [*docs.columns, "score"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert tx.score(no_docs, model).collect() == []
    none = tx.train(some, labels.limit(0))
    assert len({r.score for r in tx.score(docs, none).collect()}) == 1


def accuracy(spark, ordinary, toxic):
    """Share of 300 texts that a model of 600 others tells right; every third is toxic."""
    rng = random.Random(4)
    label = np.arange(900) % 3 == 0
    texts = [" ".join(toxic(rng) if t else ordinary(rng)) for t in label]
    shuffled = rng.sample(range(900), 900)
    own, check = shuffled[:600], shuffled[600:]
    rows = spark.createDataFrame([(i, bool(label[i]), texts[i]) for i in own], "doc_id long, toxic boolean, text string")
    model = tx.fit(rows, 1 / 3, common.shared_dir(spark))
    got = model.score(pa.array([texts[i] for i in check], pa.large_string())) >= 0.5
    return (got == label[check]).mean()


def test_mild_differences_add_up(spark):
    """Toxic texts have some words twice as often and others half as often."""

    def drawn(rng, shares):
        return [f"{g}{rng.randrange(400)}" for g in rng.choices("abc", shares, k=120)]  # so many words that contexts do not run out

    assert accuracy(spark, lambda rng: drawn(rng, (1, 2, 2)), lambda rng: drawn(rng, (2, 1, 2))) > 0.9


def test_pairs_of_ordinary_words(spark):
    """Two words that are as common in both classes insult only side by side, each pair in few texts."""

    def placed(rng, *parts):
        w = [[f"w{rng.randrange(40)}"] for _ in range(20)]
        for at, part in zip(sorted(rng.sample(range(1, 20), len(parts)), reverse=True), parts, strict=True):
            w[at:at] = [part, [f"w{rng.randrange(40)}"]]
        return [x for part in w for x in part]

    def toxic(rng):
        i = rng.randrange(30)
        return placed(rng, [f"p{i}", f"q{i}"])

    assert accuracy(spark, lambda rng: placed(rng, [f"p{rng.randrange(30)}"], [f"q{rng.randrange(30)}"]), toxic) > 0.9


SMALL = ["a b c d a b", "a b c e a b", "a f g d", "x b c y", "x f g y a b", "x b g y y y", "a b c d a b"]


def test_probabilities_against_brute_force(spark):
    """Both models, computed from the definition: continuation counts, one discount, shared lowest level."""
    toxic = [False] * 3 + [True] * 3 + [False]
    seen = {(t, e, p, w) for text, t in zip(SMALL, toxic, strict=True) for e, p, w in zip(["", "", *text.split()], ["", *text.split()], text.split(), strict=False)}
    m = [collections.Counter((p, w) for t, _, p, w in seen if t == c) for c in (False, True)]
    n = [collections.Counter(w for _, w in m[c]) for c in (0, 1)]
    vocab = sorted({*n[0], *n[1]})
    classes = {w: sum(w in n[c] for c in (0, 1)) for w in vocab}
    shared = {w: classes[w] / (sum(classes.values()) + 1) for w in vocab}
    d = tx.DISCOUNT
    uni = [{w: (max(n[c][w] - d, 0) + sum(min(x, d) for x in n[c].values()) * shared[w]) / sum(n[c].values()) for w in vocab} for c in (0, 1)]
    pairs = common.save(tx.contexts(spark.createDataFrame(list(zip(toxic, SMALL, strict=True)), "toxic boolean, text string")), common.shared_dir(spark))
    words, unknown0, unknown1 = tx.word_probabilities(pairs)
    h = {int(v): w for w, v in zip(vocab, common.words(pa.array([" ".join(vocab)]), common.ALNUM).hashes.view(np.int64), strict=True)} | {0: ""}
    got = {h[r.word]: (r.p0, r.p1) for r in words.collect()}
    for c, unknown in ((0, unknown0), (1, unknown1)):
        assert all(math.isclose(got[w][c], uni[c][w]) for w in vocab)
        assert math.isclose(sum(uni[c].values()) + unknown, 1)
    k = [collections.Counter() for _ in (0, 1)]
    for c in (0, 1):
        for (_, w), x in m[c].items():
            k[c][w] += x
    take = [{w: (k[c][w] + 1) / sum(k[c][x] + 1 for x in vocab) for w in vocab} for c in (0, 1)]
    rows = {(h[r.prev], h[r.word]): (r.q0, r.q1) for r in tx.pair_probabilities(pairs, words).collect()}
    assert set(rows) == {*m[0], *m[1]}
    for p in {p for p, _ in rows}:
        after = [{x: k for (y, x), k in m[c].items() if y == p} for c in (0, 1)]
        back = sum(min(k, d) for a in after for k in a.values()) / sum(k for a in after for k in a.values())
        both = collections.Counter([*after[0], *after[1]])
        for c in (0, 1):
            for w in both:
                part = {x: both[x] * take[c][x] / (take[0][x] + take[1][x]) for x in both}
                s = part[w] / sum(part.values())
                f = (max(after[c].get(w, 0) - d, 0) + sum(min(k, d) for k in after[c].values()) * s) / sum(after[c].values()) if after[c] else s
                assert math.isclose(rows[p, w][c], (1 - back) * f + back * uni[c][w])
            # what pairs hold and what is left to single words sums to one
            assert math.isclose(sum(rows[p, w][c] for w in both) + back * (1 - sum(uni[c][w] for w in both)), 1)


def test_passages_against_brute_force(spark):
    """Differences of the whole text and of the strongest passages, and a shorter text is its own passage."""
    model = tx.fit(spark.createDataFrame([(i, i % 7 in (3, 4, 5), SMALL[i % 7]) for i in range(70)], "doc_id long, toxic boolean, text string"), 0.4, common.shared_dir(spark))
    texts = ["y", "y " * 30, "", None, "a b c d x b c y a f", "x"]
    col = pa.array(texts, pa.large_string())
    got = model.compare(col)
    for i, t in enumerate(texts):
        d = model.differences(pa.array([t], pa.large_string()))[0]
        want = [d.mean() if len(d) else 0.0]
        for size in tx.PASSAGES:
            k = min(size, len(d))
            want.append(max(d[a : a + k].mean() for a in range(len(d) - k + 1)) if k else 0.0)
        assert np.allclose(got[i], want)
    assert got[0, 0] > 0


def test_repeats_and_several_labels(spark):
    """Rows that repeat a doc_id neither change the model nor multiply what is learnt; the largest label counts."""
    docs, labels = corpus(spark, 200)
    again = docs.unionByName(docs).unionByName(docs.where("doc_id < 40"))
    more = labels.unionByName(labels.withColumn("toxic", F.lit(0)))
    one, two = tx.train(docs, labels), tx.train(again, more)
    assert np.array_equal(one.words, two.words) and np.allclose(one.word_r, two.word_r) and np.allclose(one.slope, two.slope)
    clash = docs.withColumn("_row", F.lit(1)).withColumn("score", F.lit("x"))
    kept = tx.keep_clean(clash, labels)
    assert kept.columns == clash.columns and {r.score for r in kept.collect()} == {"x"}
    assert tx.score(clash, one).columns == ["doc_id", "text", "_row", "score"]


def test_sample_is_bounded_and_its_tables_are_whole(spark, monkeypatch):
    docs, labels = corpus(spark, 200)
    own = docs.join(labels, "doc_id").where(~tx.held_out() & F.col("text").isNotNull()).collect()
    words = {w for r in own for w in r.text.split()}
    pairs = {p for r in own for p in zip(["", *r.text.split()], r.text.split(), strict=False)}
    model = tx.train(docs, labels)
    assert len(model.words) == len(words) and len(model.pairs) == len(pairs)  # all of them, however rare
    monkeypatch.setattr(tx, "SAMPLE_BYTES", 2000)
    few = tx.train(docs, labels)
    assert 0 < len(few.pairs) <= 2 * 2000
    monkeypatch.setattr(tx, "SAMPLE_BYTES", 1)  # the first document of each class stays
    assert 0 < len(tx.train(docs, labels).words) <= 400
