import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engramix.llm import common
from engramix.llm import maxent_lm as lm


@pytest.mark.parametrize("frequent", [1 << 20, 20])
def test_counts_and_base(docs, words, frequent):
    rows = [(r.doc_id, [*words(r.text), "\n"]) for r in docs.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = collections.Counter(w for d, t in rows if not held(d) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for d, t in rows)
    out = lm.score(docs, frequent=frequent).collect()
    assert want == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out)
    assert all(r.score <= 0 for r in out)


SMALL = lm.Sizes(classes=4, subclasses=6, singles=3, endings=32, beside=8)


def by_word(docs, words):
    """For every word its hash, ending and count, by the operator's own hashing of single words."""
    count = collections.Counter(w for r in docs.collect() for w in words(r.text))
    vocab = sorted(count)
    h, ending, _ = lm.tokens(pa.array(vocab, pa.large_string()), SMALL.endings)
    return {w: (h[2 * i], ending[2 * i], count[w]) for i, w in enumerate(vocab)}


def leaf_of(model, h, ending):
    return int(model.classes.leaves(np.array([h], np.uint64), np.array([ending]))[0])


def test_score_against_brute_force(spark, docs, words):
    """The model's factors, word by word in plain Python from its tables and the texts' counts."""
    folder = common.shared_dir(spark)
    model, infrequent = lm.train(docs.select("doc_id", "text"), folder, 20, SMALL)
    known = by_word(docs, words)
    end = docs.count()
    s = SMALL
    leaf = {w: leaf_of(model, h, e) for w, (h, e, _) in known.items()} | {"": 0}
    assert len({leaf[w] for w in known}) > 8 and sum(x % s.subclasses < s.singles for w, x in leaf.items() if w) >= 6
    total, types = collections.Counter({0: end}), collections.Counter({0: 1})
    for w, (_, _, n) in known.items():
        total[leaf[w]] += n
        types[leaf[w]] += 1
    rows = docs.select("doc_id", "text").distinct().where("length(text) < 3000 or text is null")
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.apply(rows.withColumn("held_out", F.lit(False)), model, infrequent, folder).collect()}
    for r in rows.collect():
        text, want, one, two = [*words(r.text), ""], 0.0, 0, 0
        for w in text:
            x = leaf[w]
            c = x // s.subclasses
            want += float(model.of_class[one * s.classes + two // s.subclasses][c]) + float(model.of_subclass[c * s.leaves + one][x % s.subclasses])
            single = x % s.subclasses < s.singles
            want += math.log10(((known[w][2] if w else end) + 1) / (total[x] + types[x] + (not single)))
            one, two = x, one
        assert math.isclose(got[r.doc_id, len(text)], want, rel_tol=1e-6, abs_tol=1e-6)


def test_sums_to_one_over_the_vocabulary(spark, docs, words):
    """After any history the probabilities of all words, the end and an unknown word in each shared leaf sum to one."""
    model, _ = lm.train(docs.select("doc_id", "text"), common.shared_dir(spark), 1 << 20, SMALL)
    known, s = by_word(docs, words), SMALL
    leaf = {w: leaf_of(model, h, e) for w, (h, e, _) in known.items()}
    assert model.types == len(known) + 1
    for one, two in ((0, 0), (leaf["alpha"], 0), (leaf["end"], leaf["gamma,"]), (leaf["w3"], leaf["w4"])):
        class_p = 10 ** model.of_class[one * s.classes + two // s.subclasses].astype(float)
        p = {x: class_p[x // s.subclasses] * 10 ** float(model.of_subclass[(x // s.subclasses) * s.leaves + one][x % s.subclasses]) * 10 ** model.inside[x] for x in range(s.leaves)}
        mass = collections.Counter()
        for w, (_, _, n) in known.items():
            mass[leaf[w]] += p[leaf[w]] * (n + 1)
        mass[0] += p[0] * (docs.count() + 1)
        for x in range(s.leaves):
            if x % s.subclasses >= s.singles:
                mass[x] += p[x]  # its unknown word
        used = {x for x in mass if mass[x] > 0}
        idle = sum(p[x] / 10 ** model.inside[x] for x in range(s.leaves) if x not in used)  # leaves without any word keep what the softmax gives them
        assert abs(sum(mass.values()) + idle - 1) < 1e-5


def test_gradient_is_the_likelihoods(spark):
    """Gradients against finite differences of the log-likelihood."""
    rng = np.random.default_rng(1)
    for factor, n in ((lm.Softmax.of_class(SMALL), SMALL.leaves * SMALL.classes), (lm.Softmax.of_subclass(SMALL), SMALL.leaves * SMALL.classes)):
        factor.parts = [rng.normal(size=p.shape) for p in factor.parts]
        hist = rng.choice(n, 9, replace=False)
        counts = rng.integers(0, 5, (9, factor.outcomes)).astype(float)
        for part, (rows, g, _) in enumerate(factor.gradient(hist, counts)):
            at = factor.parts[part]
            for r, c in ((rows[0], 0), (rows[-1], 2)):
                at[r, c] += 1e-6
                up = (counts * factor.log_probabilities(hist)).sum()
                at[r, c] -= 2e-6
                down = (counts * factor.log_probabilities(hist)).sum()
                at[r, c] += 1e-6
                assert abs((up - down) / 2e-6 - g[list(rows).index(r), c]) < 1e-3


def test_learns_what_follows(spark):
    """Held-out texts in which words determine the next ones gain over the base, and shuffled ones lose against them."""
    rng = random.Random(2)
    pairs = [(f"a{i}ta", f"b{i}go") for i in range(20)]

    def text():
        return " ".join(w for _ in range(40) for w in rng.choice(pairs))

    rows = spark.createDataFrame([(i, text()) for i in range(120)], "doc_id long, text string")
    odd = rows.select((F.col("doc_id") + 1000).alias("doc_id"), F.concat_ws(" ", F.sort_array(F.split("text", " "))).alias("text"))
    model, infrequent = lm.train(rows, common.shared_dir(spark))
    out = lm.apply(rows.union(odd).withColumn("held_out", F.lit(False)), model, infrequent, common.shared_dir(spark))
    got = out.groupBy((F.col("doc_id") >= 1000).alias("odd")).agg((F.sum("score") / F.sum("n_tokens")).alias("s"), (F.sum("base_score") / F.sum("n_tokens")).alias("b")).orderBy("odd").collect()
    assert got[0].s > got[0].b + 0.5 and got[0].s > got[1].s + 0.3


def test_empty(no_docs):
    assert lm.score(no_docs).collect() == []


def test_clashing_columns(docs):
    out = lm.score(docs.withColumn("h", F.lit(1)).withColumn("row", F.lit("x")).withColumn("held_out", F.lit(None).cast("string")), sizes=SMALL)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and out.count() == docs.count()
