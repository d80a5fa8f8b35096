"""Toxicity by class-conditional Kneser-Ney language models.

Two models, of toxic and of ordinary text, count expressions as Kneser-Ney lower
orders do: by the number of distinct contexts they were seen in, not by
occurrences, so a passage copied many times counts once. A word pair counts the
words before it, a word the words before it, and the last level, which *both*
classes share, the classes that have the word at all. An expression that was met
rarely keeps little after the discount and is told by the shared counts, which
say the same for both classes; a shared pair counts in the proportion in which a
class has its word. How much a first word leaves to backing off is
counted over both classes too, so its evenness is no evidence.

A text is scored by the difference of its two log-likelihoods, normalised by
length: over the whole text, and over the passage of 2, 4, 8 and 16 words in
which the difference is largest (a shorter text is its own passage). All words
of all texts count. A logistic curve over those differences gives the probability.

Training takes a bounded sample of labelled rows: at most ``per_class``
documents a class, by a hash of doc_id, as long as a class has no more than ``SAMPLE_BYTES`` of text (one document at least). Contexts are
counted by Spark; the tables of that sample, with all its words and pairs, come to
the driver. The curve is fitted by cross-fitting: each document is compared by
models that did not count its part of the sample, the models that stay count all
of it. Every document is scored whole.

Defined results: null and empty texts have no words and get the curve's value at
no difference; null labels are unlabelled; documents with several labels count
by the largest; rows that repeat a doc_id are scored each, and the least of
their texts is learnt; if a class has no labelled rows, no text differs and all
score the same; other columns are ignored, one named ``score`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PER_CLASS = 3000
#: Bytes of text that are learnt of a class, about.
SAMPLE_BYTES = 24 << 20
#: Parts of the sample in cross-fitting.
FOLDS = 3
#: Contexts taken off every count.
DISCOUNT = 0.75
#: Words in the passages compared, besides the whole text.
PASSAGES = (2, 4, 8, 16)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def _grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of a block of texts: the hash, that of the word before (0 at the start), and the texts' bounds."""
    w = common.words(col, common.ALNUM)
    h = w.hashes
    return h, _before(h, w.docs), w.docs


def _before(h: np.ndarray, docs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), np.uint64)
    if len(h):
        out[1:] = h[:-1]
        out[docs[:-1][docs[:-1] < len(h)]] = 0
    return out


def _pair_key(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    return common.mix(prev * _PAIR + word)


def _look(keys: np.ndarray, values: np.ndarray, h: np.ndarray, other) -> np.ndarray:
    """values of h's keys, ``other`` where there is none."""
    if not len(keys):
        return np.zeros(len(h)) + other
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], other)


@dataclass
class Model:
    """Tables by sorted hash keys of log10 ratios, toxic over ordinary."""

    words: np.ndarray
    word_r: np.ndarray  # of the probabilities of a word
    unknown_r: float  # of a word in neither class
    pairs: np.ndarray
    pair_r: np.ndarray  # of the probabilities of the pair's second word after the first
    slope: np.ndarray  # logistic weights: constant, whole text, passages

    def differences(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """log10 of toxic over ordinary probability of every word after the one before it, and the texts' bounds."""
        h, prev, docs = _grams(col)
        # an unseen pair backs off with the same weight in both classes, so the word's ratio stays
        return _look(self.pairs, self.pair_r, _pair_key(prev, h), _look(self.words, self.word_r, h, self.unknown_r)).astype(np.float64), docs

    def compare(self, col: pa.Array) -> np.ndarray:
        """Per text: difference of the log-likelihoods a word, of the text and of its strongest passages."""
        d, docs = self.differences(col)
        out = np.zeros((len(docs) - 1, 1 + len(PASSAGES)))
        own = np.flatnonzero(np.diff(docs))
        if not len(own):
            return out
        first, n = docs[own], np.diff(docs)[own]
        total = np.concatenate([[0.0], np.cumsum(d)])
        mean = (total[first + n] - total[first]) / n
        out[own, 0] = mean
        last = np.repeat(docs[own + 1], n)  # where each word's text ends
        for j, size in enumerate(PASSAGES, 1):
            ends = np.arange(len(d)) + size
            inside = ends <= last
            s = np.where(inside, total[np.minimum(ends, len(d))] - total[:-1], -np.inf)
            out[own, j] = np.where(n >= size, np.maximum.reduceat(s, first) / size, mean)
        return out

    def score(self, col: pa.Array) -> np.ndarray:
        x = self.compare(col)
        return 1 / (1 + np.exp(-np.clip(self.slope[0] + x @ self.slope[1:], -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Logistic regression by damped Newton steps with a small ridge on scaled features; classes weigh by ``share``, that of toxic rows."""
    scale = np.maximum(x.std(0), 1e-9)
    a = np.column_stack([np.ones(len(x)), x / scale])
    pull = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    b = np.zeros(a.shape[1])
    ridge = np.diag([0.01, *[0.5] * x.shape[1]])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-6) * pull
        step = np.linalg.solve((a * w[:, None]).T @ a + ridge, a.T @ ((y - p) * pull) - ridge @ b)
        b += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return np.array([b[0], *(b[1:] / scale)])


# ---------------------------------------------------------------- counting


def contexts(texts: DataFrame) -> DataFrame:
    """(prev, word, m0, m1) from (toxic, text): in how many contexts each pair occurs in ordinary and in toxic text."""

    def run(batches):
        for batch in batches:
            for b in common.blocks(batch, "text"):
                h, prev, docs = _grams(b.column(1))
                toxic = np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(docs))
                yield pa.RecordBatch.from_arrays([pa.array(toxic), common.as_long(_before(prev, docs)), common.as_long(prev), common.as_long(h)], ["toxic", "earlier", "prev", "word"])

    seen = texts.select("toxic", "text").mapInArrow(run, "toxic boolean, earlier long, prev long, word long").distinct()
    return seen.groupBy("prev", "word").agg(F.count_if(~F.col("toxic")).alias("m0"), F.count_if("toxic").alias("m1"))


def word_probabilities(pairs: DataFrame) -> tuple[DataFrame, float, float]:
    """(word, n, p0, p1, r1): a word's probabilities in ordinary and toxic text, and how far it is toxic text's; and the probabilities of any unknown word.

    r1 is the toxic share of what the word takes of either class's pair contexts (one added to each).
    """
    words = pairs.groupBy("word").agg(F.count_if(F.col("m0") > 0).alias("n0"), F.count_if(F.col("m1") > 0).alias("n1"), F.sum("m0").alias("k0"), F.sum("m1").alias("k1"))
    classes = (F.col("n0") > 0).cast("int") + (F.col("n1") > 0).cast("int")
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("double") for x in ("n0", "n1", F.least("n0", F.lit(DISCOUNT)), F.least("n1", F.lit(DISCOUNT)), classes, F.col("k0") + 1, F.col("k1") + 1)]
    n0, n1, taken0, taken1, shared, all0, all1 = words.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    back0, back1 = (taken / n if n else 1.0 for taken, n in ((taken0, n0), (taken1, n1)))
    unknown = 1 / (shared + 1)

    def p(count: str, total: float, back: float) -> F.Column:
        return F.greatest(F.col(count) - DISCOUNT, F.lit(0.0)) / max(1.0, total) + back * classes * unknown

    take0, take1 = (F.col("k0") + 1) / max(1.0, all0), (F.col("k1") + 1) / max(1.0, all1)
    return words.select("word", (F.col("n0") + F.col("n1")).alias("n"), p("n0", n0, back0).alias("p0"), p("n1", n1, back1).alias("p1"), (take1 / (take0 + take1)).alias("r1")), back0 * unknown, back1 * unknown


def pair_probabilities(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(prev, word, n, q0, q1): probabilities of word after prev, for all pairs seen.

    What the discount takes goes to the pairs that either class has after prev,
    each in the proportion in which the class has the word.
    """
    rows = pairs.join(words.select("word", "p0", "p1", "r1"), "word")
    classes = (F.col("m0") > 0).cast("int") + (F.col("m1") > 0).cast("int")
    rows = rows.withColumn("s0", classes * (1 - F.col("r1"))).withColumn("s1", classes * F.col("r1"))
    least = [F.least(F.col(m), F.lit(DISCOUNT)) for m in ("m0", "m1")]
    of = rows.groupBy("prev").agg(F.sum("m0").alias("a0"), F.sum("m1").alias("a1"), F.sum(least[0]).alias("t0"), F.sum(least[1]).alias("t1"), F.sum("s0").alias("all0"), F.sum("s1").alias("all1"))
    rows = rows.join(of, "prev")
    back = (F.col("t0") + F.col("t1")) / (F.col("a0") + F.col("a1"))

    def p(c: int) -> F.Column:
        m, a, t, s, word = F.col(f"m{c}"), F.col(f"a{c}"), F.col(f"t{c}"), F.col(f"s{c}") / F.col(f"all{c}"), F.col(f"p{c}")
        after = F.when(a > 0, (F.greatest(m - DISCOUNT, F.lit(0.0)) + t * s) / a).otherwise(s)
        return (1 - back) * after + back * word

    return rows.select("prev", "word", (F.col("m0") + F.col("m1")).alias("n"), p(0).alias("q0"), p(1).alias("q1"))


def _table(rows: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Key columns and ratios (last) of all entries. Bounded by the sample."""
    *keys, ratio = rows.columns
    got = rows.select(*keys, F.col(ratio).cast("float")).toArrow()
    return [got.column(i).to_numpy().view(np.uint64) for i in range(len(keys))], got.column(len(keys)).to_numpy()


def _count(texts: DataFrame, folder: str) -> Model:
    """Tables of (toxic, text), without a curve."""
    pairs = common.save(contexts(texts), f"{folder}/pairs")
    words, unknown0, unknown1 = word_probabilities(pairs)
    words = common.save(words, f"{folder}/words")
    (word,), word_r = _table(words.select("word", F.log10(F.col("p1") / F.col("p0")).alias("r")))
    (first, second), pair_r = _table(pair_probabilities(pairs, words).select("prev", "word", F.log10(F.col("q1") / F.col("q0")).alias("r")))
    key = _pair_key(first, second)
    by_word, by_pair = np.argsort(word), np.argsort(key)
    return Model(word[by_word], word_r[by_word], float(np.log10(unknown1 / unknown0)), key[by_pair], pair_r[by_pair], np.zeros(2 + len(PASSAGES)))


def _compared(texts: DataFrame, model: Model) -> np.ndarray:
    """A row for each of (toxic, text): its class and its comparisons."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    names = [f"x{j}" for j in range(1 + len(PASSAGES))]

    def run(batches):
        for batch in batches:
            for b in common.blocks(batch, "text"):
                x = shared.value.compare(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, j]) for j in range(x.shape[1])]], ["toxic", *names])

    got = texts.select("toxic", "text").mapInArrow(run, ", ".join(["toxic boolean", *[f"{n} double" for n in names]])).toArrow()  # a part of the sample, numbers only
    shared.unpersist()
    return np.column_stack([got.column(j).to_numpy().astype(float) for j in range(1 + len(names))]) if got.num_rows else np.empty((0, 1 + len(names)))


def fit(texts: DataFrame, share: float, folder: str) -> Model:
    """Model of (doc_id, toxic, text). ``share``: that of toxic rows among all labelled."""
    part = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(FOLDS))
    rows = np.concatenate([_compared(texts.where(part == i), _count(texts.where(part != i), f"{folder}/part{i}")) for i in range(FOLDS)])
    model = _count(texts, f"{folder}/all")
    if len(rows):
        model.slope = _logistic(rows[:, 1:], rows[:, 0], share)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled documents that are not held out, at most ``per_class`` a class."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out())
    order = F.xxhash64(F.lit(11), "doc_id")
    known = own.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    # one class alone teaches nothing
    n = per_class if min(known) else 1
    chosen = own.where("toxic > 0").orderBy(order, "doc_id").limit(n).union(own.where("toxic <= 0").orderBy(order, "doc_id").limit(n))
    # chosen: at most 2 * per_class narrow rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    folder = common.shared_dir(docs.sparkSession)
    texts = common.save(rows.groupBy("doc_id", (F.col("toxic") > 0).alias("toxic")).agg(F.min("text").alias("text")), f"{folder}/sampled")
    lengths = texts.select("doc_id", "toxic", F.octet_length("text").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = lengths.select("doc_id", (before + F.col("n") <= SAMPLE_BYTES).alias("fits"), (before == 0).alias("first")).where("fits or first").select("doc_id")
    texts = common.save(texts.join(F.broadcast(within), "doc_id"), f"{folder}/texts")
    model = fit(texts, known[0] / max(1, sum(known)), folder)
    common.drop(docs.sparkSession, folder)
    common.trim()  # of the driver: the parts' models are gone
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``score`` added: 0 to 1, higher: toxic likelier. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "score"])
    names = docs.columns

    def run(batches):
        common.trim()
        m = shared.value
        for batch in batches:
            for b in common.blocks(batch, text):
                s = m.score(b.column(b.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*names, "score"])

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{carried}, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs that do not score as toxic, columns unchanged."""
    model = train(docs, labels, per_class)
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return score(wrapped, model).where("score < 0.5").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
