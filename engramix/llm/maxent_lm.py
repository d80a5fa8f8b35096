"""A hashed maximum-entropy language model with class-factored softmax.

``P(word | history)`` is the product of three factors, of which the first two
are softmaxes over sums of feature weights:

- the word's class, given the leaf of the previous word (n-gram), that leaf with
  the class of the word before it (n-gram), and that class alone (skip);
- the word's subclass within its class, given the class, the class with that of
  the previous word, and with the previous word's leaf (n-grams);
- the word within its leaf (class and subclass), with the word as its only
  feature: the maximum-likelihood softmax is the count ratio, with one added to
  every word and to an unknown one, and is set in closed form.

The most frequent words of a class have a subclass each, so all features predict
them directly; the others share a subclass by their hashed ending. Classes and
subclasses are learnt: hashed endings are clustered by the hashed endings they
occur beside. All sizes are parameters (``Sizes``).

Two passes over the training texts gather exact sums: counts of all words, and
of endings beside endings; then class and subclass counts after histories, as
arrays of the size the parameters set. Weights are fitted by gradient steps
(scaled by curvature) that tasks compute over their part of the histories and
the driver adds up. Scoring looks up the active features of whole blocks of text
with numpy.

Counts of frequent words are sent to the tasks; how many is bounded. Occurrences
of other words meet their counts in a join, so the score of every word is exact
for vocabularies of any size.

Defined results: null text is an empty text (only its end token); rows that
repeat a doc_id are scored and learnt from each; a null doc_id is not held out;
with nothing to learn from, all classes are as likely; other columns are ignored;
an empty table gives an empty result. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words whose counts are sent to every task, at most.
FREQUENT = 1 << 19
STEPS = 12
BLOCK = 1 << 14
_GATHER = 1 << 18


@dataclass(frozen=True)
class Sizes:
    """Sizes of the model. More classes and endings suit larger corpora."""

    classes: int = 32  # class 0 holds the end token alone
    subclasses: int = 32
    singles: int = 16  # of a class's subclasses, those that hold one frequent word
    endings: int = 4096  # hashed endings
    beside: int = 128  # hashed endings before, and as many after, that describe an ending

    @property
    def leaves(self) -> int:
        return self.classes * self.subclasses


def held_out(modulus: int = 7, remainder: int = 2) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def tokens(col: pa.Array, endings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts, with an end token (hash 0, ending -1) after each: hashes, hashed endings and text bounds."""
    w = common.words(col)
    docs = len(w.docs) - 1
    total = len(w.hashes) + docs
    bounds = w.docs + np.arange(docs + 1)
    end = np.zeros(total, bool)
    end[bounds[1:] - 1] = True
    h, ending = np.zeros(total, np.uint64), np.full(total, -1, np.int64)
    h[~end] = w.hashes
    if len(w.hashes):
        a = np.frombuffer(w.norm, np.uint8)
        tail = a[w.ends - 1].astype(np.uint64)
        for back in (2, 3):
            at = w.ends - back
            tail = tail * np.uint64(257) + np.where(at >= w.starts, a[np.maximum(at, 0)], 0).astype(np.uint64)
        ending[~end] = (common.mix(tail) % np.uint64(endings)).astype(np.int64)
    return h, ending, bounds


def shifted(x: np.ndarray, bounds: np.ndarray, fill: int) -> np.ndarray:
    """x one place later within each text; ``fill`` at its start."""
    out = np.full(len(x), fill, x.dtype)
    out[1:] = x[:-1]
    out[bounds[:-1]] = fill
    return out


# ---------------------------------------------------------------- gathering


def _words(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """Word counts (h, ending, n) and blocks of counts of endings beside endings, summed per task."""

    def run(batches):
        names = ["h", "ending", "n", "block", "counts"]
        cells = np.zeros(sizes.endings * 2 * sizes.beside, np.uint64)
        held: list[tuple] = []
        size = 0

        def merged():
            h, c, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            u, at, back = np.unique(h, return_index=True, return_inverse=True)
            return u, c[at], np.bincount(back, weights=n, minlength=len(u)).astype(np.int64)

        def rows(u, c, n):
            m = len(u)
            return pa.RecordBatch.from_arrays([common.as_long(u), pa.array(c, pa.int32()), pa.array(n, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)

        for batch in batches:
            for b in common.blocks(batch, "text"):
                h, ending, bounds = tokens(b.column(0), sizes.endings)
                before = shifted(ending, bounds, -1)
                both = np.flatnonzero((ending >= 0) & (before >= 0))
                e, f, wide = ending[both], before[both], 2 * sizes.beside
                cells += np.bincount(np.concatenate([e * wide + f % sizes.beside, f * wide + sizes.beside + e % sizes.beside]), minlength=len(cells)).astype(np.uint64)
                u, at, n = np.unique(h, return_index=True, return_counts=True)
                held.append((u, ending[at].astype(np.int32), n))
                size += len(u)
                if size > 2 * _GATHER:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > _GATHER:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*merged())
        for b in common.emit_blocks(cells, BLOCK):
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), b.column(0), b.column(1)], names)

    return docs.select("text").mapInArrow(run, "h long, ending int, n long, block int, counts binary")


def clusters(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """k-means of the rows of x, begun at the heaviest rows; a number below k for each."""
    if len(x) <= k:
        return np.arange(len(x))
    centres = x[np.argsort(-weight, kind="stable")[:k]]
    at = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        at = np.argmin((centres * centres).sum(1)[None, :] - 2 * x @ centres.T, axis=1)
        mass = np.bincount(at, weights=weight, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x * weight[:, None])
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], centres)
    return at


@dataclass
class Classes:
    """The leaf (class * subclasses + subclass) of words: of single words by hash, of the others by ending."""

    sizes: Sizes
    of_ending: np.ndarray
    single: np.ndarray  # sorted hashes
    single_leaf: np.ndarray

    @staticmethod
    def learn(beside: np.ndarray, sizes: Sizes) -> Classes:
        """From counts of endings beside endings; no single words yet."""
        weight = beside.sum(1).astype(float)
        x = np.sqrt(beside / np.maximum(weight, 1.0)[:, None])
        cls = clusters(x, weight, sizes.classes - 1) + 1
        leaf = np.zeros(len(x), np.int64)
        for c in range(1, sizes.classes):
            own = np.flatnonzero(cls == c)
            if len(own):
                leaf[own] = c * sizes.subclasses + sizes.singles + clusters(x[own], weight[own], sizes.subclasses - sizes.singles)
        return Classes(sizes, leaf, np.empty(0, np.uint64), np.empty(0, np.int64))

    def leaves(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = np.where(ending >= 0, self.of_ending[ending], 0)
        if len(self.single):
            at = np.minimum(np.searchsorted(self.single, h), len(self.single) - 1)
            out = np.where((self.single[at] == h) & (ending >= 0), self.single_leaf[at], out)
        return out


def histories(leaf: np.ndarray, bounds: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Of every token: what its class is told by (leaf before, class before that) and its subclass (class, leaf before). 0 before a text."""
    one = shifted(leaf, bounds, 0)
    two = shifted(one, bounds, 0)
    return one * sizes.classes + two // sizes.subclasses, (leaf // sizes.subclasses) * sizes.leaves + one


def _outcomes(docs: DataFrame, classes: Classes) -> DataFrame:
    """(factor, block, counts): counts of classes and of subclasses after histories, summed per task."""
    sizes = classes.sizes
    sent = docs.sparkSession.sparkContext.broadcast(classes)  # of the size the parameters set

    def run(batches):
        cells = [np.zeros(sizes.leaves * sizes.classes * k, np.uint64) for k in (sizes.classes, sizes.subclasses)]
        for batch in batches:
            for b in common.blocks(batch, "text"):
                h, ending, bounds = tokens(b.column(0), sizes.endings)
                leaf = sent.value.leaves(h, ending)
                first, second = histories(leaf, bounds, sizes)
                np.add.at(cells[0], first * sizes.classes + leaf // sizes.subclasses, 1)
                np.add.at(cells[1], second * sizes.subclasses + leaf % sizes.subclasses, 1)
        for i, c in enumerate(cells):
            for b in common.emit_blocks(c, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy() + (i << 20), pa.int32()), b.column(1)], ["block", "counts"])

    return docs.select("text").mapInArrow(run, common.BLOCK_SCHEMA)


# ---------------------------------------------------------------- softmax factors


class Softmax:
    """A factor: outcomes by the sum of a weight row for each feature of a history."""

    def __init__(self, shapes: list[int], outcomes: int, kind: str, sizes: Sizes):
        self.kind, self.sizes, self.outcomes = kind, sizes, outcomes
        self.parts = [np.zeros((n, outcomes), np.float32) for n in shapes]

    @staticmethod
    def of_class(sizes: Sizes) -> Softmax:
        return Softmax([sizes.leaves, sizes.leaves * sizes.classes, sizes.classes], sizes.classes, "class", sizes)

    @staticmethod
    def of_subclass(sizes: Sizes) -> Softmax:
        return Softmax([sizes.classes, sizes.classes * sizes.classes, sizes.classes * sizes.leaves], sizes.subclasses, "subclass", sizes)

    #: Ridge of each weight table, as ordered in the shapes.
    RIDGE = (2.0, 8.0, 2.0)

    def features(self, history: np.ndarray) -> list[np.ndarray]:
        """Rows of the weight tables that are active in a history."""
        s = self.sizes
        if self.kind == "class":
            return [history // s.classes, history, history % s.classes]
        c, leaf = history // s.leaves, history % s.leaves
        return [c, c * s.classes + leaf // s.subclasses, history]

    def log_probabilities(self, history: np.ndarray) -> np.ndarray:
        x = sum(p[i] for p, i in zip(self.parts, self.features(history), strict=True))
        x = x - x.max(1, keepdims=True)
        return x - np.log(np.exp(x).sum(1, keepdims=True))

    def gradient(self, history: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each table: rows met, and gradient and curvature of the log-likelihood of outcome counts after histories."""
        p = np.exp(self.log_probabilities(history))
        n = counts.sum(1, keepdims=True)
        g, h = (counts - n * p).astype(np.float32), (n * p * (1 - p)).astype(np.float32)
        out = []
        for at in self.features(history):
            order = np.argsort(at, kind="stable")
            rows, first = np.unique(at[order], return_index=True)
            out.append((rows, np.add.reduceat(g[order], first, axis=0), np.add.reduceat(h[order], first, axis=0)))
        return out


def fit(factor: Softmax, blocks: DataFrame, steps: int = STEPS, tasks: int = 8) -> Softmax:
    """Gradient steps over the gathered counts. Data and weights are of the size the parameters set, whatever the corpus.

    Tasks hold neighbouring histories; each sends the weight rows it met.
    """
    width = factor.outcomes
    parts = blocks.repartitionByRange(tasks, "block").persist()
    sc = blocks.sparkSession.sparkContext
    try:
        for _ in range(steps):
            sent = sc.broadcast(factor)

            def run(batches, sent=sent):
                held: list[list[tuple]] = [[] for _ in sent.value.parts]
                for b in batches:
                    for i, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                        counts = common.unpack(blob).reshape(-1, width).astype(np.float64)
                        seen = np.flatnonzero(counts.sum(1))
                        for to, got in zip(held, sent.value.gradient(i * (BLOCK // width) + seen, counts[seen]), strict=True):
                            to.append(got)
                for part, got in enumerate(held):
                    if got:
                        rows, g, h = (np.concatenate([x[j] for x in got]) for j in range(3))
                        u, back = np.unique(rows, return_inverse=True)
                        sums = np.zeros((2, len(u), width), np.float32)
                        np.add.at(sums[0], back, g)
                        np.add.at(sums[1], back, h)
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([u.astype("<i4").tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], ["part", "rows", "sums"])

            total = [(np.zeros(p.shape), np.zeros(p.shape)) for p in factor.parts]
            for part, rows, sums in parts.mapInArrow(run, "part int, rows binary, sums binary").collect():  # as many rows as the weights have, and the shared ones once a task
                met = np.frombuffer(bytes(rows), "<i4")
                g, h = np.frombuffer(bytes(sums), np.float32).reshape(2, len(met), width)
                total[part][0][met] += g
                total[part][1][met] += h
            for p, ridge, (g, h) in zip(factor.parts, factor.RIDGE, total, strict=True):
                # the tables move at once, so each goes its part of the way
                p += np.clip((g - ridge * p) / (h + ridge) / len(factor.parts), -1.0, 1.0).astype(np.float32)
            sent.destroy()
    finally:
        parts.unpersist()
    return factor


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    """What scoring needs besides the counts of infrequent words."""

    classes: Classes
    of_class: np.ndarray  # log10 probabilities, a row a history
    of_subclass: np.ndarray
    inside: np.ndarray  # log10 of one over a leaf's counts, each with one added
    train: int
    types: int
    keys: np.ndarray  # hashes of frequent words, sorted
    logs: np.ndarray  # log10 of their counts plus one

    def factors(self, h: np.ndarray, ending: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of every token but for its own count plus one."""
        s = self.classes.sizes
        leaf = self.classes.leaves(h, ending)
        first, second = histories(leaf, bounds, s)
        return self.of_class[first, leaf // s.subclasses].astype(np.float64) + self.of_subclass[second, leaf % s.subclasses] + self.inside[leaf]

    def count_logs(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the counts plus one, and whether the word is among the frequent ones."""
        if not len(self.keys):
            return np.zeros(len(h)), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = self.keys[at] == h
        return np.where(known, self.logs[at], 0.0), known


def train(docs: DataFrame, folder: str, frequent: int = FREQUENT, sizes: Sizes | None = None) -> tuple[Model, DataFrame]:
    """The model of the texts of ``docs``, and (h, n) of the words that are not frequent."""
    sizes = sizes or Sizes()
    spark = docs.sparkSession
    gathered = common.save(_words(docs, sizes), f"{folder}/gathered")
    counts = common.save(gathered.where("h is not null").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")), f"{folder}/counts")
    beside = np.zeros(sizes.endings * 2 * sizes.beside, np.uint64)
    for i, blob in common.add_blocks(gathered.where("block is not null").select("block", "counts")).toLocalIterator():  # an array of the size the parameters set
        part = common.unpack(bytes(blob))
        beside[i * BLOCK : i * BLOCK + len(part)] = part
    classes = Classes.learn(beside.reshape(sizes.endings, -1), sizes)

    # the most frequent words of each class get a subclass of their own
    of = spark.createDataFrame([(e, int(leaf) // sizes.subclasses) for e, leaf in enumerate(classes.of_ending)], "ending int, cls int")
    best = F.row_number().over(Window.partitionBy("cls").orderBy(F.col("n").desc(), "h"))
    single = counts.join(F.broadcast(of), "ending").withColumn("place", best).where(F.col("place") <= sizes.singles).select("h", "cls", "place").collect()  # classes * singles rows
    hashes = np.array([r.h for r in single], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    classes.single = hashes[order]
    classes.single_leaf = np.array([r.cls * sizes.subclasses + r.place - 1 for r in single], np.int64)[order]

    blocks = common.save(common.add_blocks(_outcomes(docs, classes)), f"{folder}/blocks")
    factors = [fit(f, blocks.where((F.col("block") >= i << 20) & (F.col("block") < (i + 1) << 20)).select((F.col("block") - (i << 20)).alias("block"), "counts")) for i, f in enumerate((Softmax.of_class(sizes), Softmax.of_subclass(sizes)))]

    # counts of the leaves
    own = spark.createDataFrame([(int(h.view(np.int64)), int(leaf)) for h, leaf in zip(classes.single, classes.single_leaf, strict=True)], "h long, leaf int")
    shared = spark.createDataFrame([(-1, 0), *((e, int(leaf)) for e, leaf in enumerate(classes.of_ending))], "ending int, by_ending int")
    per_leaf = counts.join(F.broadcast(own), "h", "left").join(F.broadcast(shared), "ending").groupBy(F.coalesce("leaf", "by_ending").alias("leaf")).agg(F.sum("n"), F.count("*")).collect()  # at most as many rows as leaves
    n_of, v_of = np.zeros(sizes.leaves), np.zeros(sizes.leaves)
    for leaf, n, v in per_leaf:
        n_of[leaf], v_of[leaf] = n, v
    alone = np.arange(sizes.leaves) % sizes.subclasses < sizes.singles  # no unknown word comes there
    inside = -np.log10(np.maximum(n_of + v_of + ~alone, 1.0))

    # a count from which on words are frequent, so that they are few enough to send
    least, room = 1 << 62, frequent
    for bits, n in sorted(counts.groupBy(F.length(F.bin("n")).alias("bits")).count().collect(), reverse=True):  # at most 64 rows
        if n > room:
            break
        room -= n
        least = 1 << (bits - 1)
    head = counts.where(F.col("n") >= least).select("h", "n").toArrow()  # at most ``frequent`` rows
    keys = head.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    tables = [np.concatenate([f.log_probabilities(np.arange(a, min(a + 8192, sizes.leaves * sizes.classes))) for a in range(0, sizes.leaves * sizes.classes, 8192)]) / np.log(10) for f in factors]
    model = Model(classes, *[t.astype(np.float32) for t in tables], inside, int(n_of.sum()), int(v_of.sum()), keys[order], np.log10(head.column(1).to_numpy()[order] + 1.0))
    return model, counts.where(F.col("n") < least).select("h", "n")


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, frequent: int = FREQUENT, sizes: Sizes | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    folder = common.shared_dir(docs.sparkSession)
    own = docs.select("doc_id", "text")
    model, infrequent = train(own.where(~held_out(modulus, remainder)), folder, frequent, sizes)
    return apply(own.select("doc_id", "text", held_out(modulus, remainder).alias("held_out")), model, infrequent, folder)


def apply(docs: DataFrame, model: Model, infrequent: DataFrame, folder: str) -> DataFrame:
    """Score (doc_id, text, held_out)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ``frequent`` and the sizes

    def run(batches):
        from pyspark import TaskContext

        m = sent.value
        base_each = -np.log10(m.train + m.types + 1.0)
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "h", "times"]
        at_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for b in common.blocks(batch, "text"):
                h, ending, bounds = tokens(b.column(1), m.classes.sizes.endings)
                docs_n = b.num_rows
                log_c, known = m.count_logs(h)
                first = bounds[:-1]
                own = np.add.reduceat(log_c, first)
                factors = np.add.reduceat(m.factors(h, ending, bounds), first)
                n = np.diff(bounds)
                rows = at_row + np.arange(docs_n)
                at_row += docs_n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(np.add.reduceat(known.astype(np.int64), first), pa.int64()), pa.array(own + n * base_each), pa.array(own + factors), pa.nulls(docs_n, pa.int64()), pa.nulls(docs_n, pa.int64())],
                    names,
                )
                rare = np.flatnonzero(~known)
                if len(rare):
                    of = np.searchsorted(bounds, rare, "right") - 1
                    order = np.lexsort((h[rare], of))
                    r, d = h[rare][order], of[order]
                    new = np.ones(len(r), bool)
                    new[1:] = (r[1:] != r[:-1]) | (d[1:] != d[:-1])
                    starts = np.flatnonzero(new)
                    k = len(starts)
                    times = np.diff(np.append(starts, len(r)))
                    none = [pa.nulls(k, pa.int64()), pa.nulls(k, b.schema.field(0).type), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())]
                    none[0] = pa.array(rows[d[starts]], pa.int64())
                    yield pa.RecordBatch.from_arrays([*none, common.as_long(r[starts]), pa.array(times, pa.int64())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text", "held_out").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, h long, times long")
    scored = common.save(scored, f"{folder}/scored")
    tail = scored.where("h is not null").select("row", "h", "times").join(infrequent, "h")
    added = tail.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"), F.sum("times").alias("more"))
    out = scored.where("h is null").drop("h", "times").join(added, "row", "left")
    logs_added = F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.train).cast("long").alias("train_tokens"), (F.col("base_score") + logs_added).alias("base_score"), (F.col("score") + logs_added).alias("score"))
