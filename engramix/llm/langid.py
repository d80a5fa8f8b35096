"""Language identification by interpolated Kneser-Ney character models.

Every language has a model of its own over lower-case letters, where a run of
anything else is one space. The highest order counts occurrences; each lower
order counts in how many different places (after how many different characters)
a sequence occurs. Each level takes an absolute discount, estimated from its
sequences seen once and twice, and gives it to the level below, down to an even
share over the alphabet of all languages and one unknown character.

A model is kept as sorted arrays of 64-bit hashes: sequences with their finished
probability, contexts with the share they leave to the level below. A text gets,
for each language, the cross-entropy a character; the lowest wins, ties go to the
language that is smaller as a string. Whole texts are read; of a block of texts each distinct
sequence is looked up once.

Calibration: a third of the sample is kept out of the counts. A logistic curve
over the margin to the second language and the length gives the probability that
the choice is right (``score``). A text is ``rejected`` where its cross-entropy,
less its language's usual one, times the root of its length, exceeds all but
``REJECTED`` of the kept-out texts of that language (twice the largest, where
those are too few to tell), or where the score is below one half. The best language is still named.

Bounds: a model learns from about ``PER_LANG`` documents a language (chosen by a
hash of doc_id at a rate that the language's count sets) and of the ``LANGUAGES``
most frequent languages. Sequences are counted by Spark; the finished tables of
that sample come to the driver and go to the tasks.

Defined results: a null text, one without letters, and any text if no language
was learnt gets ``und``, score 0 and is rejected; null languages and rows without
doc_id are not learnt; an empty text of a language teaches nothing; with one
language that is named; repeated rows are learnt and told each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import _logistic, held_out

#: Characters in the longest sequences.
ORDER = 4
#: Documents learnt of each language, about, and languages, the most frequent ones. Bounds of the sample.
PER_LANG = 900
LANGUAGES = 400
#: Share of the kept-out texts of a language that may lie beyond the rejection bound.
REJECTED = 0.002
UNDETERMINED = "und"
_SPACE = 0x20
_STEP = [pow(0x9E3779B97F4A7C15 | 3, j, 1 << 64) for j in range(64)]


@cache
def letters() -> np.ndarray:
    """Of every code point: its lower-case letter, a space where it is no letter."""
    to = np.full(0x110000, _SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            to[i] = ord(low) if len(low) == 1 else i
    return to


def _points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string column and the texts' bounds."""
    data, off = common.utf8(col)
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        texts = [np.frombuffer(raw[a:b].decode(errors="replace").encode("utf-32-le"), np.uint32) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return points, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]


@dataclass
class Grams:
    """The distinct sequences of a block of texts: hashes of their ends and contexts, and where they stand."""

    ends: list[np.ndarray]  # of the last 1, 2, ... ORDER characters
    contexts: list[np.ndarray]  # of the 1, 2, ... ORDER - 1 characters before the last
    which: np.ndarray  # of every character, the sequence that it ends
    docs: np.ndarray  # len(texts) + 1 bounds among the characters


def grams(col: pa.Array, order: int = ORDER) -> Grams:
    points, off = _points(col)
    a = letters()[points]
    space = a == _SPACE
    after = np.ones(len(a), bool)
    after[1:] = space[:-1]
    after[off[:-1][off[:-1] < len(a)]] = True  # a text begins as after a space
    keep = ~(space & after)
    at = np.concatenate([[0], np.cumsum(keep)])
    docs = at[off]
    a = a[keep]
    n = len(docs) - 1
    # every text is led by as many spaces as the longest context needs
    place = np.arange(len(a)) + np.repeat(np.arange(1, n + 1), np.diff(docs)) * (order - 1)
    led = np.full(len(a) + n * (order - 1), _SPACE, np.uint64)
    led[place] = a

    def hashed(where: np.ndarray, size: int) -> np.ndarray:
        h = np.full(len(where), size, np.uint64)
        for j in range(size):
            h += led[where - j] * np.uint64(_STEP[j + 1])
        return common.mix(h)

    _, first, which = np.unique(hashed(place, order), return_index=True, return_inverse=True)
    own = place[first]
    return Grams([hashed(own, k) for k in range(1, order + 1)], [hashed(own - 1, k) for k in range(1, order)], which, docs)


# ---------------------------------------------------------------- the model


@dataclass
class Language:
    """Sorted hashes with log10 values, by level."""

    name: str
    unknown: float
    ends: list[tuple[np.ndarray, np.ndarray]]  # log10 probability of a sequence's last character
    left: list[tuple[np.ndarray, np.ndarray]]  # log10 share that a context leaves to the level below
    usual: float = 0.0
    bound: float = np.inf

    def log10(self, g: Grams) -> np.ndarray:
        """Of every distinct sequence, the log10 probability of its last character."""
        out = _found(self.ends[0], g.ends[0], self.unknown)
        for k in range(1, len(self.ends)):
            lower = out + _found(self.left[k - 1], g.contexts[k - 1], 0.0)
            out = _found(self.ends[k], g.ends[k], lower)
        return out


def _found(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, other) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.zeros(len(h)) + other
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], other)


@dataclass
class Model:
    languages: list[Language]
    order: int = ORDER
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def entropies(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character in bits, texts by languages, and the texts' characters."""
        g = grams(col, self.order)
        size = np.diff(g.docs)
        out = np.zeros((len(size), len(self.languages)))
        some = np.flatnonzero(size)
        if len(some):
            for j, lang in enumerate(self.languages):
                out[some, j] = np.add.reduceat(lang.log10(g)[g.which], g.docs[some]) / size[some] / -np.log10(2)
        return out, size

    def choose(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every text: best language, its cross-entropy, the margin to the next, and the characters."""
        h, size = self.entropies(col)
        best = h.argmin(1)
        least = h[np.arange(len(h)), best]
        rest = h.copy()
        rest[np.arange(len(h)), best] = np.inf
        margin = np.where(h.shape[1] > 1, rest.min(1) - least, 0.0)
        return best, least, margin, size

    def tell(self, col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of every text."""
        if not self.languages:
            return pa.array([UNDETERMINED] * len(col)), np.zeros(len(col)), np.ones(len(col), bool)
        best, least, margin, size = self.choose(col)
        score = 1 / (1 + np.exp(-np.clip(self.curve[0] + features(margin, size) @ self.curve[1:], -35, 35)))
        usual, bound = (np.array([getattr(x, name) for x in self.languages])[best] for name in ("usual", "bound"))
        empty = size == 0
        score[empty] = 0.0
        rejected = empty | (score < 0.5) | ((least - usual) * np.sqrt(size) > bound)
        names = np.array([x.name for x in self.languages], object)[best]
        names[empty] = UNDETERMINED
        return pa.array(names, pa.string()), score, rejected


def features(margin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.column_stack([margin, np.log1p(margin * size), np.log1p(size)])


# ---------------------------------------------------------------- counting


def count(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, n, e1.., c1..) from (lang int, text): how often each sequence occurs in each language."""
    names = ["lang", "n", *[f"e{k}" for k in range(1, order + 1)], *[f"c{k}" for k in range(1, order)]]

    def run(batches):
        for batch in batches:
            for b in common.blocks(batch, "text"):
                lang = b.column(0).to_numpy(zero_copy_only=False)
                for one in np.unique(lang):
                    g = grams(b.column(1).filter(pa.array(lang == one)), order)
                    n = np.bincount(g.which, minlength=len(g.ends[0]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), one), pa.int32()), pa.array(n, pa.int64()), *map(common.as_long, g.ends), *map(common.as_long, g.contexts)], names)

    seen = texts.select("lang", "text").mapInArrow(run, ", ".join(["lang int", *[f"{n} long" for n in names[1:]]]))
    return seen.groupBy("lang", *names[2:]).agg(F.sum("n").alias("n"))


def levels(counted: DataFrame, folder: str, order: int = ORDER) -> tuple[dict[int, float], list[DataFrame], list[DataFrame]]:
    """Log10 of an unknown character by language, and by level (lang, key, p) of sequences and (lang, key, p) of contexts."""
    alphabet = counted.select("e1").distinct().count() + 1
    sequences, left, below, unknown = [], [], None, {}
    for k in range(1, order + 1):
        own = [F.col("lang"), F.col(f"e{k}").alias("key"), (F.col(f"c{k - 1}") if k > 1 else F.lit(0).cast("long")).alias("context"), (F.col(f"e{k - 1}") if k > 1 else F.lit(0).cast("long")).alias("lower")]
        if k == order:
            rows = counted.select(*own, F.col("n").alias("n"))
        else:
            rows = counted.select(*own, F.col(f"e{k + 1}").alias("longer")).distinct().groupBy("lang", "key", "context", "lower").agg(F.count("*").alias("n"))
        rows = common.save(rows, f"{folder}/counts{k}")
        # of sequences seen once and twice; a row a language, of which there are LANGUAGES at most
        once = rows.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
        off = once.select("lang", F.when((F.col("once") > 0) & (F.col("twice") > 0), F.col("once") / (F.col("once") + 2 * F.col("twice"))).otherwise(0.75).alias("off"))
        of = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(F.broadcast(off), "lang").withColumn("back", F.col("off") * F.col("kinds") / F.col("total"))
        of = common.save(of, f"{folder}/contexts{k}")
        rows = rows.join(of, ["lang", "context"])
        if k == 1:
            lower = F.lit(1.0 / alphabet)
            unknown = {r.lang: float(np.log10(r.back / alphabet)) for r in of.select("lang", "back").collect()}  # a row a language
        else:
            rows = rows.join(below.select("lang", F.col("key").alias("lower"), F.col("p").alias("_p")), ["lang", "lower"])
            lower = F.col("_p")
            left.append(of.select("lang", F.col("context").alias("key"), F.col("back").alias("p")))
        below = common.save(rows.select("lang", "key", ((F.col("n") - F.col("off")) / F.col("total") + F.col("back") * lower).alias("p")), f"{folder}/level{k}")
        sequences.append(below)
    return unknown, sequences, left


def _arrays(rows: DataFrame, languages: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes and log10 values of each language. Bounded by the sample."""
    got = rows.select("lang", "key", F.log10("p").cast("float").alias("p")).toArrow()
    lang, key, p = got.column(0).to_numpy(), got.column(1).to_numpy().view(np.uint64), got.column(2).to_numpy()
    by = np.lexsort((key, lang))
    ends = np.searchsorted(lang[by], np.arange(languages + 1))
    return [(key[by][a:b], p[by][a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def train(docs: DataFrame, order: int = ORDER, per_lang: int = PER_LANG, languages: int = LANGUAGES) -> Model:
    """Learn from documents that are not held out."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    most = own.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(languages).collect()
    most.sort(key=lambda r: r["lang"])
    if not most:
        return Model([], order)
    folder = common.shared_dir(spark)
    rate = spark.createDataFrame([(r["lang"], i, per_lang / r["count"]) for i, r in enumerate(most)], "lang string, number int, rate double")
    chance = F.pmod(F.xxhash64(F.lit(13), F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    texts = own.join(F.broadcast(rate), "lang").where(chance < F.col("rate")).select("doc_id", F.col("number").alias("lang"), "text")
    texts = common.save(texts, f"{folder}/texts")
    check = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id").cast("string")), F.lit(3)) == 0
    counted = common.save(count(texts.where(~check), order), f"{folder}/grams")
    unknown, sequences, left = levels(counted, folder, order)
    ends, shares = [_arrays(x, len(most)) for x in sequences], [_arrays(x, len(most)) for x in left]
    # a language none of whose texts was counted has no model
    learnt = [i for i in range(len(most)) if i in unknown]
    model = Model([Language(most[i]["lang"], unknown[i], [x[i] for x in ends], [x[i] for x in shares]) for i in learnt], order)
    if learnt:
        _calibrate(model, texts.where(check), {i: j for j, i in enumerate(learnt)})
    common.drop(spark, folder)
    return model


def _calibrate(model: Model, texts: DataFrame, place: dict[int, int]) -> None:
    shared = texts.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        for batch in batches:
            for b in common.blocks(batch, "text"):
                best, least, margin, size = shared.value.choose(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int32()), pa.array(least), pa.array(margin), pa.array(size, pa.int64())], ["lang", "best", "least", "margin", "size"])

    got = texts.select("lang", "text").mapInArrow(run, "lang int, best int, least double, margin double, size long").toArrow()  # numbers of a third of the sample
    lang, best, least, margin, size = (got.column(i).to_numpy() for i in range(5))
    some = size > 0
    lang, best, least, margin, size = np.array([place.get(i, -1) for i in lang.tolist()], np.int64)[some], best[some], least[some], margin[some], size[some]
    right = (lang == best).astype(float)
    if len(right):
        model.curve = _logistic(features(margin, size), right, float(right.mean()))
    for j, x in enumerate(model.languages):
        own = (lang == j) & (best == j)
        if own.any():
            x.usual = float(np.average(least[own], weights=size[own]))
            beyond = np.sort((least[own] - x.usual) * np.sqrt(size[own]))
            at = int(np.ceil((len(beyond) + 1) * (1 - REJECTED)))
            # too few texts tell no such bound: then twice the largest is one
            x.bound = float(beyond[at - 1]) if at <= len(beyond) else 2 * max(float(beyond[-1]), 1.0)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``lang_pred``, ``score`` and ``rejected`` added (such columns are replaced). No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")])
    names = docs.columns

    def run(batches):
        common.trim()
        for batch in batches:
            for b in common.blocks(batch, text):
                lang, score, rejected = shared.value.tell(b.column(b.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([*b.columns, lang, pa.array(score), pa.array(rejected)], [*names, "lang_pred", "score", "rejected"])

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{carried}, lang_pred string, score double, rejected boolean")
