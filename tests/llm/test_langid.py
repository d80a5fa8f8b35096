import math
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from engramix.llm import common, langid


def normal(text):
    out = [" "]
    for c in text:
        low = c.lower() if c.isalpha() else " "
        c = (low if len(low) == 1 else c) if c.isalpha() else " "
        if c != " " or out[-1] != " ":
            out.append(c)
    return "".join(out[1:])


class Brute:
    """Interpolated Kneser-Ney over characters with dictionaries."""

    def __init__(self, texts, order, alphabet):
        self.order, self.alphabet = order, alphabet
        self.n = [None] * (order + 1)
        top = Counter()
        for t in texts:
            led = " " * (order - 1) + normal(t)
            top.update(led[i - order + 1 : i + 1] for i in range(order - 1, len(led)))
        self.n[order] = top
        types = set(top)
        for k in range(order - 1, 0, -1):
            types = {g[-k - 1 :] for g in types}
            self.n[k] = Counter(g[1:] for g in types)
        self.off, self.of = [None], [None]
        for k in range(1, order + 1):
            one, two = (sum(c == x for c in self.n[k].values()) for x in (1, 2))
            self.off.append(one / (one + 2 * two) if one and two else 0.75)
            of = defaultdict(lambda: [0, 0])
            for g, c in self.n[k].items():
                of[g[:-1]][0] += c
                of[g[:-1]][1] += 1
            self.of.append(of)

    def p(self, g, k=None):
        k = self.order if k is None else k
        if k == 0:
            return 1 / self.alphabet
        g = g[-k:]
        lower = self.p(g, k - 1)
        if g[:-1] not in self.of[k]:
            return lower
        total, kinds = self.of[k][g[:-1]]
        return max(self.n[k][g] - self.off[k], 0) / total + self.off[k] * kinds / total * lower

    def bits(self, text):
        led = " " * (self.order - 1) + normal(text)
        at = range(self.order - 1, len(led))
        return -sum(math.log2(self.p(led[i - self.order + 1 : i + 1])) for i in at) / len(at)


TEXTS = {
    "aa": ["the cat sat on the mat. The end", "this thing, that thing: those things", "the other  THE"],
    "bb": ["der Hund läuft über die Straße", "und die Katze, ß und ß, ÄÖ", "die das der"],
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(1, t) for t in TEXTS["bb"]] + [(0, t) for t in TEXTS["aa"]]
    folder = common.shared_dir(spark)
    counted = common.save(langid.count(spark.createDataFrame(rows, "lang int, text string").repartition(3), 3), f"{folder}/grams")
    unknown, sequences, left = langid.levels(counted, folder, 3)
    ends, shares = [langid._arrays(x, 2) for x in sequences], [langid._arrays(x, 2) for x in left]
    return langid.Model([langid.Language(n, unknown[i], [x[i] for x in ends], [x[i] for x in shares]) for i, n in enumerate(["aa", "bb"])], 3)


def test_entropies_against_brute_force(model):
    alphabet = len({c for ts in TEXTS.values() for t in ts for c in normal(t)}) + 1
    want = [Brute(TEXTS[n], 3, alphabet) for n in ("aa", "bb")]
    asked = ["the hat", "x", "die Katze sitzt", "Ωμέγα the", "  Überall", "a" * 500]
    h, size = model.entropies(pa.array([*asked, None, "", "12 34!"]))
    assert size.tolist() == [len(normal(t)) for t in asked] + [0, 0, 0]
    for i, t in enumerate(asked):
        assert [b.bits(t) for b in want] == pytest.approx(h[i].tolist(), abs=1e-5)
    for b in want:
        letters = {c for ts in TEXTS.values() for t in ts for c in normal(t)}
        assert sum(b.p("th" + c) for c in letters) + b.p("th?") == pytest.approx(1)


def words(rng, stems, n):
    return " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(n))


@pytest.fixture(scope="module")
def told(spark):
    import random

    rng = random.Random(1)
    stems = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ein", "ung", "ber"], "zz": ["ция", "про", "ность", "ко"]}
    rows = [(i, words(rng, stems[x], rng.randint(3, 60)) + ".", x, "src", 1.0) for i, x in enumerate(rng.choice(["xx", "xx", "yy", "zz"]) for _ in range(500))]
    rows += [(900, None, "xx", "s", 0.0), (901, "", "yy", "s", 0.0), (902, "123 ?! 4", "zz", "s", 0.0), (903, "kalo" * 40000, "xx", "s", 0.0), (904, "einung berein", None, None, 0.0), (None, "kalo mitu", "yy", "s", 0.0), (5, "kalo mitu lolo", "xx", "s", 0.0), (905, "qwq ŵŷŵ jjj " * 40, None, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(3)
    return docs, {(r.doc_id, r.text): r for r in langid.identify(docs, langid.train(docs)).collect()}, rows


def test_tells_languages(told):
    docs, got, rows = told
    assert len(got) == len(rows)
    held = [r for r in rows[:500] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and all(got[r[0], r[1]].lang_pred == r[2] for r in held)
    assert sum(got[r[0], r[1]].rejected for r in held) <= 0.05 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[904, "einung berein"].lang_pred == "yy"
    assert got[None, "kalo mitu"].lang_pred == "xx"
    assert got[903, "kalo" * 40000].lang_pred == "xx"
    assert got[905, "qwq ŵŷŵ jjj " * 40].rejected  # of no learnt language
    for i, t in ((900, None), (901, ""), (902, "123 ?! 4")):
        assert (got[i, t].lang_pred, got[i, t].score, got[i, t].rejected) == ("und", 0.0, True)


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "kalo mitu" if zlib.crc32(str(i).encode()) % 5 else "schein", "xx" if zlib.crc32(str(i).encode()) % 5 else "yy") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()} == {"xx"}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "kalo", None), (2, "mitu", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score, r.rejected) for r in langid.identify(docs, langid.train(docs)).collect()} == {("und", 0.0, True)}
    assert langid.identify(docs.limit(0), langid.train(docs.limit(0))).collect() == []


def test_bad_bytes():
    raw = pa.array([b"abc\xff\xfedef", b"", b"xyz"], pa.binary())
    points, off = langid._points(raw)
    assert len(points) == off[-1] and off.tolist()[1:] == [8, 8, 11]
