"""Sentence boundaries, chunks, topics and spans against rule-by-rule versions."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engramix.functions import sentences as se


def breaks(text):
    """Boundaries by trying every rule at every place."""
    k = se._LED.sub(lambda m: "Z" * len(m[0]), "".join(map(se.kind, text)))
    keep = [i for i, c in enumerate(k) if c != "X"]
    k = [k[i] for i in keep]
    out = []
    for i in range(1, len(k)):
        if k[i - 1] == "R" and k[i] == "F":
            continue
        if k[i - 1] in "RFE":
            out.append(keep[i])
            continue
        if k[i - 1] == "A" and k[i] == "N":
            continue
        if i > 1 and k[i - 2] in "UL" and k[i - 1] == "A" and k[i] == "U":
            continue
        j, spaces = i - 1, False
        while j >= 0 and k[j] == "P":
            j, spaces = j - 1, True
        while j >= 0 and k[j] == "C":
            j -= 1
        if j < 0 or k[j] not in "AS":
            continue
        if k[j] == "A":
            m = i
            while m < len(k) and k[m] not in "OULRFEAS":
                m += 1
            if m < len(k) and k[m] == "L":
                continue
        if k[i] in "TAS" or k[i] in "PRFE" or (k[i] == "C" and not spaces):
            continue
        out.append(keep[i])
    at = [0, *out, len(text)]
    return [(a, b) for a, b in zip(at, at[1:], strict=False) if any(c.isalnum() for c in text[a:b])]


TEXTS = [
    "He paid 3.5 dollars, e.g. for tea. Then left.",
    'She said "Go!" (twice.) And left... so it goes. U.S.A. is here. Ok?!  Yes',
    "one\ntwo\r\nthree\n\nfour.\nFive",
    "Ça va. Été. 日本語。次の文。 end",
    "a.b.c " * 3000 + ".", "!!!!??? ...", "", "   ", "no end", "x" * 5000, "A. B. c. D", "é. Áb", "́. A", "1. 2. Three 4.5.6", "a.)\" B", "a. (3) b", "a. (3) B", "Hi: there; you - ok. , no. Yes",
]


def test_stated_case():
    assert se.sentences(TEXTS[0]) == ["He paid 3.5 dollars, e.g. for tea. ", "Then left."]


@pytest.mark.parametrize("text", TEXTS)
def test_rules(text):
    assert se.spans(text) == breaks(text)


def test_random_texts():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b", "A", "B", "日", "1", ".", ".", "!", ")", '"', " ", " ", "\n", "\r", ",", "́", "*"]) for _ in range(rng.randint(0, 30)))
        assert se.spans(text) == breaks(text), repr(text)


def plain_chunks(parts, size, overlap):
    out, open_ = [], []
    for i, p in enumerate(parts):
        if open_ and sum(len(parts[j].encode()) for j in open_) + len(p.encode()) > size:
            out.append(open_)
            open_ = open_[len(open_) - overlap :] if overlap else []
        open_ = [*open_, i]
    out += [open_] if open_ else []
    return out if len(out) > 1 else []


@pytest.mark.parametrize(("size", "overlap"), [(10, 0), (30, 1), (30, 2), (5, 3), (1000, 1)])
def test_chunks(size, overlap):
    rng = random.Random(size)
    for _ in range(200):
        parts = ["é" * rng.randint(1, 12) + ". " for _ in range(rng.randint(0, 15))]
        assert [list(range(a, b)) for a, b in se.chunk_sentences(parts, size, min(overlap, 2))] == plain_chunks(parts, size, min(overlap, 2))


def test_chunks_of_texts(spark):
    text = "Été one is here. " * 40 + "Last one."
    rows = spark.createDataFrame([("a", text), ("b", "Short. Text."), ("c", None), ("d", ""), ("e", "no stop " * 500)], "id string, content string")
    got = rows.select("id", F.posexplode_outer(se.chunks(F.col("content"), 100, 1, 50)).alias("i", "c")).collect()
    a = [r.c for r in got if r.id == "a"]
    raw = text.encode()
    assert all(raw[c.start : c.end].decode() == c.chunk and len(c.chunk.encode()) <= 100 for c in a)
    assert a[0].start == 0 and a[-1].end == len(raw) and all(x.end > y.start for x, y in zip(a, a[1:], strict=False))
    assert a[1].header == f'[From: "Été one is here.", part 2/{len(a)}]\n' and {c.total for c in a} == {len(a)}
    assert {r.id: r.c for r in got if r.id != "a"} == {"b": None, "c": None, "d": None, "e": None}  # what fits one chunk gives none


def test_topics(spark):
    texts = ["Version 3.5 is out, e.g. here. More", "é" * 80 + ". b", "", "?!", None, "a\nb", "w " * 4000 + "end. B"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(se.topic(F.col("t"))).collect()]
    assert got == ["Version 3.5 is out, e.g. here.", "é" * 28 + "...", "", "", None, "a", ("w " * 29)[:57] + "..."]


def test_best_span(spark):
    text = "".join(f"Filler {i} about nothing at all. " for i in range(40)) + "The licence of public software grants rights. Distribution of software is free. " + "".join(f"Other {i} words follow now. " for i in range(40))
    r = spark.createDataFrame([(text,), ("Licence of software. " * 100,), ("short licence",), (None,), ("",)], "t string").select(se.span(F.col("t"), "public software licence", size=200).alias("s")).collect()
    assert b"licence of public software" in text.encode()[r[0].s.start : r[0].s.end]
    assert (r[1].s.start, r[1].s.end) == (0, 189)  # of equal spans the first
    assert (r[2].s.start, r[2].s.end) == (0, 13) and r[3].s is None and (r[4].s.start, r[4].s.end, r[4].s.similarity) == (0, 0, 0.0)
    # by hand
    wanted = se.hashed_features(["public software licence"])[0]
    cos = [float(se.hashed_features([c["chunk"]])[0] @ wanted / np.linalg.norm(se.hashed_features([c["chunk"]])) / np.linalg.norm(wanted)) for c in se.chunks_of(text, 200)]
    assert r[0].s.similarity == pytest.approx(max(cos), abs=1e-9)


def test_runs_of_texts_give_what_single_texts_give():
    texts = pa.array(["x" * 100, None, "", "é" * 80, "z"] * 50)
    kind = pa.int64()
    assert se._each_run(texts, kind, len, 128, 3).to_pylist() == [None if t is None else len(t) for t in texts.to_pylist()]
    assert se._each_run(texts.slice(7, 20), kind, len, 128, 3).to_pylist() == [None if t is None else len(t) for t in texts.to_pylist()[7:27]]
    assert se._each_run(texts.slice(0, 0), kind, len).to_pylist() == []


def test_few_texts_are_objects_at_a_time():
    kinds = pa.list_(pa.struct([("chunk", pa.string())]))
    texts = pa.array(["abc " * 5000] * 500)
    tracemalloc.start()
    se._each_run(texts, kinds, lambda t: [{"chunk": t[a : a + 2000]} for a in range(0, len(t), 2000)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3e6  # of texts of 10 MB


def test_chunks_leave_in_small_batches():
    texts = ["One sentence. " * 2000, None, "", "Short.", *["Two are here. Two! " * 400] * 100]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "content"])
    out = list(se.chunk_batches(iter([batch]), 2048, 1, 0))
    assert len(out) > 2 and all(b.nbytes < 1 << 20 for b in out)
    got = [(r["id"], r["place"], r["chunk"]) for b in out for r in b.to_pylist()]
    assert got == [(i, c["place"], c["chunk"]) for i, t in enumerate(texts) if t for c in se.chunks_of(t, 2048, 1, 0)]
