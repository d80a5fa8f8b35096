"""The corpus pipeline: every stage against a brute-force version on the rows its predecessor kept, and the chain."""

import collections
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from engramix.llm import queries


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """1000 documents (the classifier needs some hundred labels): ordinary, toxic, near copies, benchmark passages, and odd rows."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(30))) for i in range(6)]
    rows, labels = [], []
    for i in range(920):
        w = words(rng.randint(20, 60))
        toxic = i % 5 == 0
        if toxic:
            for bad in ("vile", "filth", "rotten"):
                w.insert(rng.randrange(len(w)), bad)
        rows.append((i, " ".join(w), "en", ("a", "b", "c", None)[i % 4], len(w)))
        if i % 10 < 8:
            labels.append((i, 1, int(toxic)))
    base = words(120)
    for i in range(30):  # near copies: one word in a hundred and twenty is another
        copy = list(base)
        copy[i] = f"other{i}"
        rows.append((1400 + i, " ".join(copy), "en", "a", 0))
    for i in range(12):
        w = words(50)
        w[10:10] = items[i % 6][1].split()[3:20]
        rows.append((1500 + i, " ".join(w), "en", "b", 0))
    rows += [(1600, None, None, None, None), (1601, "", "en", "a", 0), (1602, " \t", "en", "b", 0), (1603, "short", "en", "c", 5), (1604, " ".join(words(5000)), "en", "c", 0), (None, " ".join(words(40)), "en", "a", 0)]
    rows += [(1605, " ".join(base[60:] + base[:60]), "en", "a", 0)] * 2
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs.collect())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs.collect())
    return out


def key(r):
    return str(r.doc_id), r.text


def test_toxic_go_and_clean_stay(stages):
    before, after = stages[0], stages[1]
    bad = {r.doc_id for r in before if r.text and "vile" in r.text}
    kept = {r.doc_id for r in after}
    assert len(bad & kept) <= 0.05 * len(bad) and len({r.doc_id for r in before} - bad - kept) <= 4
    assert after[0].__fields__ == before[0].__fields__


def test_one_of_each_group_of_near_copies_stays(stages, words):
    before, after = stages[1], stages[2]
    sets = []
    for r in before:
        w = words(r.text)
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(before)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(before):
        groups[root(i) if sets[i] else -1 - i].append(r)
    want = sorted((str(min(r.doc_id for r in g)) if g[0].doc_id is not None else "None") for g in groups.values())
    assert sorted(str(r.doc_id) for r in after) == want and len(after) < len(before)
    assert {key(r) for r in after} <= {key(r) for r in before}


def test_contaminated_go(spark, sf_dir, stages, plain_words):
    before, after = stages[2], stages[3]
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = plain_words(r.text)
        windows |= {tuple(w[j : j + 13]) for j in range(len(w) - 12)}
    want = []
    for r in before:
        w, hit = plain_words(r.text), set()
        for j in range(len(w) - 12):
            if tuple(w[j : j + 13]) in windows:
                hit |= set(range(j, j + 13))
        if not hit or 20 * len(hit) < len(w):
            want.append(key(r))
    assert sorted(want, key=str) == sorted(map(key, after), key=str) and len(after) < len(before)


def test_sources_meet_their_targets(stages, words):
    before, after = stages[3], stages[4]
    size = collections.Counter()
    for r in before:
        size[r.source] += len(words(r.text))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(size), float(sum(size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 3 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = 3 * size[s]
            left -= target[s]
        free -= full
    taken, times = collections.Counter(), collections.Counter(map(key, after))
    for r in after:
        taken[r.source] += len(words(r.text))
    longest = max(len(words(r.text)) for r in before)
    assert all(abs(taken[s] - target[s]) <= longest for s in size)
    rows = collections.Counter(map(key, before))
    assert set(times) <= set(rows) and all(n <= 3 * rows[k] for k, n in times.items()) and max(times.values()) > 1


def test_token_files_hold_every_row(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for r in stages[4]:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((str(r.doc_id), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = stages[5]
    assert sorted(want) == sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_run_is_the_chain(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(str, got)) == sorted(map(str, stages[5]))
