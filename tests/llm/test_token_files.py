import zlib

import numpy as np
import pytest

from engramix.llm import common, queries
from engramix.llm import token_files as tf


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    ph = tf.PerfectHash.build(keys)
    assert sorted(ph.slots(keys).tolist()) == list(range(len(keys)))
    again, _ = tf.PerfectHash.load(ph.dump(), 0)
    assert (again.slots(keys) == ph.slots(keys)).all()
    assert tf.PerfectHash.build(keys[:0]).n == 0
    with pytest.raises(ValueError, match="distinct"):
        tf.PerfectHash.build(np.array([5, 5], np.uint64))


@pytest.mark.parametrize("memory", [1 << 21, 50])
def test_encoder_equals_the_tokenizer(tokenizer, memory, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tf, "MEMORY", memory)
    texts = ["", None, "Hello, World. It's fine... don't", "a.b,c 1.5 x'll.", "<|endoftext|> tail.<|endoftext|>,x", "naïve été  Σίσυφος é. ok", "日本語, テスト。", " lead", "trail ", "\n\n", "x" * 500, "I'LL. we've,'s"]
    ids, n = tf.Encoder(queries.tokenizer_path()).encode(pa.array(texts), 1)
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_round_trip(spark, docs, tokenizer, tmp_path):
    folder = common.shared_dir(spark)
    manifest = tf.write(docs, folder, queries.tokenizer_path())
    got = tf.read(spark, folder, manifest, docs.select("doc_id")).collect()
    rows = [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(d), len(i), crc(i)) for d, i in rows) == sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    wanted = spark.createDataFrame([(301,), (300,), (999,), (-7,), (None,)], "doc_id long")
    found = {r.doc_id: list(r.ids) for r in tf.lookup(spark, folder, manifest, wanted).collect()}
    by = {}
    for d, i in rows:
        by.setdefault(d, []).extend(i)
    assert found == {d: by[d] for d in (301, 300, -7)}


def test_empty(spark, no_docs):
    folder = common.shared_dir(spark)
    assert tf.read(spark, folder, tf.write(no_docs, folder, queries.tokenizer_path()), no_docs.select("doc_id")).collect() == []


def test_index_holds_no_keys():
    """Absent keys are rejected by fingerprint, and the file is a few bytes a key besides its slots."""
    keys = np.arange(0, 20000, 2)
    lengths = np.arange(1, 10001)
    data = tf.ShardIndex.dump(keys, np.ones(10000, bool), lengths, 2)
    assert len(data) < 10000 * (tf._SLOT.itemsize + 1) and keys[:500].astype("<i8").tobytes() not in data
    index = tf.ShardIndex(data)
    found, offset, ids, rows = index.find(keys)
    assert found.all() and (offset == np.cumsum(lengths) - lengths).all() and (ids == lengths).all() and (rows == 1).all()
    assert index.find(np.arange(1, 20000, 2))[0].sum() <= 2


def test_other_tokenizers_encode_whole_texts(docs):
    """A tokenizer that joins white space to words gives the library's ids too."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    enc = tf.Encoder(path)
    assert not enc.by_piece and tf.Encoder(queries.tokenizer_path()).by_piece
    texts = [r.text for r in docs.collect()]
    ids, n = enc.encode(pa.array(texts, pa.large_string()), 1)
    want = [[*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]


def test_repeats_across_shards(spark, tokenizer, monkeypatch):
    """Rows of one key in several shards, rows without a key, and asking for some keys only."""
    monkeypatch.setattr(tf, "LEAST_SHARD_BYTES", 64)
    rows = [(5, f"text {i}") for i in range(60)] + [(i, f"own {i} " * (i % 7)) for i in range(6, 40)] + [(None, f"none {i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = common.shared_dir(spark)
    manifest = tf.write(docs, folder, queries.tokenizer_path())
    assert manifest.count() == 4
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    got = tf.read(spark, folder, manifest, docs.select("doc_id")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(d), size(t)) for d, t in rows)
    assert len({r.start for r in got}) == len(rows)
    some = tf.read(spark, folder, manifest, docs.select("doc_id").where("doc_id in (5, 9)")).collect()
    assert sorted(r.doc_id for r in some) == [5] * 60 + [9]
