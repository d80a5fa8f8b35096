"""Licences, chats, nearest neighbours and archives."""

import base64
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from engramix.llm import chat, common, licenses, vectors, warc


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (2, "a/b/x.txt", "some prose\nthat says nothing"),
        (3, "a/b/y.txt", "prose\nReleased under the MIT License.\nmore"),
        (4, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (5, "a/b/c/d/z.txt", "prose"),
        (6, "top.txt", "a licence is a fine thing to have and to talk about at length, say the people who do"),
        (7, None, None),
        (8, "a/b/c/d/z2.txt", ""),
        (9, "ab/x", "prose"),
    ]
    got = {r.file_id: (r.licence, r.origin, r.from_dir) for r in licenses.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got == {
        1: ("Apache-2.0", "file", None),
        2: ("Apache-2.0", "inherited", "a"),
        3: ("MIT", "header", None),
        4: ("GPL-3.0", "file", None),
        5: ("GPL-3.0", "inherited", "a/b/c"),
        6: (None, "none", None),
        7: (None, "none", None),
        8: ("GPL-3.0", "inherited", "a/b/c"),
        9: (None, "none", None),
    }
    assert licenses.scan(spark.createDataFrame([], "file_id long, path string, text string")).collect() == []


def test_licenses_need_no_python(spark):
    rows = spark.createDataFrame([(1, "a/LICENSE", "MIT License")], "file_id long, path string, text string")
    plan = licenses.scan(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chats(spark):
    def conv(c, *turns):
        return [(c, i, role, text) for i, (role, text) in enumerate(turns)]

    a, b, d = ("user", "hi"), ("assistant", "yo <|im_end|>"), ("user", "more")
    rows = conv(1, a, b) + conv(2, a, b, d) + conv(3, a, b, d) + conv(4, a) + conv(5, b, a) + conv(6, ("user", None)) + conv(7, ("user", "")) + [(None, 0, "user", "x")]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {c: (r.n_turns, r.copies) for c, r in out.items()} == {2: (3, 2), 5: (2, 1), 6: (1, 1), 7: (1, 1)}
    assert out[2].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo < |im_end|><|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16))
    x[5:40] = x[5]  # copies: ties go to smaller ids
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None]), (2004, [1.0]), (None, [1.0] * 16)]
    table = vectors.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = {}
    for r in vectors.search(table, table.where("id % 20 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(m[2] - s[m[1]]) < 1e-9 for m in mine)
        hit += len({m[1] for m in mine} & set(best.tolist()))
    assert hit / 450 >= 0.9
    assert vectors.search(table.limit(0), table.limit(0)).collect() == []


def test_nearest_ranks_what_is_posted():
    """Footrule distances from the files equal those from the definition, and only the nearest pivots' files list an entry."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    longest = (x * x).sum(1).max()
    p = np.column_stack([x[:40], np.sqrt(longest - (x[:40] ** 2).sum(1))])
    index = vectors.Index.load(vectors.Index.build(x, [np.array([i]) for i in range(300)], p, longest, 12).dump())
    assert len(index.posts) == 300 * 12
    order = np.argsort(-(x @ p[:, :-1].T + np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None] * p[:, -1]), axis=1, kind="stable")[:, :12]
    for q in x[:5]:
        own = np.argsort(-(p[:, :-1] @ q), kind="stable")[:6].tolist()
        foot = [sum(abs((o.tolist().index(j) if j in o else 12) - i) for i, j in enumerate(own)) for o in order]
        limit = sorted(foot)[29]
        assert index.candidates(q, 30, 12, 6).tolist() == [i for i, f in enumerate(foot) if f <= limit]


def test_nearest_odd_rows(spark, monkeypatch):
    """Vectors of another length than most, ids with several vectors, columns of clashing names, many shards and blocks."""
    monkeypatch.setattr(vectors, "SHARD_ROWS", 100)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    rows = [(i, [float(v) for v in r], 1.0, "a") for i, r in enumerate(x)] + [(900, [1.0], 0.0, "b"), (901, [2.0] * 9, 0.0, "c"), (20, [9.0] * 8, 0.0, "d"), (40, [float(v) for v in x[40]], 0.0, "e")]
    table = vectors.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, v string"))
    out = vectors.search(table, table.where("id % 20 = 0"), 5).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    assert sorted(got) == list(range(0, 400, 20)) and out
    hit = 0
    for q, found in got.items():
        own = min(r[1] for r in rows if r[0] == q)
        s = {}
        for i, v, *_ in rows:
            if i != q and len(v) == 8:
                s[i] = max(s.get(i, -np.inf), float(np.dot(v, own)))
        best = sorted(s, key=lambda i: (-s[i], i))[:5]
        assert sorted(r for r, _, _ in found) == [1, 2, 3, 4, 5] and all(abs(x - s[i]) < 1e-8 for _, i, x in found)
        hit += len(set(best) & {i for _, i, _ in found})
    assert hit / 100 >= 0.9
    assert sorted(out) == sorted(vectors.search(table.repartition(5), table.where("id % 20 = 0"), 5).collect())


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(50), rng.random()) for _ in range(rng.randrange(30))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_archive(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 2)
    rows = [(i, f"https://Host{i % 3}.example.org/p?q={i}#f", f"<p>{i % 5}</p>" if i % 4 else "") for i in range(40)]
    rows += [(50, None, None), (51, "no-scheme/é", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    _, out = warc.archive(spark, pages, common.shared_dir(spark))
    got = {r.page_id: r for r in out.collect()}
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault((h or "").encode(), i)
    for i, _, h in rows:
        data, r = (h or "").encode(), got[i]
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first[data] == i else ("revisit", first[data]))
    order = [(r.url_key, r.stamp) for r in sorted(got.values(), key=lambda r: (r.range_no, r.seq))]
    assert order == sorted(order) and len(order) == 42
    empty = warc.archive(spark, pages.limit(0), common.shared_dir(spark))[1]
    assert empty.collect() == []


def test_url_keys():
    assert warc.url_key("http://user@www.Example.org:80/A?b#c") == "org,example,www)/a?b"
    assert warc.url_key("https://example.org") == "org,example)/"
    assert warc.url_key(None) == ""


def test_components(spark):
    from engramix.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), common.shared_dir(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "u long, v long"), common.shared_dir(spark)).where(F.col("node").isNotNull()).collect() == []
