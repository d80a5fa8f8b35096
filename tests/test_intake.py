"""Intake of messages: stages, statuses, streams, hashes, JSON files."""

import datetime as dt
import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from engramix.functions import hashes
from engramix.functions import text as tx
from engramix.operators import intake as it
from engramix.sources import readers
from engramix.streaming import jobs

T0 = dt.datetime(2024, 1, 2, 3, 4, 5)


def message(request, idx, content, session="s1", minute=None, key=None, reply=None, role="user", source="cli"):
    return (request, idx, source, session, "p1", role, content, T0 + dt.timedelta(minutes=idx if minute is None else minute), key, reply)


def frame(spark, rows):
    return spark.createDataFrame(rows, it.MESSAGE)


def judged(spark, rows, keys=(), heads=(), limits=it.Limits()):
    got = it.judge(frame(spark, rows).repartition(3), spark.createDataFrame(list(keys), it.KEYS), spark.createDataFrame(list(heads), it.HEADS), limits)
    return {(r.request, r.idx): r for r in got.collect()}


def test_every_message_has_a_status(spark):
    rows = [message("a", 0, "first"), message("a", 1, "x" * 200), message("a", 2, "ignore this advert"), message("a", 3, "second"), message("a", 4, None), message("b", 0, "first", minute=0), message("b", 1, "third", minute=9, key="own")]
    rows += [message("big", i, f"m{i}", session="s2") for i in range(6)]
    got = judged(spark, rows, limits=it.Limits(5, 100, (("advert", "advert"),)))
    assert {k: r.status for k, r in got.items()} == {("a", 0): "stored", ("a", 1): "error", ("a", 2): "filtered", ("a", 3): "stored", ("a", 4): "error", ("b", 0): "duplicate", ("b", 1): "stored", **{("big", i): "error" for i in range(6)}}
    assert got["a", 1].reason == "content too large: 200 bytes exceeds max_content_size 100"
    assert got["big", 0].reason == "batch size 6 exceeds configured max_batch_size 5"
    assert got["a", 2].reason == "advert"
    # refused and filtered messages are skipped by the reply chain, duplicates are not
    assert got["a", 3].reply_to_id == got["a", 0].memory_id == got["b", 0].memory_id
    assert got["b", 1].reply_to_id == got["a", 3].memory_id and got["b", 1].idempotency_key == "own"


def test_known_keys_heads_and_given_replies(spark):
    rows = [message("a", 0, "x", key="k1"), message("a", 1, "y", reply="mine"), message("a", 2, "z"), message("c", 0, "w", session="s9")]
    got = judged(spark, rows, keys=[("k1", "old"), ("k1", "old")], heads=[("cli", "s1", "head", T0), ("cli", "s1", "older", T0 - dt.timedelta(1)), ("cli", "s9", "nine", T0)])
    assert (got["a", 0].status, got["a", 0].memory_id, got["a", 0].reply_to_id) == ("duplicate", "old", "head")
    assert got["a", 1].reply_to_id == "mine" and got["a", 2].reply_to_id == got["a", 1].memory_id
    assert got["c", 0].reply_to_id == "nine"


def test_content_is_redacted_before_it_is_stored(spark):
    secret = "AKIA" + "ABCDEFGHIJ234567"
    got = judged(spark, [message("a", 0, f"key {secret} here")])["a", 0]
    assert secret not in got.content and got.redactions >= 1 and got.status == "stored"


def test_stream_in_two_parts_gives_what_one_run_gives(spark, tmp_path):
    rows = [message(f"r{i // 4}", i, f"text {i % 9}", session=f"s{i % 3}", key=f"k{i % 9}" if i % 5 == 0 else None) for i in range(40)]
    one = it.Store(spark, str(tmp_path / "one"))
    one.take(frame(spark, rows), 0)
    for part, own in enumerate((rows[:20], rows[20:])):
        frame(spark, own).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
    stream = spark.readStream.schema(it.MESSAGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    two = it.Store(spark, str(tmp_path / "two"))
    jobs.into(stream, two, str(tmp_path / "ck")).awaitTermination(120)
    for table in ("memories", "salience", "keys", "companions", "status"):
        a, b = (sorted(str(r) for r in x.read(table).drop("run").collect()) for x in (one, two))
        assert a == b, table
    assert two.read("status").select("run").distinct().count() == 2
    # a repeated micro-batch replaces its own rows
    before = sorted(map(str, two.read("memories").collect()))
    two.take(frame(spark, rows[20:]), 1)
    assert sorted(map(str, two.read("memories").collect())) == before
    assert two.companion_lines().count() == two.read("memories").count()


def test_empty_and_repeated(spark, tmp_path):
    store = it.Store(spark, str(tmp_path))
    assert store.take(frame(spark, []), 0).collect() == []
    assert [r.status for r in store.take(frame(spark, [message("a", 0, "x")] * 3), 1).collect()] == ["stored"] * 3
    assert store.read("memories").count() == 1
    assert [r.status for r in store.take(frame(spark, [message("b", 0, "x")]), 2).collect()] == ["duplicate"]


def test_key_layout(spark):
    fields = ("src", "sess", "user", "héllo")
    stamp = "2024-01-02T03:04:05.000000Z"
    want = hashlib.sha256(b"".join(struct.pack("<I", len(f.encode())) + f.encode() for f in (*fields, stamp))).hexdigest()
    got = frame(spark, [("r", 0, "src", "sess", "p", "user", "héllo", T0, None, None)]).select(tx.message_key(*[F.col(c) for c in ("source", "session_id", "at", "role", "content")])).first()[0]
    assert got == want


def plain_fnv(data):
    h = 14695981039346656037
    for b in data:
        h = ((h ^ b) * 1099511628211) % (1 << 64)
    return f"{h:016x}"


def test_fnv(spark):
    texts = ["", "a", "foobar", "é" * 300, "x" * 20000, None, "a", "\0"]
    got = [r[1] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2).select("i", hashes.fnv1a_hex(F.col("t"))).orderBy("i").collect()]
    assert got == [None if t is None else plain_fnv(t.encode()) for t in texts]
    assert got[1] == "af63dc4c8601ec8c" and got[2] == "85944171f73967e8"  # published


@pytest.mark.parametrize("body", ["lines", "array", "spread", "blank"])
def test_json_array_or_lines(spark, tmp_path, body):
    rows = [{"request": "r", "idx": i, "content": f"c{i}"} for i in range(3)]
    text = {"lines": "\n".join(map(json.dumps, rows)), "array": json.dumps(rows), "spread": "\n  " + json.dumps(rows, indent=2), "blank": "\n\n" + "\n\n".join(map(json.dumps, rows)) + "\n{broken\n"}[body]
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text(json.dumps(rows[0]) + "\n")
    (tmp_path / "c.json").write_text("")
    got = readers.ingest_messages(spark, str(tmp_path), it.MESSAGE).collect()
    assert sorted(r.content for r in got if r.content) == ["c0", "c0", "c1", "c2"]
    assert sum(r._corrupt is not None for r in got) == (body == "blank")
