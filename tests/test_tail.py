"""Files that grow, shrink and change while they are followed."""

import json

import pytest

from engramix.sources import tail
from engramix.streaming import jobs


def line(text):
    return json.dumps({"message": {"role": "user", "content": text}, "timestamp": "2024-01-01T00:00:00Z"}) + "\n"


class Follower:
    def __init__(self, spark, tmp_path, start="start", **options):
        self.spark, self.logs, self.out, self.ck = spark, tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "ck")
        self.start, self.options = start, options
        self.logs.mkdir(exist_ok=True)

    def run(self):
        """A query that starts from the checkpoint, takes what is there and ends."""
        rows = tail.follow(self.spark, [str(self.logs)], self.start, **self.options)
        jobs.into(rows, jobs.append_once(self.out), self.ck).awaitTermination(60)
        return sorted(r.value for r in self.spark.read.parquet(self.out).collect())


def test_grows_shrinks_and_restarts(spark, tmp_path):
    f = Follower(spark, tmp_path)
    a = f.logs / "a.jsonl"
    a.write_bytes(b"one\ntwo\r\n\n  \nhalf of thr")
    assert f.run() == ["one", "two"]
    with a.open("ab") as w:  # the line that was open is closed
        w.write(b"ee\nfour\n")
    (f.logs / "deep").mkdir()
    (f.logs / "deep" / "b.jsonl").write_bytes(b"b1\n")
    (f.logs / "other.txt").write_bytes(b"no\n")
    assert f.run() == ["b1", "four", "half of three", "one", "two"]
    assert f.run() == ["b1", "four", "half of three", "one", "two"]
    a.write_bytes(b"new\n")  # truncated
    assert f.run() == ["b1", "four", "half of three", "new", "one", "two"]
    (f.logs / "deep" / "b.jsonl").write_bytes(b"c1\nc2\nc3\n")  # replaced by a longer one
    assert f.run() == ["b1", "c1", "c2", "c3", "four", "half of three", "new", "one", "two"]
    a.unlink()
    assert len(f.run()) == 9
    a.write_bytes(b"new\n")  # gone and back
    assert f.run().count("new") == 2


def test_between_micro_batches(spark, tmp_path):
    """One running query sees what is appended and cut between its batches."""
    f = Follower(spark, tmp_path)
    a = f.logs / "a.jsonl"
    a.write_bytes(b"one\n")
    q = tail.follow(spark, [str(f.logs)]).writeStream.foreachBatch(jobs.append_once(f.out)).option("checkpointLocation", f.ck).trigger(processingTime="200 milliseconds").start()
    try:
        q.processAllAvailable()
        with a.open("ab") as w:
            w.write(b"two\nthr")
        q.processAllAvailable()
        a.write_bytes(b"x\n")
        q.processAllAvailable()
    finally:
        q.stop()
    with a.open("ab") as w:
        w.write(b"y\n")
    assert f.run() == ["one", "two", "x", "y"]


def test_from_the_end(spark, tmp_path):
    f = Follower(spark, tmp_path, start="end")
    (f.logs / "a.jsonl").write_bytes(b"old\n")
    q = tail.follow(spark, [str(f.logs)], "end").writeStream.foreachBatch(jobs.append_once(f.out)).option("checkpointLocation", f.ck).trigger(processingTime="200 milliseconds").start()
    try:
        q.processAllAvailable()
        with (f.logs / "a.jsonl").open("ab") as w:
            w.write(b"fresh\n")
        (f.logs / "b.jsonl").write_bytes(b"whole\n")
        q.processAllAvailable()
    finally:
        q.stop()
    assert f.run() == ["fresh", "whole"]


def test_parsers_are_those_of_the_batch_readers(spark, tmp_path):
    f = Follower(spark, tmp_path)
    (f.logs / "a.jsonl").write_text(line("one") + "broken\n" + line("two"))
    jobs.into(tail.follow_logs(spark, [str(f.logs), str(tmp_path / "missing")]), jobs.append_once(f.out), f.ck).awaitTermination(60)
    assert sorted((r.role, r.content, r.parser) for r in spark.read.parquet(f.out).collect()) == [("user", "one", "assistant"), ("user", "two", "assistant")]


@pytest.mark.parametrize("most", [1, 2, 7, 64, 1000])
def test_ranges_hold_each_line_once(tmp_path, most):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"".join(b"%d" % i * (i % 9) + b"\n" for i in range(60)) + b"open")
    want = path.read_bytes()[:-4].split(b"\n")[:-1]
    got = [x for p in tail.TailReader({"path": str(tmp_path), "maxPartitionBytes": str(most)}).partitions({}, {str(path): tail.position(str(path), path.stat().st_size)}) for x in tail.lines(p)]
    assert [x for _, x in got] == want
    assert all(path.read_bytes()[at : at + len(x)] == x for at, x in got)


def test_long_first_part_without_a_line_break(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"x" * (3 << 20))
    assert tail.position(str(path), path.stat().st_size) is None
    with path.open("ab") as w:
        w.write(b"\n" + b"y" * (2 << 20))
    at = tail.position(str(path), path.stat().st_size)
    assert at["at"] == (3 << 20) + 1
    assert [len(x) for _, x in tail.lines(tail.Range(str(path), 0, 0, at["at"]))] == [3 << 20]
