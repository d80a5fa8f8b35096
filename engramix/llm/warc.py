"""WARC archives of captured pages and their global capture index.

Writing: every task turns its pages into one gzip-per-record WARC file and one
*run*: the index lines of its captures, sorted by URL key and timestamp. A page
whose payload equals that of a page with a smaller id becomes a revisit record
that refers to it.

Merging: runs are merged by loser trees into globally ordered capture
histories. The key space is cut at keys sampled from the runs; each task merges
one range of it from all runs, reading only that range of each run. Where there
are more runs than a tree should hold, groups of runs are merged to longer runs
first. Runs and indexes are files in a folder all executors share.

Reading: the merged index leads back to the records, file by file in order.

Defined results: null html is an empty payload; null url sorts first, as an empty
key; rows without page_id are written (and never referred to if others have
one); rows that repeat a page_id are captures each, ordered by their place; all
empty payloads are equal; an empty table gives no files; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_files import _place, _store

#: Runs one loser tree merges at most.
FAN_IN = 64
#: Keys sampled from a run at most, at even distances.
SAMPLES = 1024
#: Captures are dated from here, a second a page id.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then the path, in lower case."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)(?::\d+)?(.*)", url or "", re.S)
    host, rest = m.group(1), m.group(2).split("#")[0]
    return (",".join(reversed(host.lower().split("."))) + ")" + (rest.lower() or "/")).replace("\n", "%0A").replace("\t", "%09") if url else ""


def timestamp(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y%m%d%H%M%S")


# ---------------------------------------------------------------- records


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit of an identical payload (headers only)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    date = datetime.strptime(timestamp(page_id), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    target = re.sub(r"[\r\n]", "", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:engramix:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    body = http + payload
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:engramix:page:{refers_to}>"]
        body = http
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one (unzipped) record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- loser tree


class LoserTree:
    """Merges sorted iterators: inner nodes keep the losers, the root the winner."""

    def __init__(self, sources: list[Iterator]):
        self.k = max(1, len(sources))
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        self.tree = [-1] * self.k
        for i in range(len(sources)):
            self._enter(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x, a) < (y, b)

    def _enter(self, i: int) -> None:
        """First fill: wait in an empty node, else play upwards."""
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        if not self.sources:
            return
        while self.heads[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.heads[i]
            self.heads[i] = next(self.sources[i], None)
            node = (i + self.k) // 2
            while node > 0:
                if self._beats(self.tree[node], i):
                    self.tree[node], i = i, self.tree[node]
                node //= 2
            self.tree[0] = i


# ---------------------------------------------------------------- runs


def _line(key: str, stamp: str, place: str, entry: dict) -> str:
    return "\t".join((key, stamp, place, json.dumps(entry)))


def _sort_key(line: str) -> tuple:
    return tuple(line.split("\t", 3)[:3])


def _write_run(store, path: str, lines: Iterator[str]) -> list[tuple[str, int]]:
    """Write sorted lines; return at most SAMPLES keys, evenly spaced, with their byte offsets."""
    samples, at, every = [], 0, 16
    with store.open_output_stream(path, compression=None) as f:
        chunk = []
        for n, line in enumerate(lines):
            if n % every == 0:
                samples.append(("\t".join(_sort_key(line)), at))
                if len(samples) == SAMPLES:
                    samples, every = samples[::2], 2 * every
            data = (line + "\n").encode()
            at += len(data)
            chunk.append(data)
            if len(chunk) == 4096:
                f.write(b"".join(chunk))
                chunk = []
        f.write(b"".join(chunk))
    return samples


def _read_run(store, path: str, offset: int, lo: tuple | None, hi: tuple | None, piece: int = 1 << 18) -> Iterator[tuple]:
    """(sort key, line) from lo on, up to before hi."""
    with store.open_input_file(path) as f:
        f.seek(offset)
        rest = b""
        while True:
            data = f.read(piece)
            lines = (rest + data).split(b"\n")
            rest = lines.pop()
            for raw in lines:
                line = raw.decode()
                key = _sort_key(line)
                if lo is not None and key < lo:
                    continue
                if hi is not None and key >= hi:
                    return
                yield key, line
            if not data:
                return


_RUN = "run string, lines long, keys array<string>, offsets array<long>"


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives and sorted runs; a row a run."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("d", F.unhex(F.sha1("html")))
    first = own.groupBy("d").agg(F.min("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("d", "response")
    joined = own.join(first, "d", "left").select("page_id", "url", "html", "d", "response")

    def run(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        no = ctx.partitionId()
        store, root = _store(folder)
        tmp = f"{root}/tmp-{no:05d}-{ctx.taskAttemptId()}"
        out, at, lines = None, 0, []
        for batch in batches:
            out = out or store.open_output_stream(f"{tmp}.warc.gz", compression=None)
            for page, url, html, d, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload, digest = html.encode(), base64.b32encode(d).decode()
                response_here = response is None or page == response
                data = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = data.compress(record(page, url, payload, digest, None if response_here else response)) + data.flush()
                out.write(raw)
                lines.append(_line(url_key(url), timestamp(page), f"{(page or 0) + (1 << 63):020d}-{no:05d}-{at:012d}", {"page": page, "digest": digest, "file": f"part-{no:05d}.warc.gz", "offset": at, "length": len(raw)}))
                at += len(raw)
        if out is None:
            return
        out.close()
        lines.sort(key=_sort_key)
        samples = _write_run(store, f"{tmp}.run", iter(lines))
        _place(store, f"{tmp}.warc.gz", f"{root}/part-{no:05d}.warc.gz")
        _place(store, f"{tmp}.run", f"{root}/run-{no:05d}.idx")
        yield pa.RecordBatch.from_arrays([pa.array([f"run-{no:05d}.idx"]), pa.array([len(lines)], pa.int64()), pa.array([[s[0] for s in samples]]), pa.array([[s[1] for s in samples]])], ["run", "lines", "keys", "offsets"])

    return common.save(joined.mapInArrow(run, _RUN), f"{folder}/runs0")


def _merge_groups(runs: DataFrame, folder: str, level: int) -> DataFrame:
    """One pass: every FAN_IN runs become one longer run."""
    place = (F.row_number().over(Window.orderBy("run")) - 1).cast("long")  # one row a run
    grouped = runs.withColumn("g", F.floor(place / FAN_IN).cast("long")).groupBy("g").agg(F.sort_array(F.collect_list("run")).alias("runs"))  # FAN_IN names each

    def run(batches):
        from pyspark import TaskContext

        store, root = _store(folder)
        for batch in batches:
            for g, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"run-{level}-{g:05d}.idx"
                tmp = f"{root}/tmp-{name}-{TaskContext.get().taskAttemptId()}"
                n = 0

                def lines(names=names):
                    nonlocal n
                    for _, line in LoserTree([_read_run(store, f"{root}/{x}", 0, None, None) for x in names]):
                        n += 1
                        yield line

                samples = _write_run(store, tmp, lines())
                _place(store, tmp, f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([[s[0] for s in samples]]), pa.array([[s[1] for s in samples]])], ["run", "lines", "keys", "offsets"])

    return common.save(grouped.repartition("g").mapInArrow(run, _RUN), f"{folder}/runs{level}")


def merge(runs: DataFrame, folder: str, ranges: int | None = None) -> DataFrame:
    """All captures in global order: range_no, seq, url_key, stamp, page_id, file, offset, length.

    Order is (range_no, seq): ranges are disjoint and ascending.
    """
    spark = runs.sparkSession
    level = 0
    while runs.count() > FAN_IN:
        level += 1
        runs = _merge_groups(runs, folder, level)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = {r.run: (r.keys, r.offsets) for r in runs.select("run", "keys", "offsets").collect()}  # FAN_IN * SAMPLES keys at most
    keys = sorted(tuple(k.split("\t")) for own, _ in index.values() for k in own)
    step = max(1, -(-len(keys) // ranges))
    cuts = sorted({"\t".join(k) for k in keys[step::step]}, key=lambda k: tuple(k.split("\t")))
    bounds = [(i, lo, hi) for i, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None], strict=True))]
    begins = spark.createDataFrame(bounds, "range_no int, lo string, hi string").repartition(len(bounds), "range_no")
    sent = spark.sparkContext.broadcast(index)

    def run(batches):
        from bisect import bisect_right

        store, root = _store(folder)
        index = sent.value
        for batch in batches:
            for no, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = (None if x is None else tuple(x.split("\t")) for x in (lo, hi))
                sources = []
                for name, (keys, offsets) in sorted(index.items()):
                    at = bisect_right([tuple(k.split("\t")) for k in keys], low) - 1 if lo is not None else 0
                    offset = offsets[at] if at >= 0 and offsets else 0
                    sources.append(_read_run(store, f"{root}/{name}", offset, low, high))
                rows = []
                for seq, ((key, stamp, _), line) in enumerate(LoserTree(sources)):
                    e = json.loads(line.split("\t", 3)[3])
                    rows.append((no, seq, key, stamp, e["page"], e["file"], e["offset"], e["length"]))
                    if len(rows) == 10_000:
                        yield _index_batch(rows)
                        rows = []
                if rows:
                    yield _index_batch(rows)

    return common.save(begins.mapInArrow(run, "range_no int, seq long, url_key string, stamp string, page_id long, file string, offset long, length long"), f"{folder}/index")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["range_no", "seq", "url_key", "stamp", "page_id", "file", "offset", "length"])


def read(index: DataFrame, folder: str) -> DataFrame:
    """Every capture from its archive: page_id, payload_bytes, payload_digest, record_type, refers_to, range_no, seq, url_key, stamp."""

    def run(batches):
        store, root = _store(folder)
        name, f = None, None
        for batch in batches:
            rows = []
            for file, offset, length, no, seq, key, stamp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    name, f = file, store.open_input_file(f"{root}/{file}")
                f.seek(offset)
                fields, payload = parse(zlib.decompress(f.read(length), 31))
                revisit = fields["WARC-Type"] == "revisit"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and sha1_base32(payload) != digest:
                    raise OSError(f"payload of {file} at {offset} does not match its digest")
                size = int(fields["X-Payload-Length"])
                page, ref = (re.search(r"page:(-?\d*)>", fields.get(x, "")) for x in ("WARC-Record-ID", "WARC-Refers-To"))
                rows.append((int(page[1]) if page and page[1] else None, size, digest, fields["WARC-Type"], int(ref[1]) if ref else None, no, seq, key, stamp))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "range_no", "seq", "url_key", "stamp"])

    dealt = index.select("file", "offset", "length", "range_no", "seq", "url_key", "stamp").repartition("file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, range_no int, seq long, url_key string, stamp string")


def archive(spark: SparkSession, pages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Write, merge and return (index, captures read back)."""
    index = merge(write(pages, folder), folder)
    return index, read(index, folder)
