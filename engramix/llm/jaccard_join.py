"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set holds its distinct word shingles. Equal sets form one class and
are handled once. Shingles are put in one global order, rare ones first; two
sets that are similar enough share at least k shingles of their k-match
prefixes. Each set picks its own k: a longer prefix costs more postings but a
candidate must then share more of it, so k is the value of least estimated
cost. A pair becomes a candidate when it shares min(k, k') prefix shingles.

The order comes from a count sketch of fixed size over all documents. Any order
gives the same links; the sketch only decides how few candidates there are.

Groups of near copies would make candidate pairs grow with the square of their
size, so linking works in two steps, both exact. First every set is compared
with a few hubs of the posting lists it is on (linear), and links are closed to
components. Then every remaining candidate pair whose ends lie in *different*
components is tried. Pairs inside a component cannot change it. Before sets are
fetched, parity bitmaps of the sets give a lower bound of their symmetric
difference, which removes most pairs that cannot link and none that can.

Defined results: null texts and texts without words have no shingles, link with
nothing and are components of their own; texts of fewer words than a shingle
have one shingle, the whole; rows that repeat a doc_id are separate documents
with one id; rows without doc_id take part but never name a component (a
component of such rows only has none); other columns are ignored; an empty table
gives an empty result. Sets and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SKETCH_BITS = 22
SKETCH_BLOCK = 1 << 14
BITMAP = 1024
MOST_MATCHES = 4
#: Verifying a candidate costs about as much as reading so many postings.
VERIFY_COST = 8.0
HUBS = 4
#: Members of a posting list that one side of a task holds.
LIST_PART = 2048
#: Set keys a task remembers to leave out copies early; it starts anew beyond. Copies it misses are left out later.
SEEN = 1 << 18
_M = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    w = common.words(col)
    h = w.hashes
    full = max(0, len(h) - k + 1)
    s = np.zeros(full, np.uint64)
    for j in range(k):
        s += h[j : j + full] * _M[j]
    s = common.mix(s)
    for a, b in zip(w.docs[:-1].tolist(), w.docs[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(s[a : b - k + 1])
        elif b > a:
            yield common.mix((h[a:b] * _M[: b - a]).sum(dtype=np.uint64, keepdims=True) + _M[16 + b - a])
        else:
            yield np.empty(0, np.uint64)


def set_key(u: np.ndarray) -> np.uint64:
    """Identity of a set."""
    v = common.mix(u * _M[20])
    return common.mix(np.array([v.sum(dtype=np.uint64) * _M[21] + np.bitwise_xor.reduce(v) * _M[22] + np.uint64(len(u))]))[0]


def bitmap(u: np.ndarray) -> bytes:
    """Parity of the shingles in each of BITMAP cells: unequal cells of two sets are at most their symmetric difference."""
    return np.packbits((np.bincount((u >> np.uint64(40)).astype(np.int64) & (BITMAP - 1), minlength=BITMAP) & 1).astype(np.uint8)).tobytes()


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """A row a document (its set's size, key and bitmap) and, per task, blocks of the shingle sketch."""

    def run(batches):
        common.trim()
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen: set[int] = set()
        names = ["doc_id", "text_hash", "n", "cid", "bits", "block", "counts"]
        for batch in batches:
            for b in common.blocks(batch, "text"):
                n, keys, bits = [], [], []
                for u in shingle_sets(b.column(2), k):
                    key = int(set_key(u)) if len(u) else None
                    n.append(len(u))
                    if key is None:
                        keys.append(None)
                        bits.append(None)
                        continue
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        np.add.at(sketch, (u & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), 1)
                    keys.append(key - (1 << 64) if key >> 63 else key)
                    bits.append(bitmap(u))
                m = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        for b in common.emit_blocks(sketch, SKETCH_BLOCK):
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), b.column(0), b.column(1)], names)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n long, cid long, bits binary, block int, counts binary")


def matches(counts: np.ndarray, x: int, cut: int, noise: float) -> int:
    """How many prefix shingles a partner must share: the value of least estimated cost.

    ``counts`` are the sketch counts of the set's shingles in global order and
    ``cut`` the prefix length without extra matches. With k matches the prefix
    has cut + k shingles; reading its postings costs their counts, and at most
    a k-th of that many candidates get verified.
    """
    most = min(MOST_MATCHES, x - cut)
    f = np.cumsum(np.maximum(counts[: cut + most].astype(float) - noise, 1.0) - 1.0 + 0.05)
    cost = [f[cut + j - 1] * (1 + VERIFY_COST / j) for j in range(1, most + 1)]
    return 1 + int(np.argmin(cost))


def _postings(docs: DataFrame, sketch, k: int, percent: int) -> DataFrame:
    """(token, cid, n, k, small, prefix) of each set's prefix; ``small``: also in the prefix it has as the smaller of a pair; ``prefix``: its length."""

    def run(batches):
        common.trim()
        counts = sketch.value
        noise = float(counts.sum(dtype=np.float64) / len(counts))
        mask = np.uint64(len(counts) - 1)
        seen: set[int] = set()
        for batch in batches:
            for b in common.blocks(batch, "text"):
                out: list[list[np.ndarray]] = [[], [], [], [], [], []]
                for u in shingle_sets(b.column(0), k):
                    x = len(u)
                    key = set_key(u) if x else None
                    if key is None or int(key) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(int(key))
                    c = counts[(u & mask).astype(np.int64)]
                    cut = x - -(-percent * x // 100)
                    small = x - -(-2 * percent * x // (100 + percent))
                    order = np.argsort((np.minimum(c, 0xFFFF).astype(np.uint64) << np.uint64(48)) | (u >> np.uint64(16)), kind="stable")[: cut + MOST_MATCHES]
                    ell = matches(c[order], x, cut, noise)
                    order = order[: cut + ell]
                    m = len(order)
                    for to, v in zip(out, (u[order], np.full(m, key), np.full(m, x, np.int32), np.full(m, ell, np.int8), np.arange(m) < small + ell, np.full(m, m, np.int32)), strict=True):
                        to.append(v)
                if out[0]:
                    t, c, n, e, s, m = (np.concatenate(v) for v in out)
                    yield pa.RecordBatch.from_arrays([common.as_long(t), common.as_long(c), pa.array(n), pa.array(e), pa.array(s), pa.array(m)], ["token", "cid", "n", "k", "small", "prefix"])

    return docs.select("text").mapInArrow(run, "token long, cid long, n int, k byte, small boolean, prefix int")


def _shared(postings: DataFrame) -> DataFrame:
    """Postings of tokens that two or more sets post."""
    twice = postings.groupBy("token").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("token")
    return postings.join(twice, "token")


def _lists(postings: DataFrame, folder: str) -> DataFrame:
    """Posting lists with ``most``, the shingles of a set less those of its prefix that no other set posts.

    It only ranks hubs. It is no bound of the overlap: a partner may hold such a
    shingle beyond its own prefix.
    """
    lists = common.save(_shared(postings).dropDuplicates(["token", "cid"]), f"{folder}/shared")
    most = lists.groupBy("cid").agg((F.first("n") - F.first("prefix") + F.count("*")).alias("most"))
    return common.save(lists.join(most, "cid"), f"{folder}/lists")


def _may_link(percent: int):
    """Bitmap test and sizes: drop pairs whose symmetric difference is surely too large."""

    def run(batches):
        for b in batches:
            n = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + b.column(3).to_numpy(zero_copy_only=False)
            x, _ = common.utf8(b.column(4))
            y, _ = common.utf8(b.column(5))
            d = np.bitwise_count(x ^ y).reshape(b.num_rows, -1).sum(1, dtype=np.int64) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["p", "q"]).filter(pa.array((100 + percent) * d <= (100 - percent) * n))

    return run


def _links(percent: int):
    """Exact test on the full sets."""

    def run(batches):
        common.trim()
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.searchsorted(v, u)
                common_n = int((v[np.minimum(at, len(v) - 1)] == u).sum())
                keep.append(100 * common_n >= percent * (len(u) + len(v) - common_n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, folder: str) -> DataFrame:
    """The pairs (p, q) of classes that link, as edges (u, v)."""
    side = classes.select("cid", "n", "bits")
    p, q = side.toDF("p", "np", "bp"), side.toDF("q", "nq", "bq")
    kept = pairs.join(p, "p").join(q, "q").select("p", "q", "np", "nq", "bp", "bq").mapInArrow(_may_link(percent), "p long, q long")
    kept = common.save(kept, f"{folder}/kept")

    def run(batches):
        common.trim()
        for batch in batches:
            for b in common.blocks(batch, "text"):
                sets = list(shingle_sets(b.column(0), k))
                keys = np.array([set_key(u) if len(u) else 0 for u in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([common.as_long(keys), pa.array([u.tobytes() for u in sets], pa.binary())], ["cid", "tokens"])

    need = common.save(kept.select(F.col("p").alias("cid")).union(kept.select("q")).distinct(), f"{folder}/need")
    rows = need.join(classes.select("cid", "doc_id", "text_hash"), "cid").drop("cid")
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_h"), "text").join(rows, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("text_hash")), "left_semi")
    sets = common.save(texts.select("text").mapInArrow(run, "cid long, tokens binary"), f"{folder}/sets").dropDuplicates(["cid"])
    full = kept.join(sets.toDF("p", "tp"), "p").join(sets.toDF("q", "tq"), "q").select("p", "q", "tp", "tq")
    links = common.save(full.mapInArrow(_links(percent), "u long, v long"), f"{folder}/links")
    for part in ("kept", "need", "sets"):
        common.drop(docs.sparkSession, f"{folder}/{part}")
    return links


def _to_hubs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of each set with at most HUBS sets that head posting lists it is on."""
    # the first head is the set with the fewest shingles of its own: the likely origin of a group of near copies
    rank = [F.struct((F.col("n") - F.col("most")).alias("o"), F.xxhash64(F.lit(i), "cid").alias("h"), "cid", "n") if i == 0 else F.struct(F.lit(0).alias("o"), F.xxhash64(F.lit(i), "cid").alias("h"), "cid", "n") for i in range(HUBS)]
    heads = [F.min(r).alias(f"h{i}") for i, r in enumerate(rank)]
    hubs = lists.groupBy("token").agg(*heads)
    met = lists.join(hubs, "token").select("cid", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"h{i}.cid").alias("hub"), F.col(f"h{i}.n").alias("m")) for i in range(HUBS)])).alias("hub"))
    met = met.select("cid", "n", "hub.*").where("cid <> hub").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    best = met.groupBy("cid", "i", "hub").count().groupBy("cid", "i").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    return best.select(F.least("cid", "hub").alias("p"), F.greatest("cid", "hub").alias("q")).distinct()


def _meet(percent: int):
    """Pairs of sets that meet in a block of a posting list, lie in different components and may link.

    Rows come sorted by block. All lists of a stretch are paired at once: row i
    with row i + 1, then with row i + 2, and so on while both are in one block.
    Only pairs that pass sizes and bitmaps leave the task.
    """

    def pairs(cols):
        gid, cid, n, k, small, comp, half, cross, upper, bits = cols
        out = [[], [], []]
        at, d = np.arange(len(gid)), 0
        while True:
            d += 1
            at = at[at + d < len(gid)]
            at = at[gid[at] == gid[at + d]]
            if not len(at):
                break
            x, y = at, at + d
            keep = (comp[x] != comp[y]) & (~cross[x] | (half[x] != half[y])) & (upper[x] | upper[y])
            keep &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            keep &= np.where((n[x] < n[y]) | ((n[x] == n[y]) & (cid[x] < cid[y])), small[x], small[y])
            x, y = x[keep], y[keep]
            if len(x):
                diff = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
                keep = (100 + percent) * diff <= (100 - percent) * (n[x] + n[y])
                x, y = x[keep], y[keep]
                out[0].append(np.minimum(cid[x], cid[y]))
                out[1].append(np.maximum(cid[x], cid[y]))
                out[2].append(np.minimum(k[x], k[y]))
        return [np.concatenate(o) if o else np.empty(0, np.int64) for o in out]

    def columns(b):
        num = lambda name: b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        token, cell, lo, hi = num("token"), num("cell"), num("lo"), num("hi")
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        data, _ = common.utf8(b.column(b.schema.get_field_index("bits")))
        bits = np.frombuffer(data.tobytes(), np.uint64).reshape(len(token), -1)
        return new, [np.cumsum(new), num("cid"), num("n").astype(np.int64), num("k").astype(np.int64), num("small"), num("comp"), num("half"), lo != hi, num("upper"), bits]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            new, cols = columns(held)
            last = int(np.flatnonzero(new)[-1])  # the last block may go on in the next batch
            if last == 0:
                continue
            p, q, k = pairs([c[:last] for c in cols])
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64()), pa.array(k, pa.int64())], ["p", "q", "k"])
            held = held.slice(last)
        if held is not None:
            p, q, k = pairs(columns(held)[1])
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64()), pa.array(k, pa.int64())], ["p", "q", "k"])

    return run


def _across(lists: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs whose ends lie in different components.

    Only lists that hold two or more components are opened. Sets are dealt by
    size: sizes rise by 100 / percent from one class to the next, so sets link
    only within a class or across neighbouring ones, and each set is met in its
    own cell and, as one of the smaller, in the next. A cell longer than
    LIST_PART is dealt into parts, and every two parts meet in a task of their
    own, so no task holds more than two parts of a list.
    """
    own = lists.join(labels, F.col("cid") == F.col("node"), "left").select("token", "cid", "n", "k", "small", F.coalesce("component", "cid").alias("comp"))
    several = own.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("token")
    size_class = F.floor(F.log(F.col("n").cast("double")) * ((1 - 1e-9) / math.log(100 / percent)) if percent < 100 else F.col("n")).cast("int")
    own = own.join(several, "token").withColumn("class", size_class).withColumn("cell", F.explode(F.array("class", F.col("class") + 1)))
    cells = own.groupBy("token", "cell").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("size")).where("a <> b")
    cells = cells.select("token", "cell", F.ceil(F.col("size") / LIST_PART).cast("int").alias("parts"))
    rows = own.join(cells, ["token", "cell"]).join(classes.select("cid", "bits"), "cid").withColumn("half", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("token", "cell", F.least("half", "other").alias("lo"), F.greatest("half", "other").alias("hi"), "cid", "n", "k", "small", "comp", "half", (F.col("class") == F.col("cell")).alias("upper"), "bits")
    met = rows.repartition("token", "cell", "lo", "hi").sortWithinPartitions("token", "cell", "lo", "hi").mapInArrow(_meet(percent), "p long, q long, k long")
    return met.groupBy("p", "q").agg(F.count("*").alias("shared"), F.min("k").alias("k")).where("shared >= k").select("p", "q")


def join(docs: DataFrame, shingle: int = 3, percent: int = 90, folder: str | None = None) -> DataFrame:
    """A row a document: doc_id, text_hash, n_shingles and component_id.

    Two documents link when 100 * intersection >= percent * union;
    component_id is the smallest doc_id that links reach.
    """
    spark = docs.sparkSession
    folder = folder or common.shared_dir(spark)
    scanned = common.save(_scan(docs, shingle), f"{folder}/scan")
    rows = scanned.where("block is null").select("doc_id", "text_hash", "n", "cid", "bits")
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = common.save(classes.select("cid", "least", F.col("one.doc_id").alias("doc_id"), F.col("one.text_hash").alias("text_hash"), "n", "bits"), f"{folder}/classes")

    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for i, blob in common.add_blocks(scanned.where("block is not null").select("block", "counts")).toLocalIterator():  # 2^SKETCH_BITS counters in all
        counts[i * SKETCH_BLOCK : (i + 1) * SKETCH_BLOCK] = np.minimum(common.unpack(bytes(blob)), (1 << 32) - 1)  # orders shingles only
    sketch = spark.sparkContext.broadcast(counts)

    postings = common.save(_postings(docs, sketch, shingle, percent), f"{folder}/postings")
    lists = _lists(postings, folder)
    common.drop(spark, f"{folder}/postings")

    near = _verify(_to_hubs(lists, percent), classes, docs, shingle, percent, f"{folder}/hubs")
    labels = common.save(components(near, f"{folder}/first"), f"{folder}/first/labels")
    rest = _verify(_across(lists, labels, classes, percent), classes, docs, shingle, percent, f"{folder}/across")
    labels = common.save(components(near.union(rest), f"{folder}/last"), f"{folder}/last/labels")

    named = classes.select("cid", "least").join(labels, F.col("cid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cid")).select("cid", "comp", "least")
    of_comp = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_class = common.save(named.join(of_comp, "comp").select("cid", "component_id"), f"{folder}/named")
    for part in ("lists", "shared", "classes", "hubs", "across", "first", "last"):
        common.drop(spark, f"{folder}/{part}")
    out = rows.select("doc_id", "text_hash", "n", "cid").join(of_class, "cid", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, one of each component: that with the smallest doc_id. Columns unchanged.

    Documents without shingles stay, and so do rows without doc_id.
    """
    folder = common.shared_dir(docs.sparkSession)
    found = common.save(join(docs, shingle, percent, f"{folder}/join"), f"{folder}/found")
    common.drop(docs.sparkSession, f"{folder}/join")
    gone = found.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    out = docs.join(gone, (F.col("doc_id").cast("long") == F.col("_d")) & (F.xxhash64("text") == F.col("_h")), "left_anti")
    twice = found.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id").limit(1).count()
    if twice:  # rows that repeat a doc_id: any one of them stays
        blank = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]") | F.col("doc_id").isNull()
        out = out.where(~blank).dropDuplicates(["doc_id"]).unionByName(out.where(blank))
    return out
