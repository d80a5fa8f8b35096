"""Hard negatives by dual-tree search.

For every anchor: its ``positives`` nearest rows of the same label by inner
product, and for each of those the ``negatives`` nearest rows of other labels
whose score lies between two shares of the positive's. Scores are inner products
of integers, so they are exact.

There are trees over anchors and over candidates. A node holds rows close to each
other: it knows their ball and the range of their labels. Two balls bound the
inner products of all pairs below their nodes from both sides. A pair of nodes is
left out, with all anchors of the one and all candidates of the other, if its
interval lies below everything that any of the anchors still asks for, above
everything that it may take, or if the labels do not fit; a pair of leaves that
is left is scored by a matrix product. The best leaves come first, so what an
anchor asks for rises early.

In Spark: the top of the candidates' tree is a tree of splits fitted on at most
``SAMPLE`` vectors. Each of its leaves is one or more shards of at most about
``SHARD_ROWS`` rows; a shard's tree is a file in the shared folder, and runs of
neighbouring shards share a file of their balls. Anchors of one leaf form blocks
with a tree each. A task searches one block in one run of shards, and opens
only the shards whose ball is not left out. Before that, each block searches its
own leaf, so that every anchor comes with a score to beat. Tasks give only
their best rows; counts, the sample and nothing else come to the driver.

How much is left out depends on the vectors: balls of clusters are small, those
of directionless vectors hold everything, and then all pairs of a block and a
shard are scored.

Defined results: rows without vec_id or label, or whose vector is null, holds
null or non-finite components or such beyond 65536, or has another number of
components than most take no part; of rows that repeat a vec_id the one of
smallest label, then vector, counts; ties go to the smaller vec_id; an anchor
that is alone with its label, or whose positives leave no row between the
bounds, has no rows; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .intvec import integer_rows, matrix, of_usual_length
from .vectors import _get, _put, _store

POSITIVES = 5
NEGATIVES = 10
#: Shares of the positive's score, in hundredths, between which a negative's lies.
LEAST, MOST = 30, 90
#: Vectors on which the splits are fitted. A documented bound.
SAMPLE = 16384
SHARD_ROWS = 8192
BLOCK_ROWS = 512
#: Runs of shards, at most: the tasks of one block.
RUNS = 256
_LEAF, _ANCHOR_LEAF = 64, 8
_NONE = -(1 << 62)


class Tree:
    """Rows in the order of a binary tree's leaves.

    Node i holds rows ``begin[i]`` to ``end[i]``, has children ``child[i]`` and
    ``child[i] + 1`` (0: a leaf), the ball (``mid``, ``far``) and labels from
    ``low`` to ``high``.
    """

    PARTS = ("rows", "ids", "labels", "begin", "end", "child", "mid", "far", "low", "high")

    def __init__(self, *parts):
        for name, part in zip(self.PARTS, parts, strict=True):
            setattr(self, name, part)

    @staticmethod
    def build(rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int) -> Tree:
        order = np.lexsort((ids, labels))
        begin, end, child = [0], [len(ids)], [0]
        node = 0
        while node < len(begin):
            a, b = begin[node], end[node]
            if b - a > leaf:
                own = order[a:b]
                if labels[own[0]] == labels[own[-1]]:  # one label: cut the direction between two far rows in half
                    x = rows[own].astype(np.float64)
                    pole = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
                    order[a:b] = own[np.argsort(x @ (x[((x - pole) ** 2).sum(1).argmax()] - pole), kind="stable")]
                half = (a + b) // 2
                child[node] = len(begin)
                begin += [a, half]
                end += [half, b]
                child += [0, 0]
            node += 1
        rows, ids, labels = rows[order], ids[order], labels[order]
        mid = np.array([rows[a:b].mean(0) for a, b in zip(begin, end, strict=True)])
        far = np.array([np.sqrt(((rows[a:b] - m) ** 2).sum(1).max()) for a, b, m in zip(begin, end, mid, strict=True)])
        low, high = (np.array([f(labels[a:b]) for a, b in zip(begin, end, strict=True)]) for f in (np.min, np.max))
        return Tree(rows, ids, labels, np.array(begin), np.array(end), np.array(child), mid, far, low, high)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{p: getattr(self, p) for p in self.PARTS})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as got:
            return Tree(*[got[p] for p in Tree.PARTS])


def interval(mid: np.ndarray, far: np.ndarray, mids: np.ndarray, fars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of any two rows in each pair of balls, widened by more than floats err."""
    length, lengths = np.sqrt((mid * mid).sum(1)), np.sqrt((mids * mids).sum(1))
    near = mid @ mids.T
    spread = far[:, None] * lengths + length[:, None] * fars + far[:, None] * fars
    spread += 1 + 1e-9 * (length + far)[:, None] * (lengths + fars)
    return near - spread, near + spread


class Asked:
    """What a block's anchors still ask for: ``slots``, each an anchor's place in its tree and the scores it takes, and the best found."""

    def __init__(self, anchors: Tree, place: np.ndarray, slot: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, same: bool):
        self.anchors, self.place, self.slot, self.least, self.most, self.k, self.same = anchors, place, slot, least.copy(), most, k, same
        self.scores, self.ids = np.full((len(place), k), _NONE), np.zeros((len(place), k), np.int64)
        self.first = np.searchsorted(place, np.arange(len(anchors.ids) + 1))

    def of_nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """The least score that any anchor of a node takes, and the largest."""
        low, high = np.full(len(self.anchors.begin), np.inf), np.full(len(self.anchors.begin), -np.inf)
        for i, (a, b) in enumerate(zip(self.first[self.anchors.begin].tolist(), self.first[self.anchors.end].tolist(), strict=True)):
            if b > a:
                low[i], high[i] = self.least[a:b].min(), self.most[a:b].max()
        return low, high

    def fits(self, low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """Whether labels of two ranges can make a pair."""
        if self.same:
            return (low <= highs) & (lows <= high)
        return ~((low == high) & (lows == highs) & (low == lows))

    def take(self, leaf: int, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Score an anchors' leaf with some candidates."""
        a, b = self.anchors.begin[leaf], self.anchors.end[leaf]
        s0, s1 = self.first[a], self.first[b]
        of = self.place[s0:s1] - a
        s = _products(self.anchors.rows[a:b], rows)
        ok = (self.anchors.labels[a:b, None] == labels) == self.same
        if self.same:
            ok &= self.anchors.ids[a:b, None] != ids
        s = s[of]
        slot, at = np.nonzero(ok[of] & (s >= self.least[s0:s1, None]) & (s <= self.most[s0:s1, None]))
        if not len(slot):
            return
        new = np.unique(slot)
        all_slots = np.concatenate([slot, np.repeat(new, self.k)])
        all_scores = np.concatenate([s[slot, at], self.scores[s0 + new].ravel()])
        all_ids = np.concatenate([ids[at], self.ids[s0 + new].ravel()])
        by = np.lexsort((all_ids, -all_scores, all_slots))
        head = np.searchsorted(all_slots[by], new)
        pick = by[head[:, None] + np.arange(self.k)]
        self.scores[s0 + new], self.ids[s0 + new] = all_scores[pick], all_ids[pick]
        self.least[s0 + new] = np.maximum(self.least[s0 + new], self.scores[s0 + new, -1])

    def found(self) -> pa.RecordBatch:
        slot, at = np.nonzero(self.scores > _NONE)
        cols = [self.anchors.ids[self.place[slot]], self.slot[slot], self.ids[slot, at], self.scores[slot, at]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor_id", "slot", "id", "score"])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; in floats where those hold all sums."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def search(asked: Asked, cand: Tree) -> int:
    """Search all anchors of a block in a tree of candidates; the number of pairs scored."""
    a = asked.anchors
    least, most = interval(a.mid, a.far, cand.mid, cand.far)
    low, high = asked.of_nodes()
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaves: list[np.ndarray] = []
    while len(x):
        stay = (most[x, y] >= low[x]) & (least[x, y] <= high[x]) & asked.fits(a.low[x], a.high[x], cand.low[y], cand.high[y])
        x, y = x[stay], y[stay]
        cx, cy = a.child[x], cand.child[y]
        done = (cx == 0) & (cy == 0)
        leaves.append(np.column_stack([x[done], y[done]]))
        x, y, cx, cy = x[~done], y[~done], cx[~done], cy[~done]
        # both nodes are opened; a leaf stands for itself
        opened = [(np.where(cx > 0, cx + i, x), np.where(cy > 0, cy + j, y), ((i == 0) | (cx > 0)) & ((j == 0) | (cy > 0))) for i in (0, 1) for j in (0, 1)]
        x, y = (np.concatenate([o[k][o[2]] for o in opened]) for k in (0, 1))
    pairs = np.concatenate(leaves)
    scored = 0
    for leaf in np.unique(pairs[:, 0]).tolist():
        own = pairs[pairs[:, 0] == leaf, 1]
        own = own[np.argsort(-most[leaf, own], kind="stable")]
        s0, s1 = asked.first[a.begin[leaf]], asked.first[a.end[leaf]]
        for at in range(0, len(own), 4):
            some = own[at : at + 4]
            some = some[most[leaf, some] >= asked.least[s0:s1].min()]
            if not len(some):
                break
            rows = np.concatenate([np.arange(cand.begin[n], cand.end[n]) for n in some.tolist()])
            asked.take(leaf, cand.rows[rows], cand.ids[rows], cand.labels[rows])
            scored += len(rows) * int(a.end[leaf] - a.begin[leaf])
    return scored


# ---------------------------------------------------------------- the top of the tree


def splits(sample: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """A complete tree of cuts of the sample: direction and value of node i, whose children are 2i + 1 and 2i + 2."""
    depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
    axis, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    level = [np.arange(len(sample))]
    for i in range(len(axis)):
        own = level[i]
        if len(own):
            axis[i] = sample[own].std(0).argmax()
            value[i] = np.median(sample[own, axis[i]])
        right = sample[own, axis[i]] > value[i]
        level += [own[~right], own[right]]
    return axis, value


def leaf_of(rows: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Number, from the left, of the leaf of each row."""
    node = np.zeros(len(rows), np.int64)
    while len(axis) and node[0] < len(axis):
        node = 2 * node + 1 + (rows[np.arange(len(rows)), axis[node]] > value[node])
    return node - len(axis)


def _dealt(rows: DataFrame, sizes: dict[int, int], most: int, name: str) -> DataFrame:
    """Number runs of at most about ``most`` rows of one leaf, in the leaves' order."""
    start, first, parts = 0, {}, {}
    for leaf in sorted(sizes):
        first[leaf], parts[leaf] = start, -(-sizes[leaf] // most)
        start += parts[leaf]
    table = rows.sparkSession.createDataFrame([(leaf, first[leaf], parts[leaf]) for leaf in sizes], "leaf int, first long, parts long")  # a row a leaf, SAMPLE at most
    return rows.join(F.broadcast(table), "leaf").withColumn(name, F.col("first") + F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.col("parts"))).drop("first", "parts")


def _leaves(rows: DataFrame) -> dict[int, int]:
    return {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}  # a row a leaf, SAMPLE at most


def _load(folder: str, name: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(_get(folder, name))) as got:
        return {k: got[k] for k in got.files}


def _keep(folder: str, name: str, **arrays: np.ndarray) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    _put(folder, name, out.getvalue())


class Forest:
    """Trees of candidates and of anchors in the shared folder."""

    def __init__(self, rows: DataFrame, every: int, copies: int, folder: str):
        """rows: (vec_id, label, v), a vec_id each; anchors: whose vec_id is divisible by ``every``; of equal rows the ``copies`` smallest ids are candidates."""
        self.spark, self.folder = rows.sparkSession, folder
        _store(folder)[0].create_dir(_store(folder)[1], recursive=True)
        # of rows with equal label and vector no more can be among an anchor's best; cut inside each task first
        place = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
        cand = common.save(rows.withColumn("_place", place).where(F.col("_place") <= copies).drop("_place"), f"{folder}/candidates")
        n = cand.count()
        sample = np.array([r.v for r in cand.orderBy(F.xxhash64(F.lit(2), "vec_id"), "vec_id").limit(SAMPLE).select("v").collect()], np.int64)
        axis, value = splits(sample, min(SAMPLE // 16, -(-2 * n // SHARD_ROWS)))

        def mark(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf_of(matrix(b.column(2)), axis, value).astype(np.int32))], ["vec_id", "label", "v", "leaf"])

        kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        cand = common.save(cand.mapInArrow(mark, f"{kinds}, leaf int"), f"{folder}/marked")
        sizes = _leaves(cand)
        self.shards = sum(-(-s // SHARD_ROWS) for s in sizes.values())
        per_run = -(-self.shards // RUNS)
        self.runs = -(-self.shards // per_run)
        self._plant(_dealt(cand, sizes, SHARD_ROWS, "part"), "shard", _LEAF)
        balls = self.spark.read.parquet(f"{folder}/shard-balls").withColumn("run", F.floor(F.col("part") / per_run))

        def gather(table: pa.Table) -> pa.Table:
            table = table.combine_chunks().sort_by("part")
            run = table.column("run")[0].as_py()
            plain = {c: table.column(c).to_numpy() for c in ("part", "leaf", "far", "low", "high")}
            _keep(folder, f"run-{run}", mid=matrix(table.column("mid"), np.float64), **plain)
            return pa.table({"run": pa.array([run], pa.int64())})

        common.save(balls.groupBy("run").applyInArrow(gather, "run long"), f"{folder}/runs")
        anchors = common.save(rows.where(F.col("vec_id") % every == 0).mapInArrow(mark, f"{kinds}, leaf int"), f"{folder}/anchors")
        self.anchors = common.save(_dealt(anchors, _leaves(anchors), BLOCK_ROWS, "part"), f"{folder}/blocks")
        self.blocks = self._plant(self.anchors, "anchors", _ANCHOR_LEAF)

    def _plant(self, rows: DataFrame, name: str, leaf: int) -> DataFrame:
        """Write a tree a part and save the parts' balls."""
        folder = self.folder

        def plant(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            part, own = table.column("part")[0].as_py(), table.column("leaf")[0].as_py()
            t = Tree.build(matrix(table.column("v")), table.column("vec_id").to_numpy(), table.column("label").to_numpy(), leaf)
            _put(folder, f"{name}-{part}", t.dump())
            ball = {"mid": pa.array([t.mid[0].tolist()]), "far": t.far[:1], "low": t.low[:1], "high": t.high[:1]}
            return pa.table({"part": pa.array([part], pa.int64()), "leaf": pa.array([own], pa.int32()), **ball})

        made = rows.groupBy("part").applyInArrow(plant, "part long, leaf int, mid array<double>, far double, low long, high long")
        return common.save(made, f"{folder}/{name}-balls")

    def nearest(self, slots: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """(anchor_id, slot, id, score, rank): the k best rows of the same or of other labels for every slot (anchor_id, slot, least, most)."""
        folder, spark = self.folder, self.spark
        placed = slots.join(self.anchors.select(F.col("vec_id").alias("anchor_id"), "part"), "anchor_id")
        home = self._visit(placed, k, same, f"{name}-home", True)
        best = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "id")
        beaten = home.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("anchor_id", "slot", F.col("score").alias("_score"))
        raised = placed.join(beaten, ["anchor_id", "slot"], "left").select("anchor_id", "slot", F.greatest("least", "_score").alias("least"), "most", "part")
        others = self._visit(raised, k, same, f"{name}-others", False)
        return common.save(home.union(others).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), f"{folder}/{name}")

    def _visit(self, slots: DataFrame, k: int, same: bool, name: str, home: bool) -> DataFrame:
        """Rows found for slots (with the block ``part``) in their own leaf, or in all others."""
        folder, spark = self.folder, self.spark

        def keep(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py()
            _keep(folder, f"{name}-{part}", **{c: table.column(c).to_numpy() for c in ("anchor_id", "slot", "least", "most")})
            return pa.table({"part": pa.array([part], pa.int64())})

        kept = common.save(slots.groupBy("part").applyInArrow(keep, "part long"), f"{folder}/{name}-slots")
        # every block meets every run of shards, at most RUNS: two numbers a task
        cells = kept.join(self.blocks.select("part", "leaf"), "part").select("part", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.runs - 1).cast("long"))).alias("run"))
        cells = cells.repartition(min(10000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.runs)), "run", "part")

        def run(batches):
            for batch in batches:
                for part, leaf, number in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                    balls = _load(folder, f"run-{number}")
                    shards = np.flatnonzero((balls["leaf"] == leaf) == home)
                    if not len(shards):
                        continue
                    tree, got = Tree.load(_get(folder, f"anchors-{part}")), _load(folder, f"{name}-{part}")
                    by_id = np.argsort(tree.ids)
                    place = by_id[np.searchsorted(tree.ids[by_id], got["anchor_id"])]
                    by = np.lexsort((got["slot"], place))
                    asked = Asked(tree, place[by], got["slot"][by], got["least"][by], got["most"][by], k, same)
                    least, most = interval(tree.mid[:1], tree.far[:1], balls["mid"][shards], balls["far"][shards])
                    for i in np.argsort(-most[0], kind="stable").tolist():
                        ball, s = shards[i], asked.least.min(initial=1 << 62)
                        if most[0, i] >= s and least[0, i] <= asked.most.max(initial=_NONE) and asked.fits(tree.low[0], tree.high[0], balls["low"][ball], balls["high"][ball]):
                            search(asked, Tree.load(_get(folder, f"shard-{balls['part'][ball]}")))
                    yield asked.found()

        return common.save(cells.select("part", "leaf", "run").mapInArrow(run, "anchor_id long, slot long, id long, score long"), f"{folder}/{name}-found")


def mine(rows: DataFrame, every: int, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id long, label long, embedding)."""
    spark = rows.sparkSession
    folder = common.shared_dir(spark)
    got = integer_rows(rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"))
    got, size = of_usual_length(common.save(got, f"{folder}/integers"))
    got = common.save(got.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v"), f"{folder}/rows")
    if not size or not got.where(F.col("vec_id") % every == 0).limit(1).count():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    forest = Forest(got, every, max(positives + 1, negatives), folder)
    open_slots = forest.anchors.select(F.col("vec_id").alias("anchor_id"), F.lit(0).cast("long").alias("slot"), F.lit(_NONE + 1).alias("least"), F.lit(-_NONE).alias("most"))
    near = forest.nearest(open_slots, positives, True, "positives").select("anchor_id", F.col("rank").cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = common.save(near, f"{folder}/near")
    # a negative positive's bounds are empty; scores are whole, so the lower bound is rounded up and the upper one down
    bounds = near.where("positive_score >= 0").select("anchor_id", "slot", F.expr(f"({least} * positive_score + 99) div 100").alias("least"), F.expr(f"({most} * positive_score) div 100").alias("most"))
    hard = forest.nearest(bounds, negatives, False, "negatives")
    out = hard.join(near, ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
