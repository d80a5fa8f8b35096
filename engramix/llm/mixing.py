"""Mixing sources to target weights by Pareto order sampling.

A mix is given by weights over sources. Targets are shares of the whole
corpus's words, capped at a multiple of each source's own words; what a cap
cuts off is shared again by weight. Within a source every document gets an
expected number of copies: its whole part is certain, the rest is an inclusion
probability. Documents are ranked by random odds over inclusion odds (Pareto
order sampling) and taken in that order until the source's words are met.

Defined results: null text has size 0; null source is a source of its own,
after all others; rows that repeat a doc_id draw one common random number, so
they are taken or left together; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights 1, 2, 3, 1, 2, 3, ... over sources by code point, null last.

    One row a source of the mix: the window sees as many rows as the mix has
    sources, not documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (place % len(cycle) + 1).cast("int")))


def targets(sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """Add ``target`` to (source, source_size, weight).

    Targets rise in proportion to weight up to ``cap`` times the source's size.
    Sources are ordered by cap over weight; those that reach their cap form a
    prefix of that order, so prefix sums give the common level of the rest in
    one pass instead of sharing again round by round.
    """
    everything = Window.partitionBy()
    order = Window.orderBy("_full", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = sources.withColumn("_full", cap * F.col("source_size") / F.col("weight"))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("_level", level)
    # the first source in that order that stays below its cap sets the level for all after it
    first = F.min(F.when(F.col("_level") < F.col("_full"), F.struct("_full", "_level"))).over(everything)
    free = F.coalesce(F.col("_full") >= first["_full"], F.lit(False))
    return ranked.withColumn("target", F.when(free, first["_level"] * F.col("weight")).otherwise(cap * F.col("source_size"))).drop("_full", "_level")


def size_class(docs: DataFrame, damping: float) -> DataFrame:
    """Bit length of the size, and the pull of that class."""
    k = F.when(F.col("size") > 0, F.length(F.bin(F.col("size")))).otherwise(0)
    return docs.withColumn("_class", k).withColumn("_pull", F.pow(F.lit(2.0), -damping * F.col("_class")))


def inclusion_classes(sized: DataFrame, cap: int, cycle: tuple[int, ...], damping: float) -> DataFrame:
    """Expected copies for each (source, size class): source_size, target, inclusion."""
    per_class = size_class(sized, damping).groupBy("source", "_class", "_pull").agg(F.sum("size").alias("_words"))
    per_source = per_class.groupBy("source").agg(F.sum("_words").alias("source_size"))
    plan = targets(cyclic_weights(per_source, cycle), float(cap)).withColumnRenamed("source", "_source")

    classes = per_class.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    own = Window.partitionBy("source")
    order = own.orderBy("_class")  # the strongest pull comes first and reaches the cap first
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("target") - F.coalesce(F.sum(cap * F.col("_words")).over(before), F.lit(0.0))) / F.sum(F.col("_words") * F.col("_pull")).over(rest)
    classes = classes.withColumn("_level", F.when(F.col("_words") > 0, level))
    free = F.col("_level") * F.col("_pull") < cap
    first = F.min(F.when(free, F.struct("_class", "_level"))).over(own)
    classes = classes.withColumn("_first", first)
    inclusion = F.when(F.col("_words") == 0, 0.0).when(F.col("_class") >= F.col("_first._class"), F.greatest(F.col("_first._level"), F.lit(0.0)) * F.col("_pull")).otherwise(float(cap))
    return classes.select(F.col("source").alias("_source"), F.col("_class").alias("_of_class"), "source_size", "target", inclusion.alias("inclusion"))


def _ranked(docs: DataFrame, classes: DataFrame, damping: float, seed: int, order_blocks: int) -> DataFrame:
    """Add certain copies (_whole), the ranking variable (_q) and its range (_block)."""
    docs = size_class(docs, damping)
    rows = docs.join(classes, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_class") == F.col("_of_class")), "left").drop("_source", "_of_class", "_class", "_pull")
    whole = F.floor(F.col("inclusion") + 1e-9)
    part = F.col("inclusion") - whole
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = rows.withColumn("_whole", whole.cast("long")).withColumn("_q", F.when(part > 1e-9, (u / (1 - u)) * ((1 - part) / part)))
    # q/(1+q) maps the ranking variable to (0, 1) in order
    return rows.withColumn("_block", F.floor(F.col("_q") / (1 + F.col("_q")) * order_blocks).cast("int")).withColumn("_tie", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))


def fit(sized: DataFrame, folder: str, cap: int = 3, cycle: tuple[int, ...] = (1, 2, 3), damping: float = 0.125, seed: int = 1, order_blocks: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """Inclusion per (source, size class), and where each source's order is cut.

    The cumulative words along the Pareto order are found in two steps, so that
    no task ever sorts a whole source: words are pre-aggregated over
    ``order_blocks`` ranges of the ranking variable, and documents are ordered
    only within the one range in which a source meets its target.
    """
    classes = common.save(inclusion_classes(sized, cap, cycle, damping), f"{folder}/classes")
    rows = _ranked(sized, classes, damping, seed, order_blocks)
    per_block = rows.groupBy("source", "_block").agg(F.sum(F.when(F.col("_q").isNotNull(), F.col("size"))).alias("_in"), F.sum(F.col("_whole") * F.col("size")).alias("_fixed"), F.max("target").alias("_goal"))
    own = Window.partitionBy("source")
    through = F.sum("_in").over(own.orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    goal = F.max("_goal").over(own) - F.sum("_fixed").over(own)
    per_block = per_block.withColumn("_through", through).withColumn("_left", goal).where("_block is not null and _through > _left")
    cut = per_block.groupBy("source").agg(F.min("_block").alias("_cut"), F.min_by(F.col("_left") - F.col("_through") + F.col("_in"), "_block").alias("_room"))
    cut = common.save(cut.withColumnRenamed("source", "_s"), f"{folder}/cut")

    edge = rows.join(cut, F.col("source").eqNullSafe(F.col("_s"))).where("_block = _cut")
    # documents that share a doc_id are peers and count together
    edge = edge.groupBy("_s", "_q", "_tie", "_room").agg(F.sum("size").alias("_words"))
    upto = F.sum("_words").over(Window.partitionBy("_s").orderBy("_q", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = edge.withColumn("_upto", upto).where("_upto - _words / 2 <= _room").groupBy("_s").agg(F.max(F.struct("_q", "_tie")).alias("_last"))
    last = last.select(F.col("_s").alias("_l"), F.col("_last._q").alias("_last_q"), F.col("_last._tie").alias("_last_tie"))
    cuts = cut.join(last, F.col("_s").eqNullSafe(F.col("_l")), "left").drop("_l", "_room")
    return classes, common.save(cuts, f"{folder}/cuts")


def take(docs: DataFrame, fitted: tuple[DataFrame, DataFrame], cap: int = 3, damping: float = 0.125, seed: int = 1, order_blocks: int = 1 << 16) -> DataFrame:
    """Add source_size, target, inclusion and copies to docs (doc_id, source, size, ...), row by row."""
    classes, cuts = fitted
    rows = _ranked(docs, classes, damping, seed, order_blocks).join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left")
    q, block = F.col("_q"), F.col("_block")
    first = F.col("_cut").isNull() | (block < F.col("_cut"))
    edge = (block == F.col("_cut")) & ((q < F.col("_last_q")) | ((q == F.col("_last_q")) & (F.col("_tie") <= F.col("_last_tie"))))
    extra = F.when(q.isNotNull() & (first | F.coalesce(edge, F.lit(False))), 1).otherwise(0)
    return rows.withColumn("copies", F.least(F.col("_whole") + extra, F.lit(cap)).cast("long")).drop("_whole", "_q", "_block", "_tie", "_s", "_cut", "_last_q", "_last_tie")


def mix(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """doc_id, source, size, source_size, target, inclusion and copies of every document.

    Expected copies are ``min(cap, level * 2^(-damping * size class))``: long
    documents repeat a little less, and the level is set per source so that
    expected words meet the target. A size class is the bit length of the size,
    so a source has at most 64 and its level follows from prefix sums.
    """
    folder = common.shared_dir(docs.sparkSession)
    sized = common.save(docs.select("doc_id", "source", word_count(F.col(text)).alias("size")), f"{folder}/sized")
    own = {k: v for k, v in how.items() if k != "cycle"}
    return take(sized, fit(sized, folder, **how), **own)


def remix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as it takes them, columns unchanged."""
    names = docs.columns
    folder = common.shared_dir(docs.sparkSession)
    sized = common.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), f"{folder}/sized")
    own = {k: v for k, v in how.items() if k != "cycle"}
    full = docs.select(F.struct("*").alias("_row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    taken = take(full, fit(sized, folder, **how), **own)
    again = F.explode(F.expr("sequence(1L, copies)"))
    return taken.where("copies > 0").select("_row", again.alias("_copy")).select(*[F.col("_row").getField(n).alias(n) for n in names])
