"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation several times, each time with a few turns more.
Every turn is hashed with its place; running over a conversation's turns the
combined hash identifies each prefix. A conversation whose full hash is a proper
prefix of a longer one is dropped by an anti-join, equal conversations keep the
one with the smallest id, and what is left is rendered.

Prefix hashes are deduplicated (with partial aggregation) before they meet the
full ones, so a first turn that very many conversations share is one row.

Defined results: turns are ordered by (turn, role, text), nulls first; a null
role or text differs from an empty one and renders as an empty one; rows
without conv_id belong to no conversation and are left out; repeated rows are
turns of their own; other columns are ignored; an empty table gives an empty
result. Prefixes are compared by two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text and the prefix hashes p1, p2 up to each turn."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order).cast("long"))
    return rows.withColumn("a", _hash(1)).withColumn("b", _hash(2)).select("conv_id", "place", "role", "text", F.bit_xor("a").over(running).alias("p1"), F.bit_xor("b").over(running).alias("p2"))


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies of the conversations to keep. ``rows`` come from ``placed``."""
    full = rows.groupBy("conv_id").agg(F.max(F.struct("place", "p1", "p2")).alias("f")).select("conv_id", "f.*")
    kinds = full.groupBy("place", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    last = full.select("conv_id", F.col("place").alias("n"))
    proper = rows.select("conv_id", "place", "p1", "p2").join(last, "conv_id").where("place < n").select("place", "p1", "p2").distinct()
    return kinds.join(proper, ["place", "p1", "p2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "copies")


def render(role: Column, text: Column) -> Column:
    """One turn; marks within the text are broken up."""
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), safe, F.lit(CLOSE + "\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and rendered of the maximal conversations."""
    rows = placed(turns)
    kept = maximal(rows)
    pieces = rows.join(kept, "conv_id").select("conv_id", "n_turns", "copies", "place", render(F.col("role"), F.col("text")).alias("piece"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy("conv_id", "n_turns", "copies").agg(text.alias("rendered"))
