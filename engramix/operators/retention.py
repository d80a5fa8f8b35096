"""One retention run: prune, expire, tag orphans, purge with everything that depends on a memory.

Tables go in and come out by name; the caller writes the new versions. Rows to
delete are found once and saved, every dependent table is cleaned by one
anti-join, so a run costs a join a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from . import lifecycle as lc
from . import search as se

#: Tables whose rows go with a memory, and the columns that name it; and columns that only lose the reference.
DEPENDENT = {"memory_embeddings": ("memory_id",), "memory_salience": ("memory_id",), "session_recalls": ("memory_id",), "entity_mentions": ("memory_id",), "consolidations": ("original_id", "consolidated_id")}
REFERRING = {"entity_facts": ("source_memory_id",), "relationships": ("source_memory_id",), "memories": ("reply_to_id",)}
ORPHANED = "orphaned_sources"


@dataclass(frozen=True)
class Policy:
    """Live rows that stay in any case, the weakness and age of rows to prune, and days before deleted rows are purged."""

    floor: int = 100
    threshold: float = 0.3
    min_age_days: int = 30
    grace_days: int = 30


def doomed(memories: DataFrame, salience: DataFrame, now: Column, policy: Policy = Policy()) -> DataFrame:
    """(id, why): live rows to delete softly; the weakest are pruned until ``floor`` rows are left, expired ones go besides.

    Nothing goes while no more rows live than the floor.
    """
    live = se.live(memories).count()
    budget = max(0, live - policy.floor)
    if not budget:
        return memories.select("id", F.lit("").alias("why")).where(F.lit(False))
    pruned = lc.gc_candidates(memories, salience, now, policy.threshold, policy.min_age_days, budget).select("id", F.lit("pruned").alias("why"))
    expired = lc.expired(memories, now).select("id", F.lit("expired").alias("why"))
    # a row that is both counts as pruned
    return pruned.unionByName(expired).groupBy("id").agg(F.max("why").alias("why"))


def tag_orphans(memories: DataFrame, gone: DataFrame) -> DataFrame:
    """Live rows of which a source is gone get a tag, once."""
    lost = lc.orphans(se.live(memories), gone).select("id", F.lit(True).alias("_lost"))
    rows = memories.join(lost, "id", "left")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    new = F.col("_lost") & ~F.array_contains(tags, ORPHANED)
    return rows.withColumn("tags", F.when(new, F.array_append(tags, F.lit(ORPHANED))).otherwise(F.col("tags"))).drop("_lost")


def without(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the memories of ``gone`` (id) and all that depends on them; mere references become null."""
    out = dict(tables)
    out["memories"] = tables["memories"].join(gone.select("id"), "id", "left_anti")
    for name, columns in DEPENDENT.items():
        if name in tables:
            for c in columns:
                out[name] = out[name].join(gone.select(F.col("id").alias(c)), c, "left_anti")
    for name, columns in REFERRING.items():
        for c in columns:
            if name in tables and c in tables[name].columns:
                marked = out[name].join(gone.select(F.col("id").alias(c), F.lit(True).alias("_gone")), c, "left")
                out[name] = marked.withColumn(c, F.when(F.col("_gone").isNull(), F.col(c))).select(*out[name].columns)
    return out


def run(tables: dict[str, DataFrame], now: Column, policy: Policy = Policy()) -> tuple[dict[str, DataFrame], DataFrame]:
    """(new tables, report): the report has a row for each kind of what was done (pruned, expired, orphaned, purged).

    ``tables`` holds memories, memory_salience and any of the dependent ones.
    Rows deleted in this run are not purged in it. Running again at the same time
    changes nothing.
    """
    memories, spark = tables["memories"], tables["memories"].sparkSession
    folder = scratch.folder(spark)
    gone = scratch.save(doomed(memories, tables["memory_salience"], now, policy), f"{folder}/doomed")
    marked = lc.soft_delete(memories, gone, now)
    tagged = scratch.save(tag_orphans(marked, gone), f"{folder}/memories")
    purged = scratch.save(lc.purgeable(tagged, now, policy.grace_days).select("id"), f"{folder}/purged")
    new = without({**tables, "memories": tagged}, purged)
    before = memories.select("id", F.coalesce("tags", F.array().cast("array<string>")).alias("_tags"))
    orphaned = tagged.join(before, "id").where(F.array_contains("tags", ORPHANED) & ~F.array_contains("_tags", ORPHANED))
    report = gone.groupBy(F.col("why").alias("kind")).agg(F.count("*").alias("n")).unionByName(orphaned.agg(F.lit("orphaned").alias("kind"), F.count("*").alias("n"))).unionByName(purged.agg(F.lit("purged").alias("kind"), F.count("*").alias("n")))
    return new, report


def purge_embeddings(memories: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All vectors go and every live memory waits for a new one."""
    waiting = F.when(F.col("deleted_at").isNull(), "pending").otherwise(F.col("embedding_status"))
    return memories.withColumn("embedding_status", waiting), embeddings.where(F.lit(False))


def expire_sessions(sessions: DataFrame, recalls: DataFrame, now: Column, seconds: int = 86400) -> tuple[DataFrame, DataFrame]:
    """Sessions (session_id, last_active_at) idle for too long go, and what they recalled with them."""
    idle = sessions.where(F.unix_timestamp(now) - F.unix_timestamp("last_active_at") > seconds).select("session_id")
    return sessions.join(idle, "session_id", "left_anti"), recalls.join(idle, "session_id", "left_anti")
