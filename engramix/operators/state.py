"""Changes of state as functions from tables to tables: tags, sessions, merges, embeddings, undo.

Each change is a join with the (small or large) frame of what changes, so a
batch of changes is one job whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as sc


def retag(memories: DataFrame, ids: DataFrame, add: str | None = None, remove: str | None = None) -> DataFrame:
    """Add a tag if missing (no tags: a list of it) and take another away, for rows whose id is in ``ids``."""
    tags = F.col("tags")
    if remove is not None:
        tags = F.array_remove(tags, remove)
    if add is not None:
        own = F.coalesce(tags, F.array().cast("array<string>"))
        tags = F.when(F.array_contains(own, add), own).otherwise(F.array_append(own, F.lit(add)))
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return memories.join(hit, "id", "left").withColumn("tags", F.when(F.col("_hit"), tags).otherwise(F.col("tags"))).drop("_hit")


def annotated(memories: DataFrame, notes: DataFrame, now: Column) -> DataFrame:
    """Append notes (id, at, note) to ``annotations`` in order of time; rows with notes count as updated."""
    of = notes.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "note"))), lambda x: x["note"]).alias("annotations"))
    rows = memories.join(of, "id", "left")
    return rows.withColumn("updated_at", F.when(F.col("annotations").isNotNull(), now).otherwise(F.col("updated_at")))


def session_tags(log: DataFrame) -> DataFrame:
    """session_id and its distinct tags in the order they came, since the session was last cleared.

    ``log`` has session_id, at, id, tags and cleared. Tags are deduplicated
    before they are gathered, so a list holds distinct tags only.
    """
    place = F.struct("at", "id")
    cleared = log.where("cleared").groupBy("session_id").agg(F.max(place).alias("_cleared"))
    rows = log.where("not cleared").select("session_id", place.alias("_at"), F.posexplode("tags").alias("_n", "tag"))
    rows = rows.join(cleared, "session_id", "left").where("_cleared is null or _at > _cleared")
    first = rows.groupBy("session_id", "tag").agg(F.min(F.struct("_at", "_n")).alias("_first"))
    return first.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "tag"))), lambda x: x["tag"]).alias("tags"))


def idle_sessions(recalls: DataFrame, now: Column, seconds: int = 86400) -> DataFrame:
    """session_id and last_at of sessions without a recall for ``seconds``."""
    last = recalls.groupBy("session_id").agg(F.max("recalled_at").alias("last_at"))
    return last.where(F.unix_timestamp(now) - F.unix_timestamp("last_at") > seconds)


def merge_duplicates(memories: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """Merge each ``memory_id`` of pairs into its ``keeper``.

    A keeper's access count rises by the rows merged and their number is kept;
    rows merged are deleted softly, if they live.
    """
    gained = pairs.groupBy(F.col("keeper").alias("id")).agg(F.count("*").alias("merged"))
    gone = pairs.select(F.col("memory_id").alias("id"), F.lit(True).alias("_gone")).distinct()
    rows = memories.join(gained, "id", "left").join(gone, "id", "left")
    n = F.coalesce("merged", F.lit(0))
    rows = rows.withColumn("access_count", F.col("access_count") + n).withColumn("merged", n)
    return rows.withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).drop("_gone")


def consolidate(memories: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories with originals marked, links) for new memories ``merged`` (id, source_ids)."""
    links = merged.select(F.col("id").alias("consolidated_id"), F.posexplode("source_ids").alias("place", "original_id"))
    original = links.select(F.col("original_id").alias("id"), F.lit(True).alias("_original")).distinct()
    rows = memories.join(original, "id", "left")
    return rows.withColumn("is_consolidated_original", F.coalesce("_original", "is_consolidated_original")).drop("_original"), links


def stale(embeddings: DataFrame, model: str, version: str | None = None) -> DataFrame:
    """After a model switch: only vectors of the model (and version) stay current."""
    same = F.col("model_name") == model
    if version is not None:
        same &= F.col("model_version") == version
    return embeddings.withColumn("is_current", F.col("is_current") & F.coalesce(same, F.lit(False)))


def deactivated(embeddings: DataFrame, ids: DataFrame, tier: str) -> DataFrame:
    """Vectors of a tier stop being current for the memories of ``ids``."""
    hit = ids.select(F.col("id").alias("memory_id"), F.lit(True).alias("_hit")).distinct()
    rows = embeddings.join(hit, "memory_id", "left")
    return rows.withColumn("is_current", F.col("is_current") & ~(F.coalesce("_hit", F.lit(False)) & (F.col("tier") == tier))).drop("_hit")


def undo_run(memories: DataFrame, salience: DataFrame, actions: DataFrame, run_id: str, tag: str = "stale") -> tuple[DataFrame, DataFrame]:
    """(memories, salience) as before a curation run.

    ``actions`` (run_id, kind, memory_id, merged_id, stability): originals of
    ``merge`` live again and their merged memory goes, ``flag`` loses its tag,
    ``strengthen`` and ``flag`` have their old stability back if the action holds
    it. Quarantine is not undone.
    """
    own = actions.where(F.col("run_id") == run_id)
    of = own.groupBy(F.col("memory_id").alias("id")).agg(F.bool_or(F.col("kind") == "merge").alias("_back"), F.bool_or(F.col("kind") == "flag").alias("_flag"))
    made = own.where("kind = 'merge' and merged_id is not null").select(F.col("merged_id").alias("id")).distinct()
    rows = memories.join(made, "id", "left_anti").join(of, "id", "left")
    back, flag = F.coalesce("_back", F.lit(False)), F.coalesce("_flag", F.lit(False))
    rows = rows.withColumn("deleted_at", F.when(~back, F.col("deleted_at"))).withColumn("is_consolidated_original", F.col("is_consolidated_original") & ~back)
    rows = rows.withColumn("tags", F.when(flag, F.array_remove("tags", tag)).otherwise(F.col("tags"))).drop("_back", "_flag")
    old = own.where("kind in ('strengthen', 'flag')").groupBy("memory_id").agg(F.min("stability").alias("_old"))
    return rows, salience.join(old, "memory_id", "left").withColumn("stability", F.coalesce("_old", "stability")).drop("_old")


def off_topic(rows: DataFrame, topics: list[list[float]], least: float = 0.85, vector: str = "embedding") -> DataFrame:
    """Rows with ``dropped``: their vector is as near as ``least`` to a topic to be left out. No vector: kept."""
    near = [sc.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in t])) for t in topics]
    best = F.greatest(*near) if len(near) > 1 else near[0] if near else F.lit(None).cast("double")
    return rows.withColumn("dropped", F.coalesce(best >= least, F.lit(False)))


def best_of_tiers(legs: list[DataFrame]) -> DataFrame:
    """id and its best score over the hits of several embedding tiers."""
    out = legs[0].select("id", "score")
    for leg in legs[1:]:
        out = out.unionByName(leg.select("id", "score"))
    return out.groupBy("id").agg(F.max("score").alias("score"))
