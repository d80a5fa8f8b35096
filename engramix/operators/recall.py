"""Session recall: what a session has not seen yet, by relevance, boosts and trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as sc
from . import search as se
from .state import best_of_tiers


def unseen(memories: DataFrame, recalls: DataFrame, session: str) -> DataFrame:
    """Rows the session has not recalled."""
    seen = recalls.where(F.col("session_id") == session).select(F.col("memory_id").alias("id"))
    return memories.join(seen, "id", "left_anti")


def one_fact_each(memories: DataFrame) -> DataFrame:
    """(id, fact): the first extracted fact of each row."""
    facts = memories.select("id", F.posexplode("facts").alias("pos", "fact"))
    return facts.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("r = 1").select("id", "fact")


def boosted(rows: DataFrame, explicit: list[str], session_tags: list[str]) -> DataFrame:
    """relevance with tag boosts, times trust."""
    extra = sc.tag_boost(explicit, F.col("tags"), 0.1, 0.3) + sc.tag_boost(session_tags, F.col("tags"), 0.05, 0.15)
    return rows.withColumn("boosted", F.round((F.col("relevance") + extra) * F.greatest(F.col("trust_level"), F.lit(0.05)), 6))


def by_vector(memories: DataFrame, embeddings: DataFrame, salience: DataFrame, recalls: DataFrame, session: str, vector: Column | dict[str, Column], least: float = 0.7, limit: int = 3, explicit: list[str] = (), session_tags: list[str] = ()) -> DataFrame:
    """id, fact, relevance, boosted of the best unseen rows. ``vector`` may map embedding tiers to vectors: then the largest relevance counts."""
    rows = unseen(se.tier_filter(se.searchable(memories), None), recalls, session)
    found = best_of_tiers([se.vector_hits(rows, embeddings, v, tier) for tier, v in vector.items()]) if isinstance(vector, dict) else se.vector_hits(rows, embeddings, vector)
    hits = found.withColumnRenamed("score", "relevance").where(F.col("relevance") >= least)
    rows = hits.join(rows.select("id", "tags", "trust_level"), "id").join(one_fact_each(memories), "id").join(salience.select(F.col("memory_id").alias("id"), "stability"), "id", "left")
    top = rows.withColumn("stability", F.coalesce("stability", F.lit(1.0))).orderBy(F.col("relevance").desc(), F.col("stability").desc(), "id").limit(limit)
    return boosted(top, list(explicit), list(session_tags)).select("id", "fact", "relevance", "stability", "boosted").orderBy(F.col("boosted").desc(), "id")


def by_salience(memories: DataFrame, salience: DataFrame, recalls: DataFrame, session: str, now: Column, limit: int = 3, explicit: list[str] = (), session_tags: list[str] = ()) -> DataFrame:
    """Without a query: three times as many by (stability, updated), then salience, boosts and trust."""
    rows = unseen(se.searchable(memories), recalls, session).where(~se.has_any(F.col("tags"), ["project-summary"]))
    rows = rows.join(salience, F.col("id") == F.col("memory_id"), "left").withColumn("stability", F.coalesce("stability", F.lit(1.0)))
    top = rows.orderBy(F.col("stability").desc(), F.col("updated_at").desc(), "id").limit(3 * limit)
    last = F.when(F.col("last_reinforced_at").isNull(), sc.NEVER_REINFORCED_DAYS).otherwise(sc.days_between(now, F.col("last_reinforced_at")))
    top = top.withColumn("relevance", sc.salience(sc.days_between(now, F.col("updated_at")), F.col("access_count"), F.lit(1.0), F.col("stability"), last))
    return boosted(top, list(explicit), list(session_tags)).select("id", F.round("relevance", 6).alias("relevance"), "boosted").orderBy(F.col("boosted").desc(), "id").limit(limit)


def record(recalls: DataFrame, found: DataFrame, session: str, at: Column) -> DataFrame:
    """The session's recalls with the new ones; the first recall of a row stays."""
    new = found.select(F.lit(session).alias("session_id"), F.col("id").alias("memory_id"), at.alias("recalled_at"))
    return recalls.unionByName(new).groupBy("session_id", "memory_id").agg(F.min("recalled_at").alias("recalled_at"))


def latest_summary(memories: DataFrame, project: str | None) -> DataFrame:
    """The newest project summary."""
    rows = se.project_scope(se.live(memories), project).where(se.has_any(F.col("tags"), ["project-summary"]))
    return rows.orderBy(F.col("updated_at").desc(), "id").limit(1).select("id", "content")
