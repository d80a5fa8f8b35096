"""Retention, deduplication, consolidation, curation and promotion.

State is append-only: an operator returns the rows to append or the new version
of a table, and the caller writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scoring as sc
from ..functions import text as tx
from . import search as se


def with_salience(memories: DataFrame, salience: DataFrame) -> DataFrame:
    """Memories with stability, reinforcement_count and last_reinforced_at; defaults where there is no state."""
    s = salience.select(F.col("memory_id").alias("_m"), "stability", "difficulty", "reinforcement_count", "last_reinforced_at")
    out = memories.join(s, F.col("id") == F.col("_m"), "left").drop("_m")
    return out.withColumn("stability", F.coalesce("stability", F.lit(1.0))).withColumn("difficulty", F.coalesce("difficulty", F.lit(5.0))).withColumn("reinforcement_count", F.coalesce("reinforcement_count", F.lit(0)))


def gc_candidates(memories: DataFrame, salience: DataFrame, now: Column, threshold: float = 0.3, min_age_days: int = 30, budget: int | None = None) -> DataFrame:
    """Weak, old, not superseded: the weakest first."""
    rows = with_salience(se.live(memories), salience)
    rows = rows.where((F.col("stability") < threshold) & (sc.days_between(now, F.col("created_at")) > min_age_days) & ~F.col("is_consolidated_original"))
    rows = rows.orderBy("stability", "id")
    return rows if budget is None else rows.limit(budget)


def expired(memories: DataFrame, now: Column) -> DataFrame:
    return se.live(memories).where(F.col("expires_at") < now)


def purgeable(memories: DataFrame, now: Column, grace_days: int = 30) -> DataFrame:
    return memories.where(sc.days_between(now, F.col("deleted_at")) > grace_days)


def orphans(memories: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of which a source is gone."""
    lost = memories.select("id", F.explode("source_ids").alias("s")).join(gone.select(F.col("id").alias("s")), "s", "left_semi").select("id").distinct()
    return memories.join(lost, "id", "left_semi")


def soft_delete(memories: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    marked = memories.join(gone.select("id", F.lit(True).alias("_gone")).distinct(), "id", "left")
    return marked.withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).drop("_gone")


def exact_copies(memories: DataFrame) -> DataFrame:
    """(hash, keeper, copies): rows of equal normalised content; the smallest id keeps."""
    rows = se.live(memories).where(F.col("content").isNotNull()).select("id", tx.content_hash(F.col("content")).alias("hash"))
    return rows.groupBy("hash").agg(F.min("id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1")


def dedup_pairs(embeddings: DataFrame, queries: DataFrame, least: float = 0.95) -> DataFrame:
    """Each row's best neighbour above the threshold: (memory_id, keeper, similarity)."""
    return se.neighbours(embeddings, queries, 1, least).select("memory_id", F.col("neighbour").alias("keeper"), "similarity")


def merged_text(neighbours: DataFrame, contents: DataFrame) -> DataFrame:
    """(memory_id, n, consolidated): the contents joined in order of similarity."""
    rows = neighbours.join(contents.select(F.col("id").alias("neighbour"), "content"), "neighbour")
    parts = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("Memory "), F.col("place").cast("string"), F.lit(":\n"), F.col("content")).alias("part"))))
    return rows.groupBy("memory_id").agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda x: x["part"]), "\n---\n").alias("consolidated"))


def curation_candidates(memories: DataFrame, salience: DataFrame, since: Column | None, limit: int | None = 500) -> DataFrame:
    """Live rows that no run has made, with their state; the oldest of them where there is a limit, else all in no order."""
    rows = with_salience(se.live(memories), salience).where(~F.col("is_consolidated_original")).where(~se.has_any(F.col("tags"), ["curated", "merged"]))
    if since is not None:
        rows = rows.where(F.col("created_at") > since)
    return rows if limit is None else rows.orderBy("created_at", "id").limit(limit)


def review(rows: DataFrame, now: Column, stale_below: float = 0.3, stale_days: int = 30) -> DataFrame:
    """(id, action): suspicious before stale before strengthen before skip."""
    age = F.floor(sc.days_between(now, F.col("created_at")))
    rest = F.floor(sc.days_between(now, F.col("last_reinforced_at")))
    stale = (F.col("stability") < stale_below) & (age > stale_days) & ((F.col("reinforcement_count") == 0) | F.col("last_reinforced_at").isNull() | (rest > stale_days))
    action = F.when(tx.is_suspicious(F.col("content"), F.col("trust_level")), "suspicious").when(stale, "stale").when((F.col("reinforcement_count") >= 3) & (F.col("stability") < 5.0), "strengthen").otherwise("skip")
    return rows.select("id", F.coalesce(action, F.lit("skip")).alias("action"))


def capped(actions: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The first actions of each kind by id, up to its cap (the feature of a curation run). Kinds without a cap are not sorted."""
    if not caps:
        return actions
    bound = F.coalesce(F.col("action").isin(*caps), F.lit(False))
    # the largest cap is the limit that every task applies before rows are dealt by kind
    place = F.row_number().over(Window.partitionBy("action").orderBy("id"))
    few = actions.where(bound).withColumn("_p", place).where(F.col("_p") <= max(caps.values()))
    cap = F.try_element_at(F.create_map(*[F.lit(x) for item in caps.items() for x in item]), F.col("action"))
    return few.where(F.col("_p") <= cap).drop("_p").unionByName(actions.where(~bound))


def greedy_clusters(edges: DataFrame, candidates: DataFrame, most: int = 5) -> DataFrame:
    """(cluster, id): seeds in order of (priority, id) absorb neighbours not yet absorbed; at most ``most`` a cluster.

    The order of visits decides, but only along edges: a row that no open row
    could absorb is a seed, and what it has an edge to is absorbed. Each round
    settles all such rows, and at least the first open one, and goes on with the
    rows and edges that are still open, so rounds get smaller and nothing is
    gathered in one task. Rows without a priority come last; of repeated edges the
    most similar counts.
    """
    spark = candidates.sparkSession
    folder = scratch.folder(spark)
    turn = F.struct(F.col("priority").isNull().alias("late"), "priority", "id")
    rows = candidates.groupBy("id").agg(F.min("priority").alias("priority")).select("id", turn.alias("turn"))
    arcs = edges.groupBy(F.col("memory_id").alias("u"), F.col("neighbour").alias("v")).agg(F.max("similarity").alias("s"))
    arcs = arcs.join(rows.select(F.col("id").alias("u"), F.col("turn").alias("tu")), "u").join(rows.select(F.col("id").alias("v"), F.col("turn").alias("tv")), "v")
    arcs = scratch.save(arcs.where("tu < tv").select("u", "v", "s", "tu"), f"{folder}/arcs")

    opened = scratch.save(arcs.select("u", "v"), f"{folder}/open0")
    # rows without edges are seeds at once
    met = opened.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    left = scratch.save(met, f"{folder}/left0")
    scratch.save(rows.select("id").join(met, "id", "left_anti"), f"{folder}/seeds0")
    number = 0
    while not left.isEmpty():
        number += 1
        seeds = scratch.save(left.join(opened.select(F.col("v").alias("id")), "id", "left_anti"), f"{folder}/seeds{number}")
        taken = opened.join(seeds.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("id")).distinct()
        done = scratch.save(seeds.unionByName(taken), f"{folder}/done{number}")
        left = scratch.save(left.join(done, "id", "left_anti"), f"{folder}/left{number}")
        opened = scratch.save(opened.join(done.select(F.col("id").alias("u")), "u", "left_anti").join(done.select(F.col("id").alias("v")), "v", "left_anti").select("u", "v"), f"{folder}/open{number}")
        for name in ("open", "left", "done"):
            scratch.drop(spark, f"{folder}/{name}{number - 1}")

    seeds = spark.read.schema("id string").parquet(*[f"{folder}/seeds{i}" for i in range(number + 1)]).select(F.col("id").alias("u"))
    absorbed = arcs.join(seeds, "u", "left_semi").groupBy("v").agg(F.min(F.struct("tu", "u", "s")).alias("by"))
    members = seeds.select("u", F.col("u").alias("id"), F.lit(0).alias("later"), F.lit(None).cast("double").alias("s")).union(absorbed.select("by.u", "v", F.lit(1), F.col("by.s").cast("double")))
    place = F.row_number().over(Window.partitionBy("u").orderBy("later", F.col("s").desc(), "id"))
    parts = members.withColumn("place", place).withColumn("part", F.floor((F.col("place") - 1) / most))
    return parts.select(F.first("id").over(Window.partitionBy("u", "part").orderBy("place")).alias("cluster"), "id")


def promotable(memories: DataFrame, embeddings: DataFrame, salience: DataFrame, tier: str = "fast", stability: float = 3.0, reinforcements: int = 4, cap: int | None = None) -> DataFrame:
    """Rows whose current vector is of ``tier`` and that are strong or often reinforced."""
    own = embeddings.where((F.col("tier") == tier) & F.col("is_current")).select(F.col("memory_id").alias("id")).distinct()
    rows = with_salience(se.live(memories), salience).join(own, "id", "left_semi").where((F.col("stability") >= stability) | (F.col("reinforcement_count") >= reinforcements)).orderBy(F.col("stability").desc(), "id")
    return rows if cap is None else rows.limit(cap)


def queue(memories: DataFrame, kind: str) -> DataFrame:
    """Rows a worker has to do, oldest first (enrichment: newest first)."""
    rows = se.live(memories)
    wanted = {
        "embedding": F.col("embedding_status").isin("pending", "failed") & (F.col("abstraction_status") != "pending"),
        "abstraction": F.col("abstraction_status") == "pending",
        "extraction": F.col("extraction_status") == "pending",
        "normalization": (F.col("normalization_status") == "pending") & (F.col("extraction_status") == "complete"),
        "enrichment": (F.col("embedding_status") == "complete") & ~se.has_any(F.col("tags"), ["enriched"]),
        "event_time": F.col("event_time").isNull() & (F.col("extraction_status") == "complete"),
    }[kind]
    newest = kind in ("enrichment", "event_time")
    return rows.where(wanted).orderBy(F.col("created_at").desc() if newest else F.col("created_at"), "id")


def boost_once(salience: DataFrame, audit: DataFrame, boosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply (run_id, memory_id, magnitude) boosts that the audit does not hold; return state and new audit rows."""
    new = boosts.dropDuplicates(["run_id", "memory_id"]).join(audit, ["run_id", "memory_id"], "left_anti")
    rows = new.join(salience, "memory_id").select("run_id", "memory_id", F.col("stability").alias("previous"), "magnitude")
    factor = rows.groupBy("memory_id").agg(F.product("magnitude").alias("_f"))
    state = salience.join(factor, "memory_id", "left").withColumn("stability", F.least(F.lit(36500.0), F.greatest(F.lit(0.1), F.col("stability") * F.coalesce("_f", F.lit(1.0))))).drop("_f")
    return state, rows


def revert(salience: DataFrame, audit: DataFrame, run_id: str) -> DataFrame:
    """Write a run's previous stabilities back."""
    old = audit.where(F.col("run_id") == run_id).groupBy("memory_id").agg(F.min("previous").alias("_old"))
    return salience.join(old, "memory_id", "left").withColumn("stability", F.coalesce("_old", "stability")).drop("_old")


def side_effects(final: DataFrame, tombstoned: DataFrame, discarded: DataFrame) -> DataFrame:
    """(id, factor): kept x1.3, tombstoned x0.1, discarded but not kept x0.9."""
    parts = final.select("id", F.lit(1.3).alias("factor")).unionByName(tombstoned.select("id", F.lit(0.1).alias("factor"))).unionByName(discarded.join(final.select("id"), "id", "left_anti").select("id", F.lit(0.9).alias("factor")))
    return parts.groupBy("id").agg(F.round(F.product("factor"), 6).alias("factor"))


def set_trust(memories: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """Apply (id, new_trust, reason) and append to the trust history."""
    rows = memories.join(changes.dropDuplicates(["id"]), "id", "left")
    entry = F.struct(F.col("trust_level").cast("double").alias("from"), F.col("new_trust").cast("double").alias("to"), "reason", at.alias("at"))
    has = F.col("new_trust").isNotNull()
    history = F.col("trust_history") if "trust_history" in memories.columns else F.array().cast("array<struct<from:double,to:double,reason:string,at:timestamp>>")
    return rows.withColumn("trust_history", F.when(has, F.array_append(history, entry)).otherwise(history)).withColumn("trust_level", F.coalesce("new_trust", "trust_level")).drop("new_trust", "reason")


def unquarantine(memories: DataFrame) -> DataFrame:
    """Take the marks off and restore the trust before the last quarantine (else 0.5)."""
    marked = se.has_any(F.col("tags"), se.NOT_SHOWN)
    last = F.try_element_at(F.filter("trust_history", lambda h: F.contains(h["reason"], F.lit("quarantined"))), F.lit(-1))["from"]
    tags = F.array_except("tags", F.array(*[F.lit(t) for t in se.NOT_SHOWN]))
    return memories.withColumn("trust_level", F.when(marked, F.coalesce(last, F.lit(0.5))).otherwise(F.col("trust_level"))).withColumn("tags", F.when(marked, tags).otherwise(F.col("tags")))
