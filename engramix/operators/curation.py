"""One curation run, from candidates to the new tables.

Candidates are clustered along their similarity, clusters are decided (merge if
all members are weak, else row by row), decisions are capped, and the actions that
remain are applied to memories and salience under one run id. Ids of what a run
makes follow from the run, so a run that is repeated writes the same, and one that
the log holds as completed changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scoring as sc
from . import lifecycle as lc
from . import records as rc
from . import resolution
from . import search as se
from . import state

ACTIONS = "run_id string, kind string, memory_id string, merged_id string, stability double, created_at timestamp"
RUNS = "run_id string, at timestamp, status string, window_end timestamp, merged long, stale long, strengthened long, skipped long, error string"
#: Tags and trust of what a run marks.
STALE, STRENGTHENED, FLAGGED, REVIEWED, MERGED = "stale", "curated:strengthened", "curation:flagged", "curation:reviewed", "merged"
QUARANTINE_TRUST = 0.1


@dataclass(frozen=True)
class Policy:
    similarity: float = 0.85
    similar: int = 10
    group: int = 5
    weak: float = 1.0
    stale_below: float = 0.3
    stale_days: int = 30
    stale_target: float = 0.1
    merges: int | None = 20
    flags: int | None = 50
    strengthens: int | None = 50
    candidates: int | None = 500


def decide(clusters: DataFrame, rows: DataFrame, now: Column, policy: Policy = Policy()) -> DataFrame:
    """(cluster, id, kind): merge for all members of a cluster of 2 to ``group`` weak rows, else suspicious, flag, strengthen or skip by row."""
    of = clusters.join(rows, "id")
    size = of.groupBy("cluster").agg(F.count("*").alias("_n"), F.max("stability").alias("_most"))
    reviewed = lc.review(rows, now, policy.stale_below, policy.stale_days).withColumn("action", F.when(F.col("action") == "stale", "flag").otherwise(F.col("action")))
    merge = F.col("_n").between(2, policy.group) & (F.col("_most") < policy.weak)
    return clusters.join(size, "cluster").join(reviewed, "id").select("cluster", "id", F.when(merge, "merge").otherwise(F.col("action")).alias("kind"))


def capped(decided: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Decisions within the caps of a run, by cluster and id; merges are counted by cluster."""
    caps = {k: n for k, n in (("merge", policy.merges), ("flag", policy.flags), ("strengthen", policy.strengthens)) if n is not None}
    if not caps:
        return decided
    unit = F.when(F.col("kind") == "merge", F.col("cluster")).otherwise(F.concat_ws("/", "cluster", "id"))
    units = decided.select(unit.alias("id"), F.col("kind").alias("action")).distinct()
    kept = lc.capped(units, caps).select(F.col("id").alias("_unit"), F.col("action").alias("kind"))
    return decided.withColumn("_unit", unit).join(kept, ["_unit", "kind"]).drop("_unit")


def merged_rows(merges: DataFrame, rows: DataFrame, run_id: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new memories, their stability): one for each merged cluster: texts newest first, all tags, the largest stability."""
    own = merges.join(rows, "id")
    text = rc.merge_clusters(merges.select("cluster", "id"), rows).select("cluster", "content")
    tags = own.select("cluster", F.explode("tags").alias("tag")).distinct().groupBy("cluster").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    most = own.groupBy("cluster").agg(F.max("stability").alias("stability"))
    made = text.join(tags, "cluster", "left").join(most, "cluster").withColumn("id", resolution.made_id(F.lit(run_id), F.col("cluster")))
    new = made.select("id", "content", F.lit("curated").alias("type_hint"), F.lit("curation").alias("source"), F.array_append(F.coalesce("tags", F.array().cast("array<string>")), F.lit(MERGED)).alias("tags"), now.alias("created_at"), now.alias("updated_at"), F.lit("system").alias("actor_type"), F.lit("global").alias("audience"), F.lit("curation_merge").alias("write_path"), F.lit(False).alias("is_consolidated_original"), F.lit(0).cast("long").alias("access_count"), F.lit("pending").alias("embedding_status"))
    return new, made.select(F.col("id").alias("memory_id"), "stability", "cluster")


def applied(memories: DataFrame, salience: DataFrame, actions: DataFrame, now: Column, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """Memories and salience after actions on existing rows: an action a row."""
    kind = actions.select(F.col("memory_id").alias("id"), F.col("kind").alias("_kind"))
    rows = memories.join(kind, "id", "left")
    tag = F.when(F.col("_kind") == "flag", STALE).when(F.col("_kind") == "strengthen", STRENGTHENED).when(F.col("_kind") == "suspicious", FLAGGED).when(F.col("_kind") == "skip", REVIEWED)
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    marked = F.when(tag.isNotNull() & ~F.array_contains(tags, tag), F.array_append(tags, tag)).otherwise(F.col("tags"))
    rows = rows.withColumn("tags", marked).withColumn("deleted_at", F.when((F.col("_kind") == "merge") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at")))
    doubted = actions.where("kind = 'suspicious'").select(F.col("memory_id").alias("id"), F.lit(QUARANTINE_TRUST).alias("new_trust"), F.lit("quarantined: curation").alias("reason"))
    rows = lc.set_trust(rows.drop("_kind"), doubted, now)
    old = lc.with_salience(memories.select("id"), salience)
    days = F.when(F.col("last_reinforced_at").isNull(), sc.NEVER_REINFORCED_DAYS).otherwise(sc.days_between(now, F.col("last_reinforced_at")))
    touched = actions.where("kind in ('flag', 'strengthen')").select(F.col("memory_id").alias("id"), "kind").join(old, "id")
    strong = F.col("kind") == "strengthen"
    new = touched.select(F.col("id").alias("memory_id"), F.when(strong, sc.reinforced(F.col("stability"), days, F.lit("good"))).otherwise(policy.stale_target).alias("stability"), "difficulty", (F.col("reinforcement_count") + strong.cast("long")).alias("reinforcement_count"), F.when(strong, now).otherwise(F.col("last_reinforced_at")).alias("last_reinforced_at"))
    return rows, salience.join(new.select("memory_id"), "memory_id", "left_anti").select("memory_id", "stability", "difficulty", "reinforcement_count", "last_reinforced_at").unionByName(new)


def run(memories: DataFrame, embeddings: DataFrame, salience: DataFrame, runs: DataFrame, actions: DataFrame, run_id: str, now: Column, policy: Policy = Policy()) -> dict[str, DataFrame]:
    """The four tables after a run: memories, salience, runs (a log) and actions.

    The window begins where the last completed run's ended. A run that has no
    candidates is logged as such. Rows that a run deletes or makes keep to its id.
    """
    spark = memories.sparkSession
    done = runs.where((F.col("run_id") == run_id) & (F.col("status") == "completed")).limit(1).count()
    if done:
        return {"memories": memories, "salience": salience, "runs": runs, "actions": actions}
    folder = scratch.folder(spark)
    since = rc.last_window(rc.run_log(runs)).first()[0]
    picked = lc.curation_candidates(memories, salience, None if since is None else F.lit(since), policy.candidates)
    priority = sc.priority(F.col("trust_level"), sc.days_between(now, F.col("created_at")) * 1440)
    rows = scratch.save(picked.withColumn("priority", priority), f"{folder}/candidates")
    vectors = embeddings.where("is_current").join(rows.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("memory_id", "embedding")
    vectors = scratch.save(vectors, f"{folder}/vectors")
    edges = se.neighbours(vectors, vectors, policy.similar, policy.similarity)
    clusters = scratch.save(lc.greedy_clusters(edges, rows.select("id", "priority"), policy.group), f"{folder}/clusters")
    # texts are judged once, the caps read what was decided
    decided = scratch.save(decide(clusters, rows, now, policy), f"{folder}/judged")
    kept = scratch.save(capped(decided, policy), f"{folder}/decided")
    merges = kept.where("kind = 'merge'")
    new, strength = merged_rows(merges, rows, run_id, now)
    told = kept.join(rows.select("id", "stability"), "id").select(F.lit(run_id).alias("run_id"), "kind", F.col("id").alias("memory_id"), F.when(F.col("kind") == "merge", resolution.made_id(F.lit(run_id), F.col("cluster"))).alias("merged_id"), F.col("stability").cast("double").alias("stability"), now.alias("created_at"))
    told = scratch.save(told, f"{folder}/actions")
    changed, state = applied(memories, salience, told, now, policy)
    changed = changed.unionByName(new, allowMissingColumns=True)
    state = state.unionByName(strength.select("memory_id", "stability"), allowMissingColumns=True)
    n = {k: F.count_if(F.col("kind") == k) for k in ("flag", "strengthen", "skip")}
    merged = F.count_distinct(F.when(F.col("kind") == "merge", F.col("merged_id")))
    log = told.agg(F.lit(run_id).alias("run_id"), now.alias("at"), F.lit("completed").alias("status"), now.alias("window_end"), merged.alias("merged"), n["flag"].alias("stale"), n["strengthen"].alias("strengthened"), n["skip"].alias("skipped"), F.lit(None).cast("string").alias("error"))
    return {"memories": changed, "salience": state, "runs": runs.unionByName(log), "actions": actions.unionByName(told)}


def undo(memories: DataFrame, salience: DataFrame, actions: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(memories, salience) without what a run merged, flagged and strengthened; quarantine and review marks stay."""
    rows, strength = state.undo_run(memories, salience, actions, run_id, STALE)
    made = actions.where((F.col("run_id") == run_id) & (F.col("kind") == "merge")).select(F.col("merged_id").alias("memory_id")).distinct()
    strong = actions.where((F.col("run_id") == run_id) & (F.col("kind") == "strengthen")).select(F.col("memory_id").alias("id")).distinct()
    marked = rows.join(strong.withColumn("_strong", F.lit(True)), "id", "left")
    return marked.withColumn("tags", F.when(F.col("_strong"), F.array_remove("tags", STRENGTHENED)).otherwise(F.col("tags"))).drop("_strong"), strength.join(made, "memory_id", "left_anti")
