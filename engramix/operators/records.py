"""Writes of single columns, run and action logs, mentions, export with vectors, result shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import records as rf
from ..functions import sentences
from ..functions import text as tx

#: What narrates the use of tools instead of saying something.
NARRATION = [
    r"(?i)^let me (read|check|look at|search|find|edit|write|run|execute|open|examine)",
    r"(?i)^now i('ll| will) (read|check|look|search|find|edit|write|run|execute)",
    r"(?i)^(reading|writing|editing|searching|checking|running|executing|looking at) (the |a )?(file|code|test|command|script|directory)",
    r"(?i)^i('ll| will) (start by|begin by|go ahead and|proceed to) ",
    r"(?i)^(here's|here is) (what i found|the output|the result)",
]


def set_status(memories: DataFrame, written: DataFrame, column: str) -> DataFrame:
    """``column`` as ``written`` (id, status) says; other rows and updated_at stay. The last write of an id counts."""
    last = written.groupBy("id").agg(F.max_by("status", "at").alias("_status"))
    return memories.join(last, "id", "left").withColumn(column, F.coalesce("_status", column)).drop("_status")


def _last_write(written: DataFrame, *columns: str) -> DataFrame:
    """One write an id: of several the one of the last ``at``, if there is such a column, else the largest."""
    order = F.struct(*[F.col(c) for c in (("at", *columns) if "at" in written.columns else columns)])
    return written.groupBy("id").agg(F.max_by(F.struct(*columns), order).alias("_w"))


def set_abstraction(memories: DataFrame, written: DataFrame, now: Column) -> DataFrame:
    """Abstract, overview and status of ``written`` (id, abstract, overview, status); bumps updated_at. Other rows stay; one write an id counts."""
    rows = memories.join(_last_write(written.where("status is not null"), "abstract", "overview", "status"), "id", "left")
    hit = F.col("_w").isNotNull()
    for column, value in (("abstract_text", "abstract"), ("overview_text", "overview"), ("abstraction_status", "status")):
        rows = rows.withColumn(column, F.when(hit, F.col(f"_w.{value}")).otherwise(F.col(column)))
    return rows.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).drop("_w")


def set_event_time(memories: DataFrame, written: DataFrame) -> DataFrame:
    """Event time and precision of ``written`` (id, time, precision); rows that are not written, or without a time, keep both. One write an id counts."""
    rows = memories.join(_last_write(written.where("time is not null"), "time", "precision"), "id", "left")
    hit = F.col("_w").isNotNull()
    old = F.col("event_time_precision") if "event_time_precision" in memories.columns else F.lit(None).cast("string")
    return rows.withColumn("event_time", F.when(hit, F.col("_w.time")).otherwise(F.col("event_time"))).withColumn("event_time_precision", F.when(hit, F.col("_w.precision")).otherwise(old)).drop("_w")


def set_stability(salience: DataFrame, written: DataFrame) -> DataFrame:
    """Stability of ``written`` (memory_id, stability); rows without state are added with the defaults."""
    w = written.select("memory_id", F.col("stability").alias("_s"))
    rows = salience.join(w, "memory_id", "full")
    return rows.select("memory_id", F.coalesce("_s", "stability").alias("stability"), F.coalesce("difficulty", F.lit(5.0)).alias("difficulty"), F.coalesce("reinforcement_count", F.lit(0)).alias("reinforcement_count"), "last_reinforced_at")


def touched_implicitly(salience: DataFrame, seen: DataFrame) -> DataFrame:
    """Stability times 1.1 for every id in ``seen`` (memory_id), or 1.1 where there was no state; not clamped."""
    hit = seen.select("memory_id", F.lit(True).alias("_hit")).distinct()
    rows = salience.select("memory_id", "stability").join(hit, "memory_id", "full")
    return rows.select("memory_id", F.when(F.col("_hit"), F.coalesce(F.col("stability") * 1.1, F.lit(1.1))).otherwise(F.col("stability")).alias("stability"))


def live_keys(keys: DataFrame, now: Column) -> DataFrame:
    """Idempotency keys that have not expired."""
    return keys.where(F.col("expires_at") > now)


def run_log(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs from an append-only log (run_id, at, status, window_end, merged, stale, strengthened, skipped, error), newest start first.

    A run starts with status 'running'; its last row completes or fails it.
    """
    own = events.groupBy("run_id").agg(F.min("at").alias("started_at"), F.max_by(F.struct("status", "window_end", "merged", "stale", "strengthened", "skipped", "error", "at"), F.struct("at", F.col("status") != "running")).alias("last"))
    done = F.col("last.status") != "running"
    rows = own.select("run_id", "started_at", F.when(done, F.col("last.at")).alias("completed_at"), "last.status", "last.window_end", *[F.coalesce(f"last.{c}", F.lit(0)).alias(c) for c in ("merged", "stale", "strengthened", "skipped")], "last.error")
    rows = rows.orderBy(F.col("started_at").desc(), "run_id")
    return rows if limit is None else rows.limit(limit)


def last_window(runs: DataFrame) -> DataFrame:
    """One row: window_end of the newest completed run, or null."""
    return runs.agg(F.max_by(F.when(F.col("status") == "completed", F.col("window_end")), F.when(F.col("status") == "completed", F.struct("completed_at", "run_id"))).alias("window_end"))


def action_log(actions: DataFrame, run_id: str) -> DataFrame:
    """What a run did, oldest first."""
    return actions.where(F.col("run_id") == run_id).orderBy("created_at", "memory_id")


def merge_counter(actions: DataFrame) -> DataFrame:
    """One row: merges so far."""
    return actions.agg(F.count_if(F.col("action") == "merge").alias("merges"))


def mentions_of(mentions: DataFrame, memories: DataFrame, entity_id: str) -> DataFrame:
    """Mentions of an entity in live memories, newest first."""
    own = mentions.where(F.col("entity_id") == entity_id).join(memories.where("deleted_at is null").select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    return own.orderBy(F.col("created_at").desc(), "id")


def get_batch(memories: DataFrame, wanted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, missing) for ids wanted (id): live rows, touched, and ids of which none lives. Repeated ids are one."""
    ids = wanted.select("id").distinct()
    rows = memories.where("deleted_at is null").join(ids, "id", "left_semi")
    touched = rows.withColumn("access_count", F.col("access_count") + 1).withColumn("last_accessed_at", now)
    return touched, ids.join(rows.select("id"), "id", "left_anti")


def percentiles(rows: DataFrame, key: str, value: str, *shares: float) -> DataFrame:
    """(key, p50, ...): exact percentiles, the value at place ceil(share * n) of each key's values in order.

    Equal values are counted before the shuffle, so a key's task sees its
    distinct values, in a sort that can spill. Null values do not count; a key
    with no value has no row, a null key is a key.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    total = counts.groupBy(F.col(key).alias("_key")).agg(F.sum("_n").alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).join(total, F.col(key).eqNullSafe(F.col("_key")))
    return placed.groupBy(key).agg(*[F.min(F.when(F.col("_upto") >= F.lit(p) * F.col("_all"), F.col(value))).alias(f"p{round(p * 100)}") for p in shares])


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Rows with their place, from 1, in an order: counted in sorted ranges, each starting after those before it.

    Where the order ties, equal rows stand in any order; give a unique last column.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
    saved = scratch.save(placed, scratch.folder(rows.sparkSession))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = saved.groupBy("_part").agg(F.count("*").alias("_size")).select("_part", before.alias("_before"))  # one row a range
    return saved.join(starts, "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def fact_formats(memories: DataFrame, facts: str) -> DataFrame:
    """One row: how many rows with finished extraction hold structured facts, flat ones and none, by the JSON of ``facts``."""
    structured = F.col(facts).contains('"entity"')
    return memories.where("extraction_status = 'complete'").agg(F.count_if(structured).alias("structured"), F.count_if(~structured).alias("flat"), F.count_if(F.col(facts).isNull()).alias("without"))


def benchmark_report(results: DataFrame) -> DataFrame:
    """A row a category and one over all (category null) of (category, correct, latency_ms, found, evidence).

    accuracy, the mean of the categories' accuracies (over all only), retrieval
    recall, mean latency in whole milliseconds and the latency at place ceil(0.95 n).
    """

    def measures():
        correct, n = F.count_if("correct"), F.count("*")
        found, evidence = F.sum("found"), F.sum("evidence")
        return [n.alias("total"), correct.alias("correct"), (correct / n).alias("accuracy"), F.when(evidence > 0, found / evidence).otherwise(0.0).alias("recall"), F.floor(F.avg("latency_ms")).alias("mean_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").cast("long").alias("p95_ms")]

    each = results.groupBy("category").agg(*measures())
    whole = results.agg(*measures()).where("total > 0").select(F.lit(None).cast("string").alias("category"), "*").join(F.broadcast(each.agg(F.avg("accuracy").alias("task_averaged"))))  # one row each
    return each.withColumn("task_averaged", F.lit(None).cast("double")).unionByName(whole)


def with_vectors(memories: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Rows with their current vector and its model, null where there is none."""
    current = embeddings.where("is_current").groupBy("memory_id").agg(F.max_by(F.struct("embedding", "model_name"), F.struct("model_name", "tier")).alias("_e"))
    return memories.join(current, F.col("id") == F.col("memory_id"), "left").withColumn("embedding", F.col("_e.embedding")).withColumn("embedding_model", F.col("_e.model_name")).drop("_e", "memory_id")


def project(rows: DataFrame, fields: list[str] | None) -> DataFrame:
    """Only the columns asked for; 'a.b' keeps field b within a struct a. Unknown and deeper names are left out."""
    if not fields:
        return rows
    kept: dict[str, list[str] | None] = {}
    for f in fields:
        head, _, rest = f.partition(".")
        if head not in rows.columns or "." in rest:
            continue
        if not rest:
            kept[head] = None
        elif kept.get(head, []) is not None:
            kind = rows.schema[head].dataType
            if rest in getattr(kind, "names", []):
                kept.setdefault(head, []).append(rest)
    return rows.select(*[F.col(f"`{c}`") if inner is None else F.struct(*[F.col(f"`{c}`")[i].alias(i) for i in inner]).alias(c) for c, inner in kept.items()])


def salient(hits: DataFrame, least: float) -> DataFrame:
    """Hits of at least a salience score; 0 keeps all."""
    return hits if least <= 0 else hits.where(F.col("salience") >= least)


def narrates(text: Column, category: Column | None = None, dropped: tuple[str, ...] = ("tool_narration",)) -> Column:
    """Whether to drop a text: by a classifier's category if there is one, else if it narrates the use of tools."""
    hit = F.lit(False)
    for p in NARRATION:
        hit = hit | F.coalesce(text.rlike(p), F.lit(False))
    return hit if category is None else F.when(category.isNotNull(), category.isin(*dropped)).otherwise(hit)


def retagged(tags: Column, add: list[str], remove: list[str]) -> Column:
    """struct(tags, added, removed) after tags are added and removed; what is to be both stays out."""
    own = F.coalesce(tags, F.array().cast("array<string>"))
    gone = F.array(*[F.lit(t) for t in remove]).cast("array<string>")
    new = F.array_except(F.array(*[F.lit(t) for t in add]).cast("array<string>"), gone)
    return F.struct(F.array_except(F.array_union(own, new), gone).alias("tags"), F.array_except(new, own).alias("added"), F.array_intersect(own, gone).alias("removed"))


def content_filter(text: Column, patterns: dict[str, str], off_topic: Column | None = None) -> Column:
    """Name of the first filter that hits, or null: patterns in their order, then the topic."""
    out = None
    for name, p in patterns.items():
        out = F.when(text.rlike(p), name) if out is None else out.when(text.rlike(p), name)
    if off_topic is not None:
        out = F.when(off_topic, "topic") if out is None else out.when(off_topic, "topic")
    return F.lit(None).cast("string") if out is None else out


def audit(memories: DataFrame) -> DataFrame:
    """(id, violation): what is missing of a quarantined row: tag, trust of 0.05, history."""
    checks = F.array(
        F.when(~F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "suspicious"), "missing_tag"),
        F.when(~F.coalesce(F.abs(F.col("trust_level") - 0.05) <= 0.001, F.lit(False)), "wrong_trust"),
        F.when(F.col("trust_history").isNull(), "missing_history"),
    )
    return memories.select("id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("violation"))


def latest_import(history: DataFrame) -> DataFrame:
    """The last record of each source."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.col("at").desc(), "id"))
    return history.withColumn("_p", place).where("_p = 1").drop("_p")


def rescue(filtered: DataFrame, ids: DataFrame) -> DataFrame:
    """Filtered items with those of ``ids`` marked rescued."""
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return filtered.join(hit, "id", "left").withColumn("rescued", F.coalesce("_hit", "rescued", F.lit(False))).drop("_hit")


def spans_of(memories: DataFrame, topic: str, **limits) -> DataFrame:
    """(id, start, end, similarity): the bytes of each text that fit a topic best; texts without content have none."""
    rows = memories.where(F.col("content").isNotNull())
    return rows.select("id", sentences.span(F.col("content"), topic, **limits).alias("s")).select("id", "s.*")


def merge_clusters(clusters: DataFrame, memories: DataFrame) -> DataFrame:
    """(cluster, members, content): texts of clusters (cluster, id) merged, newest first. Clusters are small by their making."""
    rows = clusters.join(memories.select("id", "created_at", "content"), "id")
    return rows.groupBy("cluster").agg(F.count("*").alias("members"), rf.merged_text(F.collect_list(F.struct("created_at", "id", "content"))).alias("content"))


def suspicious_report(rows: DataFrame) -> DataFrame:
    """(id, signals, suspicious) of every row."""
    return rows.select("id", F.size(tx.injection_signals(F.col("content"))).alias("signals"), F.coalesce(tx.is_suspicious(F.col("content"), F.col("trust_level")), F.lit(False)).alias("suspicious"))
