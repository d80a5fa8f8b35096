"""Sinks: append, JSONL, CSV, Markdown, and the importing chain in front of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def append(df: DataFrame, path: str) -> None:
    """Spark's commit protocol makes the append all or nothing."""
    df.write.mode("append").parquet(path)


def to_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def graph_lines(entities: DataFrame, relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """JSON lines of a graph as the import reads them: entities, then relationships and facts with the names and types of their ends."""
    key = lambda prefix: entities.select(F.col("id").alias(f"{prefix}_id"), F.col("name").alias(prefix), F.col("entity_type").alias(f"{prefix}_type"))
    own = entities.select(F.lit("entity").alias("record_type"), "name", "entity_type", "aliases")
    edges = relationships.join(key("subject"), "subject_id").join(key("object"), "object_id").select(F.lit("relationship").alias("record_type"), "subject", "subject_type", "object", "object_type", "predicate")
    of = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity"), "entity_type")
    told = facts.join(of, "entity_id").select(F.lit("fact").alias("record_type"), "entity", "entity_type", "attribute", "value")
    lines = [x.select("record_type", F.to_json(F.struct("*")).alias("value")) for x in (own, edges, told)]
    return lines[0].unionByName(lines[1]).unionByName(lines[2])


def export_all(memories: DataFrame, entities: DataFrame, relationships: DataFrame, facts: DataFrame, path: str) -> None:
    """One JSONL export of memories and graph."""
    own = memories.select(F.to_json(F.struct("*")).alias("value"))
    own.unionByName(graph_lines(entities, relationships, facts).select("value")).write.mode("overwrite").text(path)


def to_csv(df: DataFrame, path: str) -> None:
    """Tags joined by spaces, RFC 4180 quotes."""
    flat = [F.array_join(c, " ").alias(c) if kind == "array<string>" else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def markdown_blocks(df: DataFrame) -> DataFrame:
    """(type_hint, place, value): blocks grouped by type, a heading before each group."""
    quoted = F.concat(F.lit("> "), F.replace("content", F.lit("\n"), F.lit("\n> ")))
    meta = F.concat(F.lit("\n\n*source: "), F.coalesce("source", F.lit("-")), F.lit(", tags: "), F.coalesce(F.array_join("tags", " "), F.lit("-")), F.lit("*\n"))
    rows = df.select(F.coalesce("type_hint", F.lit("other")).alias("type_hint"), F.lit(1).alias("part"), F.col("created_at").alias("at"), F.col("id").alias("id"), F.concat(quoted, meta).alias("value"))
    heads = rows.select("type_hint").distinct().select("type_hint", F.lit(0).alias("part"), F.lit(None).cast("timestamp").alias("at"), F.lit("").alias("id"), F.concat(F.lit("## "), F.col("type_hint"), F.lit("\n")).alias("value"))
    return heads.unionByName(rows)


def to_markdown(df: DataFrame, path: str) -> None:
    """Part files in order of type and time."""
    markdown_blocks(df).repartitionByRange("type_hint", "part", "at", "id").sortWithinPartitions("type_hint", "part", "at", "id").select("value").write.mode("overwrite").text(path)


def judged(chunks: DataFrame, stored: DataFrame, since: Column | None = None, noise: list[str] = ()) -> DataFrame:
    """Chunks with their hash and the reason to filter them, null for those to store: old, noise or known, the first that holds."""
    rows = chunks.withColumn("hash", tx.content_hash(F.col("content"))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    old = (F.col("created_at") < since) if since is not None else F.lit(False)
    known = stored.select(tx.content_hash(F.col("content")).alias("hash")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, "hash", "left")
    reason = F.when(F.coalesce(old, F.lit(False)), "old").when(tx.is_noise(F.col("content"), list(noise)), "noise").when(F.col("known"), "known")
    return rows.withColumn("reason", reason).drop("known")


def sorted_out(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rows filtered with a reason) of judged chunks; rows to store are tagged and of equal ones the first stays."""
    flagged = F.when(tx.import_injection(F.col("content")), F.array_union("tags", F.array(F.lit("warning:prompt-injection")))).otherwise(F.col("tags"))
    keep = rows.where(F.col("reason").isNull()).withColumn("tags", F.array_union(flagged, F.array(F.concat(F.lit("imported:"), F.coalesce("source", F.lit("unknown"))))))
    return keep.dropDuplicates(["hash"]).drop("reason"), rows.where(F.col("reason").isNotNull())


def import_chain(chunks: DataFrame, stored: DataFrame, since: Column | None = None, noise: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rows filtered with a reason).

    Old, noisy and known chunks are filtered, in that order; of equal new chunks
    the first stays. Injection phrases only add a tag. Who uses both saves what
    ``judged`` returns, so that contents are normalised and hashed once.
    """
    return sorted_out(judged(chunks, stored, since, noise))
