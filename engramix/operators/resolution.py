"""Extracted names and facts become entities, mentions and facts.

A name is found among the names, then the aliases, of the entities, in lower
case; what is not found is made, with an id that follows from its name and type.
Ids of mentions and facts follow from what they hold, so a repeated run makes the
same rows and adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Fixed value: confidence of facts that an extraction told.
CONFIDENCE = 0.7
SNIPPET = 200


def made_id(*parts: Column) -> Column:
    """An id in the form of a UUID that follows from the parts."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def names(rows: DataFrame) -> DataFrame:
    """(memory_id, place, raw, name) of (id, entities); names are trimmed and in lower case, empty ones left out."""
    each = rows.select(F.col("id").alias("memory_id"), F.posexplode("entities").alias("place", "raw"))
    return each.withColumn("raw", F.trim("raw")).withColumn("name", F.lower("raw")).where("name <> ''")


def lookup(entities: DataFrame) -> DataFrame:
    """(name, entity_id): the entity that a name or alias means: by name before alias, then the smallest id."""
    own = entities.select(F.lower("name").alias("name"), F.col("id").alias("entity_id"), F.lit(0).alias("by"))
    other = entities.select(F.explode("aliases").alias("name"), F.col("id").alias("entity_id")).select(F.lower("name").alias("name"), "entity_id", F.lit(1).alias("by"))
    return own.unionByName(other).where("name is not null").groupBy("name").agg(F.min(F.struct("by", "entity_id")).alias("m")).select("name", F.col("m.entity_id").alias("entity_id"))


def new_entities(found: DataFrame, entities: DataFrame, now: Column) -> DataFrame:
    """Entities to be made for names that none has; the type is told by the first mention, in order of memory and place."""
    first = found.groupBy("name").agg(F.min(F.struct("memory_id", "place", "raw")).alias("m"))
    unknown = first.join(lookup(entities).select("name"), "name", "left_anti")
    kind = tx.entity_type(F.col("m.raw"))
    return unknown.select(made_id(F.col("name"), kind).alias("id"), "name", kind.alias("entity_type"), F.array().cast("array<string>").alias("aliases"), now.alias("last_seen_at"))


def mentions(found: DataFrame, known: DataFrame, contents: DataFrame, now: Column) -> DataFrame:
    """(id, entity_id, memory_id, snippet, created_at): one for each name of a memory, with the text's beginning."""
    rows = found.join(known, "name").join(contents.select(F.col("id").alias("memory_id"), F.substring("content", 1, SNIPPET).alias("snippet")), "memory_id", "left")
    return rows.select(made_id(F.lit("mention"), F.col("entity_id"), F.col("memory_id"), F.col("place")).alias("id"), "entity_id", "memory_id", "snippet", now.alias("created_at"))


def facts(rows: DataFrame, known: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(facts, skipped) of (id, entities, facts, structured).

    Where a memory has structured facts, each belongs to the entity it names, and
    one that names an unknown entity is skipped; else its flat facts belong to its
    first name. Equal facts of a memory are one.
    """
    structured = rows.where(F.size("structured") > 0).select("id", F.explode("structured").alias("f")).select(F.col("id").alias("memory_id"), F.lower(F.trim("f.entity")).alias("name"), F.lower(F.trim("f.attribute")).alias("attribute"), F.col("f.value").alias("value"))
    attribute, value = tx.fact(F.trim("raw"))
    flat = rows.where((F.coalesce(F.size("structured"), F.lit(0)) <= 0) & (F.size("entities") > 0)).select(F.col("id").alias("memory_id"), F.lower(F.trim(F.col("entities")[0])).alias("name"), F.explode("facts").alias("raw")).where(F.trim("raw") != "")
    flat = flat.select("memory_id", "name", F.lower(attribute).alias("attribute"), value.alias("value"))
    told = structured.unionByName(flat).where("name <> ''").join(known, "name", "left")
    made = told.where(F.col("entity_id").isNotNull()).select(made_id(F.lit("fact"), *[F.col(c) for c in ("entity_id", "attribute", "value", "memory_id")]).alias("id"), "entity_id", "attribute", "value", now.alias("valid_from"), F.lit(None).cast("timestamp").alias("invalid_at"), F.col("memory_id").alias("source_memory_id"), F.lit(CONFIDENCE).alias("confidence"))
    return made.dropDuplicates(["id"]), told.where(F.col("entity_id").isNull()).select("memory_id", "name", "attribute", "value")


def resolve(rows: DataFrame, entities: DataFrame, now: Column, old_mentions: DataFrame | None = None, old_facts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rows to append to entities, entity_mentions and entity_facts, and facts that were skipped, for (id, content, entities, facts, structured)."""
    found = names(rows)
    new = new_entities(found, entities, now)
    known = lookup(entities).unionByName(new.select("name", F.col("id").alias("entity_id")))
    told, skipped = facts(rows, known, now)
    seen = mentions(found, known, rows, now)
    if old_mentions is not None:
        seen = seen.join(old_mentions.select("id"), "id", "left_anti")
    if old_facts is not None:
        told = told.join(old_facts.select("id"), "id", "left_anti")
    return {"entities": new, "entity_mentions": seen, "entity_facts": told, "skipped": skipped}


def supersede(old: DataFrame, now: Column) -> DataFrame:
    """Facts where of the values of an entity's attribute only the newest stays active; older ones are closed.

    Of facts of equal time the one of the largest id is the newest; facts of the
    newest value stay all.
    """
    last = old.where("invalid_at is null").groupBy("entity_id", "attribute").agg(F.max_by("value", F.struct("valid_from", "id")).alias("_value"))
    rows = old.join(last, ["entity_id", "attribute"], "left")
    return rows.withColumn("invalid_at", F.when(F.col("invalid_at").isNull() & ~F.col("value").eqNullSafe(F.col("_value")), now).otherwise(F.col("invalid_at"))).select(*old.columns)


def merge_entities(entities: DataFrame) -> DataFrame:
    """Entities of equal name (in lower case) and type as one: the smallest id, all aliases, first and last times.

    Aliases are told apart before they are gathered, so a list holds an entity's own only.
    """
    rows = entities.withColumn("_name", F.lower("name"))
    of = rows.groupBy("_name", "entity_type").agg(F.min("id").alias("id"), F.min_by("name", "id").alias("name"), F.max("last_seen_at").alias("last_seen_at"))
    each = rows.select("_name", "entity_type", F.explode("aliases").alias("a")).distinct().groupBy("_name", "entity_type").agg(F.array_sort(F.collect_list("a")).alias("aliases"))
    return of.join(each, ["_name", "entity_type"], "left").select("id", "name", "entity_type", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "last_seen_at")
