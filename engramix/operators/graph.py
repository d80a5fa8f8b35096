"""Knowledge graph: traversal, contradictions, facts as of a time, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("invalid_at").isNull())


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, predicate): every edge in both directions, so traversal is an equi-join."""
    e = edges.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"), "predicate")
    return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "predicate"))


def _hop(reached: DataFrame, links: DataFrame, hop: int, start: str, node: str) -> DataFrame:
    """reached (start, node, hops) with what lies one hop beyond its last ring.

    Reached rows are kept beside the new ones in one left join, so every hop
    stands once in the plan.
    """
    onward = links.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    rows = reached.join(onward, (F.col(node) == F.col("_a")) & (F.col("hops") == hop - 1), "left")
    old, new = F.struct(F.col(node).alias("n"), "hops"), F.struct(F.col("_b").alias("n"), F.lit(hop).alias("hops"))
    both = rows.select(start, F.explode(F.when(F.col("_b").isNull(), F.array(old)).otherwise(F.array(old, new))).alias("_x"))
    return both.groupBy(start, F.col("_x.n").alias(node)).agg(F.min("_x.hops").alias("hops"))


def traverse(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hops): nodes within ``depth`` hops of each seed, by their least number of hops.

    Only the last ring grows: as many joins as hops, no paths are kept.
    """
    links = both_ways(active(edges)).select("a", "b").distinct()
    reached = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("hops"))
    for hop in range(1, depth + 1):
        reached = _hop(reached, links, hop, "seed", "node")
    return reached.where("hops > 0")


def find_entity(entities: DataFrame, name: str) -> DataFrame:
    """By name or alias, whatever the case; the least id of several."""
    low = name.lower()
    return entities.where((F.lower("name") == low) | F.array_contains(F.transform("aliases", F.lower), low)).orderBy("id").limit(1)


def scalar_contradictions(facts: DataFrame) -> DataFrame:
    """(entity_id, attribute, n_values): attributes with more than one active value."""
    return active(facts).groupBy("entity_id", "attribute").agg(F.count_distinct("value").alias("n_values"), F.count("*").alias("n_facts")).where("n_facts > 1")


def relationship_contradictions(edges: DataFrame, opposites: DataFrame) -> DataFrame:
    """Pairs of active edges between the same two that oppose each other."""
    x = active(edges).select("subject_id", "object_id", F.col("id").alias("first"), F.col("predicate").alias("predicate_a"))
    y = active(edges).select("subject_id", "object_id", F.col("id").alias("second"), F.col("predicate").alias("predicate_b"))
    return x.join(F.broadcast(opposites), "predicate_a").join(y, ["subject_id", "object_id", "predicate_b"]).where("first < second").select("subject_id", "object_id", "first", "second", "predicate_a", "predicate_b")


def contradictions(facts: DataFrame, edges: DataFrame, opposites: DataFrame) -> DataFrame:
    """One report (kind, entity_id, other_id, topic, n): attributes with several active values, and opposed edges between two entities."""
    scalar = scalar_contradictions(facts).select(F.lit("fact").alias("kind"), "entity_id", F.lit(None).cast("string").alias("other_id"), F.col("attribute").alias("topic"), F.col("n_values").alias("n"))
    pairs = relationship_contradictions(edges, opposites)
    topic = F.concat_ws("/", F.least("predicate_a", "predicate_b"), F.greatest("predicate_a", "predicate_b"))
    opposed = pairs.groupBy(F.col("subject_id").alias("entity_id"), F.col("object_id").alias("other_id"), topic.alias("topic")).agg(F.count("*").alias("n"))
    return scalar.unionByName(opposed.select(F.lit("relationship").alias("kind"), "entity_id", "other_id", "topic", "n"))


def as_of(facts: DataFrame, at: Column) -> DataFrame:
    return facts.where((F.col("valid_from") <= at) & (F.col("invalid_at").isNull() | (at < F.col("invalid_at"))))


def close(rows: DataFrame, ids: list[str], at: Column) -> DataFrame:
    """Invalidate rows: history stays."""
    return rows.withColumn("invalid_at", F.when(F.col("id").isin(ids) & F.col("invalid_at").isNull(), at).otherwise(F.col("invalid_at")))


def replace_edges(edges: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Edges with ``new`` (subject_id, object_id, predicate, relationship_type) appended; active ones from the same subject by the same predicate to another object are closed in their favour.

    Ids of new edges follow from what they say and when, so a repeated call adds
    none; of several new edges of a subject and predicate the largest id replaces.
    """
    stamp = F.date_format(at, "yyyyMMddHHmmssSSSSSS")
    made = new.select(F.sha2(F.concat_ws("\x1f", "subject_id", "predicate", "object_id", stamp), 256).alias("id"), "subject_id", "object_id", "predicate", "relationship_type", at.alias("valid_from"), F.lit(None).cast("timestamp").alias("invalid_at")).dropDuplicates(["id"])
    made = made.join(edges.select("id"), "id", "left_anti")
    last = made.groupBy("subject_id", "predicate").agg(F.max(F.struct("id", "object_id")).alias("_by"))
    old = edges if "superseded_by" in edges.columns else edges.withColumn("superseded_by", F.lit(None).cast("string"))
    rows = old.join(last, ["subject_id", "predicate"], "left")
    hit = F.col("_by").isNotNull() & F.col("invalid_at").isNull() & (F.col("object_id") != F.col("_by.object_id"))
    rows = rows.withColumn("superseded_by", F.when(hit, F.col("_by.id")).otherwise(F.col("superseded_by"))).withColumn("invalid_at", F.when(hit, at).otherwise(F.col("invalid_at"))).select(*old.columns)
    return rows.unionByName(made, allowMissingColumns=True)


def node_stats(entities: DataFrame, facts: DataFrame, mentions: DataFrame) -> DataFrame:
    """Active facts and mentions of each entity; each side is summed before the join."""
    f = active(facts).groupBy("entity_id").agg(F.count("*").alias("n_facts"))
    m = mentions.groupBy("entity_id").agg(F.count("*").alias("n_mentions"))
    out = entities.join(f, F.col("id") == f.entity_id, "left").drop("entity_id").join(m, F.col("id") == m.entity_id, "left")
    return out.select("id", "name", "entity_type", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"))


def induced_edges(edges: DataFrame, nodes: DataFrame, relationship_type: str | None = None) -> DataFrame:
    """Active edges with both ends among the nodes."""
    e = active(edges)
    if relationship_type:
        e = e.where(F.col("relationship_type") == relationship_type)
    return e.join(nodes.select(F.col("id").alias("subject_id")), "subject_id", "left_semi").join(nodes.select(F.col("id").alias("object_id")), "object_id", "left_semi")


def memories_near(edges: DataFrame, mentions: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, memory_id) through mentions of the entities within reach."""
    near = traverse(edges, seeds, depth).select("seed", F.col("node").alias("entity_id"))
    return near.join(mentions.select("entity_id", "memory_id"), "entity_id").select("seed", "memory_id").distinct()


def sources(memories: DataFrame) -> DataFrame:
    """(id, place, source_id, content): what each row derives from, in order."""
    links = memories.select("id", F.posexplode("source_ids").alias("place", "source_id"))
    return links.join(memories.select(F.col("id").alias("source_id"), "content"), "source_id").select("id", "place", "source_id", "content")


def provenance(memories: DataFrame, depth: int = 10) -> DataFrame:
    """(id, ancestor, hops): everything a row derives from, by least hops."""
    links = memories.select(F.col("id").alias("a"), F.explode("source_ids").alias("b")).distinct()
    reached = links.select(F.col("a").alias("id"), F.col("b").alias("ancestor"), F.lit(1).alias("hops"))
    for hop in range(2, depth + 1):
        reached = _hop(reached, links, hop, "id", "ancestor").where("id <> ancestor")
    return reached


def derived_from(memories: DataFrame) -> DataFrame:
    """Rows that are a source of any other."""
    used = memories.select(F.explode("source_ids").alias("id")).distinct()
    return memories.join(used, "id", "left_semi")


#: Rows of at most this many tags are counted by the subsets of their tags.
FEW_TAGS = 6


def _subsets(tags: Column) -> Column:
    """All subsets of an array but the empty one, each in the order of the array."""
    every = F.aggregate(tags, F.array(F.array().cast("array<string>")), lambda acc, t: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, t))))
    return F.filter(every, lambda s: F.size(s) > 0)


def related_counts(memories: DataFrame, ids: DataFrame, trivial: list[str]) -> DataFrame:
    """(id, related): how many other live rows share a tag that is not trivial; rows without any are left out.

    How many rows hold a subset of tags is counted once for each subset, and a
    row adds those of its own subsets, odd ones up and even ones down (inclusion
    and exclusion): a tag that all rows share costs one count, and no two rows
    meet. Where either row has more than ``FEW_TAGS`` tags its subsets would be
    too many; such rows meet the others by distinct sets of tags. Ids are taken
    to be unique.
    """
    own = F.array_sort(F.array_distinct(F.filter("tags", lambda t: t.isNotNull() & ~t.isin(trivial))))
    rows = memories.where(F.col("deleted_at").isNull()).select("id", own.alias("own")).where(F.size("own") > 0)
    sets = rows.groupBy("own").agg(F.count("*").alias("n"))
    wanted = rows.join(ids.select("id").distinct(), "id", "left_semi")
    asked = wanted.select("own").distinct()
    few = F.size("own") <= FEW_TAGS

    held = sets.where(few).select(F.explode(_subsets(F.col("own"))).alias("part"), "n").groupBy("part").agg(F.sum("n").alias("n"))
    signed = F.when(F.size("part") % 2 == 1, F.col("n")).otherwise(-F.col("n"))
    by_subset = asked.where(few).select("own", F.explode(_subsets(F.col("own"))).alias("part")).join(held, "part").select("own", signed.alias("n"))

    tagged = asked.select("own", F.explode("own").alias("tag"))
    others = sets.select(F.col("own").alias("other"), "n", F.explode("own").alias("tag"))
    met = tagged.where(few).join(others.where(F.size("other") > FEW_TAGS), "tag").unionByName(tagged.where(~few).join(others, "tag"))
    by_set = met.select("own", "other", "n").distinct().select("own", "n")

    total = by_subset.unionByName(by_set).groupBy("own").agg((F.sum("n") - 1).alias("related"))
    return wanted.join(total, "own").where("related > 0").select("id", "related")


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), "id"))
    return rows.withColumn("_r", place).where("_r = 1").drop("_r")
