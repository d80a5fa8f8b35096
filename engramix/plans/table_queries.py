"""Scans, filters, aggregates, graph, lifecycle and text functions over the logical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..functions import redaction as rd
from ..functions import scoring as sc
from ..functions import text as tx
from ..operators import graph as gr
from ..operators import ingest as ig
from ..operators import lifecycle as lc
from ..operators import records as rc
from ..operators import repeats
from ..operators import search as se
from ..sources import readers
from ..sources import writers as wr
from .registry import epoch, now, query

LIVE = "deleted_at IS NULL"


# ---------------------------------------------------------------- scans, filters


@query("count_live", f"SELECT count(*) AS n FROM memories WHERE {LIVE}", "memories")
def count_live(t):
    return se.live(t.memories).agg(F.count("*").alias("n"))


@query("point_lookup", f"SELECT id, md5(content) AS content, access_count + 1 AS access_count FROM memories WHERE id = 'm000000042' AND {LIVE}", "memories")
def point_lookup(t):
    """One live row, touched."""
    wanted = t.spark.createDataFrame([("m000000042",)], "id string")
    return rc.get_batch(t.memories.where(F.col("id") == "m000000042"), wanted, now())[0].select("id", F.md5("content").alias("content"), "access_count")


@query("batch_lookup", f"WITH w AS (SELECT unnest(['m000000003', 'm000000023', 'm999999999', 'm000000046']) AS id) SELECT w.id, m.id IS NOT NULL AS found FROM w LEFT JOIN memories m ON m.id = w.id AND m.{LIVE}", "memories")
def batch_lookup(t):
    wanted = t.spark.createDataFrame([(i,) for i in ("m000000003", "m000000023", "m999999999", "m000000046")], "id string")
    return wanted.join(se.live(t.memories).select("id", F.lit(True).alias("found")), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


@query("list_filtered", f"SELECT id, floor(epoch(created_at))::BIGINT AS at FROM memories WHERE {LIVE} AND type_hint = 'fact' AND source LIKE 'src1%' AND created_at > TIMESTAMP '2023-11-10' AND created_at < TIMESTAMP '2024-01-20' AND (project = 'p0' OR project IS NULL) ORDER BY created_at DESC, id LIMIT 100", "memories")
def list_filtered(t):
    rows = se.project_scope(se.live(t.memories), "p0").where((F.col("type_hint") == "fact") & F.col("source").startswith("src1") & (F.col("created_at") > F.lit("2023-11-10").cast("timestamp")) & (F.col("created_at") < F.lit("2024-01-20").cast("timestamp")))
    return rows.orderBy(F.col("created_at").desc(), "id").limit(100).select("id", epoch("created_at").alias("at"))


@query("list_next_page", f"WITH c AS (SELECT created_at, id FROM memories WHERE {LIVE} ORDER BY created_at DESC, id LIMIT 1 OFFSET 19) SELECT m.id FROM memories m, c WHERE m.{LIVE} AND (m.created_at < c.created_at OR (m.created_at = c.created_at AND m.id > c.id)) ORDER BY m.created_at DESC, m.id LIMIT 20", "memories")
def list_next_page(t):
    rows = se.live(t.memories)
    last = rows.orderBy(F.col("created_at").desc(), "id").limit(20).orderBy("created_at", F.col("id").desc()).limit(1).select("created_at", "id").first()
    at = F.lit(last.created_at)
    return rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") > last.id))).orderBy(F.col("created_at").desc(), "id").limit(20).select("id")


@query("recent", f"SELECT id FROM memories WHERE {LIVE} AND created_at > $NOW - INTERVAL 3 DAY", "memories")
def recent(t):
    return se.live(t.memories).where(F.col("created_at") > now() - F.expr("INTERVAL 3 DAYS")).select("id")


@query("count_matching", f"SELECT count(*) AS n FROM memories WHERE {LIVE} AND actor = 'actor1' AND audience = 'global' AND session_id = 's1'", "memories")
def count_matching(t):
    return se.live(t.memories).where("actor = 'actor1' AND audience = 'global' AND session_id = 's1'").agg(F.count("*").alias("n"))


@query("delete_matching", "SELECT id FROM memories WHERE NOT (type_hint = 'observation' AND trust_level < 0.4)", "memories")
def delete_matching(t):
    return t.memories.where("NOT (type_hint = 'observation' AND trust_level < 0.4)").select("id")


@query("resolve_prefix", "SELECT count(*) AS matches, min(id) AS id FROM (SELECT id FROM memories WHERE id LIKE 'm00000012%' ORDER BY id LIMIT 2)", "memories")
def resolve_prefix(t):
    return t.memories.where(F.col("id").startswith("m00000012")).orderBy("id").limit(2).agg(F.count("*").alias("matches"), F.min("id").alias("id"))


@query("tag_filters", "SELECT id, list_has_all(coalesce(tags, []), ['en', 'src1']) AS every_tag, list_has_any(coalesce(tags, []), ['de', 'src3']) AS any_tag, list_has_any(coalesce(tags, []), ['suspicious', 'curation:flagged']) AS hidden FROM memories", "memories")
def tag_filters(t):
    tags = F.col("tags")
    return t.memories.select("id", se.has_all(tags, ["en", "src1"]).alias("every_tag"), se.has_any(tags, ["de", "src3"]).alias("any_tag"), se.has_any(tags, se.NOT_SHOWN).alias("hidden"))


@query("tiers_shown", "SELECT id, knowledge_tier FROM memories WHERE knowledge_tier IN ('derived', 'pattern')", "memories")
def tiers_shown(t):
    return se.tier_filter(t.memories, ["derived", "pattern"]).select("id", "knowledge_tier")


@query("depth_projection", "SELECT id, md5(coalesce(abstract_text, content)) AS brief, md5(coalesce(overview_text, content)) AS overview, md5(CASE WHEN length(content) > 120 THEN concat(substr(content, 1, 120), '...') ELSE content END) AS cut FROM memories", "memories")
def depth_projection(t):
    c, a, o = (F.col(x) for x in ("content", "abstract_text", "overview_text"))
    return t.memories.select("id", F.md5(tx.at_depth(0, c, a, o)).alias("brief"), F.md5(tx.at_depth(1, c, a, o)).alias("overview"), F.md5(tx.truncate(c, 120)).alias("cut"))


@query("noise_filter", "SELECT id, strlen(trim(content)) < 50 OR contains(lower(trim(content)), 'license') OR contains(lower(trim(content)), '***') AS noise FROM memories WHERE content IS NOT NULL", "memories")
def noise_filter(t):
    return t.memories.where("content is not null").select("id", tx.is_noise(F.col("content"), ["License", "***"]).alias("noise"))


_TRIGGERS = " OR ".join(f"contains(lower(content), '{x.replace(chr(39), chr(39) * 2)}')" for x in tx.TRIGGERS)


@query("worth_storing", f"SELECT id, {_TRIGGERS} OR (strlen(content) > 100 AND (contains(content, '.') OR contains(content, ':'))) AS keep FROM memories WHERE content IS NOT NULL", "memories")
def worth_storing(t):
    return t.memories.where("content is not null").select("id", tx.worth_storing(F.col("content")).alias("keep"))


@query("content_filter", "SELECT id, CASE WHEN regexp_matches(content, '[0-9]{4}[- ][0-9]{4}') THEN 'digits' WHEN regexp_matches(content, '(?i)licensed under') THEN 'license' END AS dropped FROM memories", "memories")
def content_filter(t):
    c = F.col("content")
    return t.memories.select("id", F.when(c.rlike("[0-9]{4}[- ][0-9]{4}"), "digits").when(c.rlike("(?i)licensed under"), "license").alias("dropped"))


@query("validation", "SELECT id, CASE WHEN strlen(content) > 20000 THEN 'content too long' WHEN len(coalesce(tags, [])) > 2 THEN 'too many tags' WHEN len(list_filter(coalesce(tags, []), x -> strlen(x) > 4)) > 0 THEN 'tag too long' END AS rejected FROM memories", "memories")
def validation(t):
    return ig.validate(t.memories, 20000, 2, 4).select("id", "rejected")


@query("routing", "SELECT m.id, CASE WHEN type_hint IN ('decision', 'preference') AND coalesce(stability, 1.0) >= 2 THEN 'quality' WHEN strlen(content) >= 4000 THEN 'long' ELSE 'fast' END AS tier FROM memories m LEFT JOIN memory_salience s ON s.memory_id = m.id", "memories memory_salience")
def routing(t):
    rows = lc.with_salience(t.memories, t.memory_salience)
    rules = {"fast": {"size": 0}, "quality": {"types": ["decision", "preference"], "stability": 2}, "long": {"size": 4000}}
    return rows.select("id", sc.routed(rules, "fast", F.col("type_hint"), F.col("stability"), F.octet_length("content")).alias("tier"))


@query("embedding_text", "SELECT id, md5(concat_ws(' ', coalesce(abstract_text, content), array_to_string(tags, ' '))) AS text FROM memories WHERE tags IS NOT NULL", "memories")
def embedding_text(t):
    return t.memories.where("tags is not null").select("id", F.md5(tx.embedding_text(F.col("content"), F.col("abstract_text"), F.col("tags"))).alias("text"))


# ---------------------------------------------------------------- aggregates


@query("status_counts", "SELECT embedding_status, count(*) AS n FROM memories GROUP BY 1", "memories")
def status_counts(t):
    return t.memories.groupBy("embedding_status").agg(F.count("*").alias("n"))


@query("model_counts", "SELECT model_name, model_version, is_current, count(*) AS n FROM memory_embeddings GROUP BY ALL", "memory_embeddings")
def model_counts(t):
    return t.memory_embeddings.groupBy("model_name", "model_version", "is_current").agg(F.count("*").alias("n"))


@query("pipeline_health", "SELECT extraction_status, normalization_status, count(*) AS n FROM memories GROUP BY GROUPING SETS ((extraction_status), (normalization_status), ())", "memories")
def pipeline_health(t):
    return t.memories.groupingSets([[F.col("extraction_status")], [F.col("normalization_status")], []], "extraction_status", "normalization_status").agg(F.count("*").alias("n"))


@query("fact_formats", """WITH x AS (SELECT CASE WHEN doc_id % 3 = 0 THEN CAST(to_json(list_transform(facts, f -> {'entity': entities[1], 'value': f})) AS VARCHAR) ELSE CAST(to_json(facts) AS VARCHAR) END AS j, extraction_status FROM memories) SELECT count(*) FILTER (WHERE j LIKE '%"entity"%') AS structured, count(*) FILTER (WHERE j NOT LIKE '%"entity"%') AS flat, count(*) FILTER (WHERE j IS NULL) AS without FROM x WHERE extraction_status = 'complete'""", "memories")
def fact_formats(t):
    """Each third row's facts in the structured form."""
    structured = F.to_json(F.transform("facts", lambda f: F.struct(F.col("entities")[0].alias("entity"), f.alias("value"))))
    rows = t.memories.withColumn("json", F.when(F.col("doc_id") % 3 == 0, structured).otherwise(F.to_json("facts")))
    return rc.fact_formats(rows, "json")


@query("status_report", f"SELECT count(*) AS total, count(*) FILTER (WHERE {LIVE}) AS live, count(*) FILTER (WHERE embedding_status = 'pending') AS to_embed, count(*) FILTER (WHERE extraction_status = 'pending') AS to_extract, count(*) FILTER (WHERE abstraction_status = 'pending') AS to_abstract, count(*) FILTER (WHERE is_consolidated_original) AS superseded, count(DISTINCT project) AS projects FROM memories", "memories")
def status_report(t):
    return t.memories.agg(F.count("*").alias("total"), F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count_if(F.col("embedding_status") == "pending").alias("to_embed"), F.count_if(F.col("extraction_status") == "pending").alias("to_extract"), F.count_if(F.col("abstraction_status") == "pending").alias("to_abstract"), F.count_if("is_consolidated_original").alias("superseded"), F.count_distinct("project").alias("projects"))


@query("latency_percentiles", "SELECT event_type AS endpoint, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS worst, count(*) FILTER (WHERE value > 90) AS errors FROM auto_entries GROUP BY 1", "auto_entries")
def latency_percentiles(t):
    rows = t.auto_entries.withColumnRenamed("event_type", "endpoint")
    counts = rows.groupBy("endpoint").agg(F.count("*").alias("n"), F.max("value").alias("worst"), F.count_if(F.col("value") > 90).alias("errors"))
    return counts.join(rc.percentiles(rows, "endpoint", "value", 0.5, 0.95, 0.99), "endpoint")


@query("latency_regressions", "WITH x AS (SELECT event_type AS endpoint, quantile_disc(value, 0.95) FILTER (WHERE event_id % 2 = 0) AS base, quantile_disc(value, 0.95) FILTER (WHERE event_id % 2 = 1) AS now FROM auto_entries GROUP BY 1) SELECT endpoint, round(100 * (now - base) / base, 6) AS change, (now - base) / base > 0.2 AS regressed FROM x", "auto_entries")
def latency_regressions(t):
    def p95(odd: int, name: str):
        rows = t.auto_entries.where(F.col("event_id") % 2 == odd).withColumnRenamed("event_type", "endpoint")
        return rc.percentiles(rows, "endpoint", "value", 0.95).withColumnRenamed("p95", name)

    both = p95(0, "base").join(p95(1, "now"), "endpoint")
    ratio = (F.col("now") - F.col("base")) / F.col("base")
    return both.select("endpoint", F.round(100 * ratio, 6).alias("change"), (ratio > 0.2).alias("regressed"))


@query(
    "benchmark_report",
    "WITH r AS (SELECT type_hint AS category, trust_level >= 0.5 AS correct, length(content) % 997 AS latency_ms, len(source_ids) - doc_id % 2 AS found, len(source_ids) AS evidence FROM memories), c AS (SELECT category, count(*) AS total, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE correct) / count(*) AS accuracy, coalesce(sum(found) / sum(evidence), 0.0) AS recall, CAST(floor(avg(latency_ms)) AS BIGINT) AS mean_ms, quantile_disc(latency_ms, 0.95) AS p95_ms FROM r GROUP BY GROUPING SETS ((category), ())) SELECT category, total, correct, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall, mean_ms, p95_ms, CASE WHEN category IS NULL THEN round((SELECT avg(accuracy) FROM c WHERE category IS NOT NULL), 6) END AS task_averaged FROM c",
    "memories",
)
def benchmark_report(t):
    """Rows as answers: right if trusted, by the evidence of their sources and the length of their text as latency."""
    rows = t.memories.select(F.col("type_hint").alias("category"), (F.col("trust_level") >= 0.5).alias("correct"), (F.char_length("content") % 997).alias("latency_ms"), (F.when(F.col("source_ids").isNotNull(), F.size("source_ids")) - F.col("doc_id") % 2).alias("found"), F.when(F.col("source_ids").isNotNull(), F.size("source_ids")).alias("evidence"))
    out = rc.benchmark_report(rows)
    return out.select("category", "total", "correct", *[F.round(c, 6).alias(c) for c in ("accuracy", "recall", "task_averaged")], "mean_ms", "p95_ms")


@query("batch_get", "WITH w AS (SELECT DISTINCT concat('m', lpad(CAST(doc_id * 2 AS VARCHAR), 9, '0')) AS id FROM memories WHERE doc_id % 7 = 0) SELECT w.id, m.id IS NOT NULL AS found, m.access_count + 1 AS access_count FROM w LEFT JOIN memories m ON m.id = w.id AND m.deleted_at IS NULL", "memories")
def batch_get(t):
    """Live rows asked for, touched, and ids that none has."""
    wanted = t.memories.where("doc_id % 7 = 0").select(F.concat(F.lit("m"), F.lpad((F.col("doc_id") * 2).cast("string"), 9, "0")).alias("id"))
    found, missing = rc.get_batch(t.memories, wanted, now())
    return found.select("id", F.lit(True).alias("found"), "access_count").unionByName(missing.select("id", F.lit(False).alias("found")), allowMissingColumns=True)


@query("contradiction_report", "WITH f AS (SELECT 'fact' AS kind, entity_id, CAST(NULL AS VARCHAR) AS other_id, attribute AS topic, count(DISTINCT value) AS n FROM entity_facts WHERE invalid_at IS NULL GROUP BY ALL HAVING count(*) > 1), r AS (SELECT 'relationship' AS kind, x.subject_id AS entity_id, x.object_id AS other_id, concat_ws('/', least(x.predicate, y.predicate), greatest(x.predicate, y.predicate)) AS topic, count(*) AS n FROM relationships x JOIN predicate_contradictions c ON c.predicate_a = x.predicate JOIN relationships y ON y.subject_id = x.subject_id AND y.object_id = x.object_id AND y.predicate = c.predicate_b WHERE x.invalid_at IS NULL AND y.invalid_at IS NULL AND x.id < y.id GROUP BY ALL) SELECT * FROM f UNION ALL SELECT * FROM r", "entity_facts relationships predicate_contradictions")
def contradiction_report(t):
    return gr.contradictions(t.entity_facts, t.relationships, t.predicate_contradictions)


@query("graph_export", "SELECT 'entity' AS record_type, count(*) AS n FROM entities UNION ALL SELECT 'relationship', count(*) FROM relationships WHERE subject_id IN (SELECT id FROM entities) AND object_id IN (SELECT id FROM entities) UNION ALL SELECT 'fact', count(*) FROM entity_facts WHERE entity_id IN (SELECT id FROM entities)", "entities relationships entity_facts")
def graph_export(t):
    """Lines of a graph export that the import reads back."""
    folder = scratch.folder(t.spark)
    wr.graph_lines(t.entities, t.relationships, t.entity_facts).select("value").write.text(folder)
    rows = readers.jsonl_lines(t.spark, folder)
    return rows.where("_corrupt is null").groupBy("record_type").agg(F.count("*").alias("n"))


@query("cursor_checks", "SELECT id, CASE WHEN doc_id % 7 = 0 THEN 'invalid cursor' WHEN doc_id % 2 = 1 THEN 'invalid cursor type ''l'': expected search cursor (t=s)' END AS error, CASE WHEN doc_id % 7 <> 0 AND doc_id % 2 = 0 THEN id END AS key FROM memories", "memories")
def cursor_checks(t):
    """Search cursors, list cursors and broken ones of all rows."""
    score = F.col("trust_level").cast("double")
    made = F.when(F.col("doc_id") % 2 == 0, se.encode_cursor(score, F.col("id"))).otherwise(se.encode_cursor(score, F.col("id"), "l"))
    cursor = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("!"), F.substring(made, 2, 999))).otherwise(made)
    return t.memories.select("id", se.cursor_error(cursor).alias("error"), se.decode_cursor(cursor)["i"].alias("key"))


@query("daily_counts", "SELECT floor(epoch(date_trunc('day', ts)))::BIGINT AS day, event_type, count(*) AS n FROM auto_entries GROUP BY ALL", "auto_entries")
def daily_counts(t):
    return t.auto_entries.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("day"), "event_type", "n")


@query("alias_merge", "WITH x AS (SELECT entity_type, unnest(aliases) AS a FROM entities) SELECT entity_type, count(DISTINCT a) AS aliases FROM x GROUP BY 1", "entities")
def alias_merge(t):
    return t.entities.select("entity_type", F.explode("aliases").alias("a")).groupBy("entity_type").agg(F.count_distinct("a").cast("long").alias("aliases"))


@query("tag_union", "WITH x AS (SELECT project, unnest(tags) AS tag FROM memories) SELECT project, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM x GROUP BY 1", "memories")
def tag_union(t):
    return t.memories.select("project", F.explode("tags").alias("tag")).distinct().groupBy("project").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))


@query("tier_embedding_counts", "SELECT tier, count(*) AS n FROM memory_embeddings WHERE is_current GROUP BY 1", "memory_embeddings")
def tier_embedding_counts(t):
    return t.memory_embeddings.where("is_current").groupBy("tier").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- graph


@query(
    "graph_neighbours",
    """WITH RECURSIVE b AS (SELECT subject_id AS a, object_id AS b FROM relationships WHERE invalid_at IS NULL UNION SELECT object_id, subject_id FROM relationships WHERE invalid_at IS NULL),
    w AS (SELECT id AS seed, id AS node, 0 AS hops FROM entities WHERE id IN ('r0', 'r1') UNION SELECT w.seed, b.b, w.hops + 1 FROM w JOIN b ON w.node = b.a WHERE w.hops < 2)
    SELECT seed, node, min(hops) AS hops FROM w GROUP BY ALL HAVING min(hops) > 0""",
    "entities relationships",
)
def graph_neighbours(t):
    return gr.traverse(t.relationships, t.entities.where(F.col("id").isin("r0", "r1")), 2)


@query("entity_by_name", "SELECT id, name FROM entities WHERE lower(name) = 'nation_3' OR list_contains(list_transform(aliases, x -> lower(x)), 'nation_3') ORDER BY id LIMIT 1", "entities")
def entity_by_name(t):
    return gr.find_entity(t.entities, "Nation_3").select("id", "name")


@query("entity_page", "SELECT id FROM entities ORDER BY last_seen_at DESC, id LIMIT 25 OFFSET 25", "entities")
def entity_page(t):
    return t.entities.orderBy(F.col("last_seen_at").desc(), "id").offset(25).limit(25).select("id")


@query("scalar_contradictions", "SELECT entity_id, attribute, count(DISTINCT value) AS n_values, count(*) AS n_facts FROM entity_facts WHERE invalid_at IS NULL GROUP BY ALL HAVING count(*) > 1", "entity_facts")
def scalar_contradictions(t):
    return gr.scalar_contradictions(t.entity_facts)


@query("relationship_contradictions", "SELECT x.subject_id, x.object_id, x.id AS first, y.id AS second, x.predicate AS predicate_a, y.predicate AS predicate_b FROM relationships x JOIN predicate_contradictions c ON c.predicate_a = x.predicate JOIN relationships y ON y.subject_id = x.subject_id AND y.object_id = x.object_id AND y.predicate = c.predicate_b WHERE x.invalid_at IS NULL AND y.invalid_at IS NULL AND x.id < y.id", "relationships predicate_contradictions")
def relationship_contradictions(t):
    return gr.relationship_contradictions(t.relationships, t.predicate_contradictions)


@query("facts_as_of", "SELECT id, value FROM entity_facts WHERE valid_from <= $NOW - INTERVAL 100 DAY AND (invalid_at IS NULL OR $NOW - INTERVAL 100 DAY < invalid_at)", "entity_facts")
def facts_as_of(t):
    return gr.as_of(t.entity_facts, now() - F.expr("INTERVAL 100 DAYS")).select("id", "value")


@query("current_fact", "SELECT entity_id, value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY valid_from DESC, id) AS r FROM entity_facts WHERE invalid_at IS NULL) WHERE r = 1", "entity_facts")
def current_fact(t):
    return gr.latest_by(gr.active(t.entity_facts), "entity_id", "valid_from").select("entity_id", "value")


@query("node_stats", "SELECT e.id, e.name, e.entity_type, coalesce(f.n, 0) AS n_facts, coalesce(m.n, 0) AS n_mentions FROM entities e LEFT JOIN (SELECT entity_id, count(*) AS n FROM entity_facts WHERE invalid_at IS NULL GROUP BY 1) f ON f.entity_id = e.id LEFT JOIN (SELECT entity_id, count(*) AS n FROM entity_mentions GROUP BY 1) m ON m.entity_id = e.id", "entities entity_facts entity_mentions")
def node_stats(t):
    return gr.node_stats(t.entities, t.entity_facts, t.entity_mentions)


@query("induced_edges", "WITH n AS (SELECT id FROM entities WHERE entity_type = 'place' OR aliases[2] = 'BUILDING') SELECT id, subject_id, object_id FROM relationships WHERE invalid_at IS NULL AND relationship_type = 'semantic' AND subject_id IN (SELECT id FROM n) AND object_id IN (SELECT id FROM n)", "entities relationships")
def induced_edges(t):
    nodes = t.entities.where((F.col("entity_type") == "place") | (F.col("aliases")[1] == "BUILDING"))
    return gr.induced_edges(t.relationships, nodes, "semantic").select("id", "subject_id", "object_id")


@query("memories_near", "WITH b AS (SELECT subject_id AS a, object_id AS b FROM relationships WHERE invalid_at IS NULL UNION SELECT object_id, subject_id FROM relationships WHERE invalid_at IS NULL), one AS (SELECT DISTINCT a AS seed, b AS node FROM b WHERE a = 'n3'), two AS (SELECT seed, node FROM one UNION SELECT one.seed, b.b FROM one JOIN b ON one.node = b.a) SELECT DISTINCT seed, memory_id FROM two JOIN entity_mentions m ON m.entity_id = two.node WHERE node <> 'n3'", "relationships entity_mentions")
def memories_near(t):
    return gr.memories_near(t.relationships, t.entity_mentions, t.spark.createDataFrame([("n3",)], "id string"), 2)


@query("provenance_one", "SELECT m.id, s.place, s.source_id, md5(o.content) AS content FROM memories m, LATERAL (SELECT unnest(m.source_ids) AS source_id, generate_subscripts(m.source_ids, 1) - 1 AS place) s JOIN memories o ON o.id = s.source_id WHERE m.source_ids IS NOT NULL", "memories")
def provenance_one(t):
    return gr.sources(t.memories).withColumn("content", F.md5("content"))


@query("provenance_deep", "WITH RECURSIVE l AS (SELECT id, unnest(source_ids) AS up FROM memories WHERE source_ids IS NOT NULL), w AS (SELECT id, up AS ancestor, 1 AS hops FROM l UNION SELECT w.id, l.up, w.hops + 1 FROM w JOIN l ON w.ancestor = l.id WHERE w.hops < 10) SELECT id, ancestor, min(hops) AS hops FROM w GROUP BY ALL", "memories")
def provenance_deep(t):
    return gr.provenance(t.memories, 10)


@query("derived_from", "SELECT id FROM memories WHERE id IN (SELECT unnest(source_ids) FROM memories)", "memories")
def derived_from(t):
    return gr.derived_from(t.memories).select("id")


# ---------------------------------------------------------------- lifecycle


_SAL = "s AS (SELECT m.*, coalesce(stability, 1.0) AS stability, coalesce(reinforcement_count, 0) AS reinforcement_count, last_reinforced_at FROM memories m LEFT JOIN memory_salience x ON x.memory_id = m.id)"


@query("gc_candidates", f"WITH {_SAL} SELECT id, stability FROM s WHERE {LIVE} AND stability < 5.5 AND epoch($NOW - created_at) / 86400.0 > 30 AND NOT is_consolidated_original", "memories memory_salience")
def gc_candidates(t):
    return lc.gc_candidates(t.memories, t.memory_salience, now(), 5.5).select("id", "stability")


@query("expired", f"SELECT id FROM memories WHERE {LIVE} AND expires_at < $NOW", "memories")
def expired(t):
    return lc.expired(t.memories, now()).select("id")


@query("purgeable", "SELECT id FROM memories WHERE epoch($NOW - deleted_at) / 86400.0 > 30", "memories")
def purgeable(t):
    return lc.purgeable(t.memories, now()).select("id")


@query("orphans", "WITH g AS (SELECT id FROM memories WHERE deleted_at IS NOT NULL) SELECT DISTINCT m.id FROM memories m, LATERAL (SELECT unnest(source_ids) AS s) x WHERE x.s IN (SELECT id FROM g)", "memories")
def orphans(t):
    return lc.orphans(t.memories, t.memories.where("deleted_at is not null")).select("id")


@query("soft_delete", f"SELECT id, floor(epoch(CASE WHEN {LIVE} AND type_hint = 'fact' THEN $NOW ELSE deleted_at END))::BIGINT AS deleted_at FROM memories", "memories")
def soft_delete(t):
    return lc.soft_delete(t.memories, t.memories.where("type_hint = 'fact'"), now()).select("id", epoch("deleted_at").alias("deleted_at"))


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(content)), '(?m)^[#\s]+', '', 'g'), '[*_]', '', 'g'), '(?m)^[>\s]+', '', 'g'), '`', '', 'g'), '(?m)^(?:[-+] )+', '', 'g'), '\s+', ' ', 'g'))"


@query("exact_copies", f"WITH h AS (SELECT id, sha256({_NORM}) AS hash FROM memories WHERE {LIVE} AND content IS NOT NULL) SELECT hash, min(id) AS keeper, count(*) AS copies FROM h GROUP BY 1 HAVING count(*) > 1", "memories")
def exact_copies(t):
    return lc.exact_copies(t.memories)


@query("known_hashes", f"WITH h AS (SELECT doc_id, sha256({_NORM}) AS hash FROM memories WHERE content IS NOT NULL) SELECT DISTINCT hash FROM h WHERE doc_id % 2 = 0 AND hash IN (SELECT hash FROM h WHERE doc_id % 2 = 1)", "memories")
def known_hashes(t):
    h = t.memories.where("content is not null").select("doc_id", tx.content_hash(F.col("content")).alias("hash"))
    return h.where("doc_id % 2 = 0").select("hash").join(h.where("doc_id % 2 = 1").select("hash"), "hash", "left_semi").distinct()


@query("dedup_pairs", "WITH kn AS (SELECT q.memory_id, e.memory_id AS keeper, round(list_dot_product(e.embedding, q.embedding) / (sqrt(list_sum(list_transform(e.embedding, x -> x*x))) * sqrt(list_sum(list_transform(q.embedding, x -> x*x)))), 6) AS similarity FROM memory_embeddings e, memory_embeddings q WHERE e.memory_id <> q.memory_id) SELECT memory_id, keeper, similarity FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY similarity DESC, keeper) AS r FROM kn WHERE similarity BETWEEN 0.35 AND 1.0) WHERE r = 1", "memory_embeddings")
def dedup_pairs(t):
    """The best neighbour of every row."""
    return lc.dedup_pairs(t.memory_embeddings, t.memory_embeddings, 0.35)


@query("curation_candidates", f"WITH {_SAL} SELECT id, stability FROM s WHERE {LIVE} AND NOT is_consolidated_original AND created_at > $NOW - INTERVAL 20 DAY", "memories memory_salience")
def curation_candidates(t):
    return lc.curation_candidates(t.memories, t.memory_salience, now() - F.expr("INTERVAL 20 DAYS"), None).select("id", "stability")


#: Number of distinct signals in a text, as SQL.
SIGNALS = " + ".join(f"CAST(coalesce({' OR '.join(f'regexp_matches(content, {chr(39)}{p}{chr(39)})' for n, p in tx.INJECTION if n == name)}, false) AS INTEGER)" for name in dict.fromkeys(n for n, _ in tx.INJECTION))


@query("curation_review", f"WITH {_SAL} SELECT id, CASE WHEN {SIGNALS} >= CASE WHEN trust_level >= 0.7 THEN 3 WHEN trust_level >= 0.3 THEN 2 ELSE 1 END THEN 'suspicious' WHEN stability < 2.0 AND floor(epoch($NOW - created_at) / 86400.0) > 30 AND (reinforcement_count = 0 OR last_reinforced_at IS NULL OR floor(epoch($NOW - last_reinforced_at) / 86400.0) > 30) THEN 'stale' WHEN reinforcement_count >= 3 AND stability < 5.0 THEN 'strengthen' ELSE 'skip' END AS action FROM s", "memories memory_salience")
def curation_review(t):
    return lc.review(lc.with_salience(t.memories, t.memory_salience), now(), 2.0)


@query("curation_caps", "WITH a AS (SELECT id, type_hint AS action, row_number() OVER (PARTITION BY type_hint ORDER BY id) AS p FROM memories) SELECT id, action FROM a WHERE p <= CASE action WHEN 'fact' THEN 20 WHEN 'decision' THEN 50 ELSE p END", "memories")
def curation_caps(t):
    return lc.capped(t.memories.select("id", F.col("type_hint").alias("action")), {"fact": 20, "decision": 50})


@query("curation_priority", "SELECT id, CASE WHEN trust_level <= 0.3 AND greatest(0.0, epoch($NOW - created_at)) / 60.0 < 60 THEN 1 WHEN trust_level <= 0.7 THEN 2 ELSE 3 END AS priority FROM memories", "memories")
def curation_priority(t):
    return t.memories.select("id", sc.priority(F.col("trust_level"), sc.days_between(now(), F.col("created_at")) * 1440).alias("priority"))


@query("greedy_clusters")
def greedy_clusters(t):
    """Clusters of all rows along their ten nearest."""
    e = t.memory_embeddings
    return lc.greedy_clusters(se.neighbours(e, e, 10, 0.35), e.select(F.col("memory_id").alias("id"), F.lit(1).alias("priority")))


@query("promotable", f"WITH {_SAL} SELECT id FROM s WHERE {LIVE} AND id IN (SELECT memory_id FROM memory_embeddings WHERE tier = 'fast' AND is_current) AND (stability >= 3.0 OR reinforcement_count >= 4)", "memories memory_salience memory_embeddings")
def promotable(t):
    return lc.promotable(t.memories, t.memory_embeddings, t.memory_salience).select("id")


_QUEUES = {
    "embedding": "embedding_status IN ('pending', 'failed') AND abstraction_status <> 'pending'",
    "abstraction": "abstraction_status = 'pending'",
    "extraction": "extraction_status = 'pending'",
    "normalization": "normalization_status = 'pending' AND extraction_status = 'complete'",
    "enrichment": "embedding_status = 'complete' AND NOT list_contains(coalesce(tags, []), 'enriched')",
    "event_time": "event_time IS NULL AND extraction_status = 'complete'",
}
for _kind, _where in _QUEUES.items():

    @query(f"queue_{_kind}", f"SELECT id FROM memories WHERE {LIVE} AND {_where}", "memories")
    def _queue(t, kind=_kind):
        return lc.queue(t.memories, kind).select("id")


@query("boost_once", "WITH b AS (SELECT DISTINCT 'run1' AS run_id, memory_id, 1.3 AS f FROM memory_salience WHERE reinforcement_count = 2) SELECT s.memory_id, round(least(36500.0, greatest(0.1, stability * coalesce(f, 1.0))), 6) AS stability FROM memory_salience s LEFT JOIN b ON b.memory_id = s.memory_id AND s.memory_id NOT LIKE '%5'", "memory_salience")
def boost_once(t):
    s = t.memory_salience
    hit = s.where("reinforcement_count = 2").select(F.lit("run1").alias("run_id"), "memory_id", F.lit(1.3).alias("magnitude"))
    audit = hit.where(F.col("memory_id").endswith("5")).select("run_id", "memory_id")
    state, _ = lc.boost_once(s, audit, hit.unionByName(hit))
    return state.select("memory_id", F.round("stability", 6).alias("stability"))


@query("boost_revert", "SELECT memory_id, stability FROM memory_salience", "memory_salience")
def boost_revert(t):
    s = t.memory_salience
    hit = s.where("reinforcement_count = 2").select(F.lit("run1").alias("run_id"), "memory_id", F.lit(1.3).alias("magnitude"))
    state, audit = lc.boost_once(s, hit.select("run_id", "memory_id").limit(0), hit)
    return lc.revert(state, audit, "run1").select("memory_id", "stability")


@query("side_effects", "WITH f AS (SELECT id FROM memories WHERE doc_id % 10 = 0), b AS (SELECT id FROM memories WHERE doc_id % 10 = 1), d AS (SELECT id FROM memories WHERE doc_id % 5 = 0), x AS (SELECT id, 1.3 AS v FROM f UNION ALL SELECT id, 0.1 FROM b UNION ALL SELECT id, 0.9 FROM d WHERE id NOT IN (SELECT id FROM f)) SELECT id, round(product(v), 6) AS factor FROM x GROUP BY 1", "memories")
def side_effects(t):
    m = t.memories
    return lc.side_effects(m.where("doc_id % 10 = 0"), m.where("doc_id % 10 = 1"), m.where("doc_id % 5 = 0"))


@query("trust_history", "SELECT id, CASE WHEN doc_id % 100 = 0 THEN 0.05 ELSE trust_level END::DOUBLE AS trust_level, CASE WHEN doc_id % 100 = 0 THEN 1 ELSE 0 END AS changes FROM memories", "memories")
def trust_history(t):
    changes = t.memories.where("doc_id % 100 = 0").select("id", F.lit(0.05).alias("new_trust"), F.lit("quarantined").alias("reason"))
    out = lc.set_trust(t.memories, changes, now())
    return out.select("id", F.col("trust_level").cast("double").alias("trust_level"), F.size("trust_history").alias("changes"))


@query("unquarantine", "SELECT id, trust_level::DOUBLE AS trust_level, len(tags) AS n_tags FROM (SELECT id, CASE WHEN list_has_any(coalesce(tags, []), ['suspicious', 'curation:flagged']) THEN (CASE WHEN doc_id % 2 = 0 THEN trust_level ELSE 0.5 END) ELSE trust_level END AS trust_level, list_filter(tags, x -> x NOT IN ('suspicious', 'curation:flagged')) AS tags FROM memories)", "memories")
def unquarantine(t):
    hidden = t.memories.where(se.has_any(F.col("tags"), se.NOT_SHOWN) & (F.col("doc_id") % 2 == 0))
    changes = hidden.select("id", F.lit(0.05).alias("new_trust"), F.lit("auto: quarantined").alias("reason"))
    quarantined = lc.set_trust(t.memories, changes, now())
    out = lc.unquarantine(quarantined)
    return out.select("id", F.col("trust_level").cast("double").alias("trust_level"), F.when(F.col("tags").isNotNull(), F.size("tags")).alias("n_tags"))


@query("partial_update", "SELECT id, CASE WHEN type_hint = 'fact' THEN 'decision' ELSE type_hint END AS type_hint, array_to_string(list_sort(list_distinct(list_concat(coalesce(tags, []), ['seen']))), ',') AS tags FROM memories WHERE deleted_at IS NULL", "memories")
def partial_update(t):
    rows = se.live(t.memories)
    tags = F.array_sort(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("seen"))))
    return rows.select("id", F.when(F.col("type_hint") == "fact", "decision").otherwise(F.col("type_hint")).alias("type_hint"), F.array_join(tags, ",").alias("tags"))


@query("touch", "SELECT m.id, access_count + coalesce(n, 0) AS access_count FROM memories m LEFT JOIN (SELECT memory_id, count(*) AS n FROM session_recalls GROUP BY 1) r ON r.memory_id = m.id", "memories session_recalls")
def touch(t):
    """Accesses are appended as events and summed when read."""
    n = t.session_recalls.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n"))
    return t.memories.join(n, "id", "left").select("id", (F.col("access_count") + F.coalesce("n", F.lit(0))).alias("access_count"))


@query("close_relationships", "SELECT id, invalid_at IS NOT NULL OR id IN ('cn1', 'cn2') AS closed FROM relationships", "relationships")
def close_relationships(t):
    return gr.close(t.relationships, ["cn1", "cn2"], now()).select("id", F.col("invalid_at").isNotNull().alias("closed"))


@query("replaced_edges", "SELECT id, invalid_at IS NOT NULL OR (predicate = 'lives_in' AND CAST(substr(id, 3) AS BIGINT) % 4 = 0 AND object_id <> 'n7') AS closed FROM relationships UNION ALL SELECT concat('new ', subject_id), false FROM relationships WHERE predicate = 'lives_in' AND CAST(substr(id, 3) AS BIGINT) % 4 = 0", "relationships")
def replaced_edges(t):
    """Each fourth customer moves: the edge to the old place is closed in favour of the new one."""
    moved = t.relationships.where("predicate = 'lives_in' AND CAST(substring(id, 3) AS BIGINT) % 4 = 0").select("subject_id", F.lit("n7").alias("object_id"), "predicate", "relationship_type")
    out = gr.replace_edges(t.relationships, moved, now())
    return out.select(F.when(F.length("id") < 64, F.col("id")).otherwise(F.concat(F.lit("new "), "subject_id")).alias("id"), F.col("invalid_at").isNotNull().alias("closed"))


# ---------------------------------------------------------------- ingest and text


@query("reply_chain", "SELECT conv_id, turn, last_value(CASE WHEN stored THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reply_to FROM messages", "messages")
def reply_chain(t):
    return ig.reply_chain(t.messages, "conv_id", "turn", F.col("turn"), "stored").select("conv_id", "turn", "reply_to")


@query(
    "first_in_window",
    """WITH RECURSIVE r AS (SELECT event_id, content_key, ts, row_number() OVER (PARTITION BY content_key ORDER BY ts, event_id) AS n FROM auto_entries),
    w AS (SELECT event_id, content_key, n, ts AS last, true AS kept FROM r WHERE n = 1 UNION ALL SELECT r.event_id, r.content_key, r.n, CASE WHEN epoch(r.ts - w.last) >= 21600 THEN r.ts ELSE w.last END, epoch(r.ts - w.last) >= 21600 FROM w JOIN r ON r.content_key = w.content_key AND r.n = w.n + 1)
    SELECT event_id FROM w WHERE kept""",
    "auto_entries",
)
def first_in_window(t):
    return repeats.first_in_window(t.auto_entries, ["content_key"], "ts", "event_id", 21600).select("event_id")


def _LE(text: str) -> str:
    """Byte length of a text as four bytes, the lowest first, in DuckDB."""
    h = f"printf('%08x', strlen({text}))"
    return f"unhex(concat(substr({h}, 7, 2), substr({h}, 5, 2), substr({h}, 3, 2), substr({h}, 1, 2)))"


@query("idempotent_store", f"WITH n AS (SELECT sha256({_LE('source')} || encode(source) || {_LE('content')} || encode(content)) AS k, doc_id FROM memories WHERE content IS NOT NULL AND source IS NOT NULL) SELECT k AS idempotency_key, count(*) AS n FROM n WHERE doc_id % 2 = 0 AND k NOT IN (SELECT k FROM n WHERE doc_id % 4 = 1) GROUP BY 1", "memories")
def idempotent_store(t):
    rows = t.memories.where("content is not null and source is not null").withColumn("idempotency_key", tx.idempotency_key(F.col("source"), F.col("content")))
    keys = rows.where("doc_id % 4 = 1").select("idempotency_key", F.col("id").alias("memory_id"), (now() + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    new, _ = ig.idempotent(rows.where("doc_id % 2 = 0"), keys, now())
    return new.groupBy("idempotency_key").agg(F.count("*").alias("n"))


@query("normalise_facts", "SELECT id, entities[1] AS entity, CASE WHEN regexp_matches(entities[1], '^\\p{Lu}') THEN 'person' ELSE 'concept' END AS entity_type, CASE WHEN instr(f, ':') > 1 THEN trim(split_part(f, ':', 1)) ELSE 'note' END AS attribute, CASE WHEN instr(f, ':') > 1 THEN trim(substr(f, instr(f, ':') + 1)) ELSE trim(f) END AS value FROM memories, LATERAL (SELECT unnest(facts) AS f) x WHERE f IS NOT NULL OR facts IS NOT NULL", "memories")
def normalise_facts(t):
    return ig.normalise_facts(t.memories)


@query("chunks")
def chunks(t):
    """Overlapping chunks of whole texts; checked by a fold in Python in the tests."""
    return ig.chunks(t.memories, 2048, 1).select("id", "place", "total", "start", "end", F.octet_length("chunk").alias("bytes"), F.md5("chunk").alias("chunk"))


@query("injection_signals", "SELECT id, array_to_string(list_distinct_in_order, ',') AS signals FROM (SELECT id, list_filter([CASE WHEN regexp_matches(content, '(?i)\\bignore\\s+(all\\s+)?previous\\b') OR regexp_matches(content, '(?i)\\boverride\\s+(your\\s+)?instructions?\\b') OR regexp_matches(content, '(?i)\\bdisregard\\b') THEN 'override_instruction' END, CASE WHEN regexp_matches(content, '(?i)\\byou\\s+must\\b') THEN 'imperative_directive' END, CASE WHEN regexp_matches(content, '(?i)\\byou\\s+are\\s+now\\b') THEN 'role_override' END, CASE WHEN regexp_matches(content, '(?i)\\bsystem\\s*:\\s*') THEN 'system_prompt_injection' END, CASE WHEN regexp_matches(content, '(?i)\\bforget\\s+(everything|all)\\b') THEN 'memory_wipe' END, CASE WHEN regexp_matches(content, '(?i)\\b(always|never)\\s+(do|say|respond|answer)\\b') THEN 'behavioral_override' END, CASE WHEN regexp_matches(content, '(?i)\\bact\\s+as\\s+(if|though)?\\s*\\b') THEN 'persona_injection' END, CASE WHEN regexp_matches(content, '(?i)\\bnew\\s+instructions?\\s*:') THEN 'instruction_injection' END], x -> x IS NOT NULL) AS list_distinct_in_order FROM memories WHERE content IS NOT NULL)", "memories")
def injection_signals(t):
    return t.memories.where("content is not null").select("id", F.array_join(tx.injection_signals(F.col("content")), ",").alias("signals"))


@query("redaction")
def redaction(t):
    """Whole texts; a rule table of its own is tested case by case."""
    out = rd.redact(t.memories.select("id", "content"))
    return out.select("id", F.col("redacted.redactions").alias("redactions"), F.col("redacted.categories").alias("categories"), F.md5("redacted.content").alias("content"))


@query("secrets_screened", r"SELECT id, regexp_matches(content, '\b(\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4})\b') AS card, regexp_matches(content, '(AKIA[0-9A-Z]{16})') AS aws FROM memories WHERE content IS NOT NULL", "memories")
def secrets_screened(t):
    found = rd.screened(F.col("content"))
    return t.memories.where("content is not null").select("id", F.array_contains(found, "credit_card").alias("card"), F.array_contains(found, "aws_key").alias("aws"))


@query("secrets_counted", "WITH n AS (SELECT id, " + ", ".join(f"len(regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2)}')) AS {k}" for k, p, _, _ in rd.RULES + rd.PERSONAL) + " FROM memories WHERE content IS NOT NULL) SELECT * FROM n WHERE " + " + ".join(k for k, _, _, _ in rd.RULES + rd.PERSONAL) + " > 0", "memories")
def secrets_counted(t):
    """Matches of each rule in every whole text that has any."""
    n = rd.occurrences(F.col("content"))
    rows = t.memories.where("content is not null").select("id", *[c.alias(k) for k, c in n.items()])
    return rows.where(" + ".join(n) + " > 0")


def _dated(t):
    """Every text, led by a phrase that names a time out of its row's date in one of five ways."""
    at, k = F.col("created_at"), F.col("doc_id") % 6
    year, month = F.date_format(at, "yyyy"), F.date_format(at, "MMMM")
    phrase = F.when(k == 0, F.concat(F.lit("Seen in "), month, F.lit(" "), year)).when(k == 1, F.concat(F.lit("Moved in "), year)).when(k == 2, F.concat(F.lit("It was in the "), F.substring(year, 3, 1), F.lit("0s"))).when(k == 3, F.concat(F.lit("We met last "), month)).when(k == 4, F.concat(F.lit("Written last "), F.date_format(at, "EEEE"))).otherwise("No time")
    return t.memories.where("content is not null").select("id", F.concat(phrase, F.lit(". "), "content").alias("text"))


@query(
    "event_times",
    r"""WITH x AS (SELECT id, doc_id % 6 AS k, created_at AS c, content, isodow(created_at) AS d, month(created_at) AS m, year(created_at) AS y, isodow($NOW) AS td, month($NOW) AS tm, year($NOW) AS ty FROM memories WHERE content IS NOT NULL),
    z AS (SELECT *, regexp_extract(content, '\bin\s+(\d{4})\b', 1) AS other FROM x),
    e AS (SELECT id, CASE WHEN k = 0 THEN 'month' WHEN k = 1 OR (other <> '' AND CAST(other AS INTEGER) BETWEEN 1900 AND 2100) THEN 'year' WHEN k = 2 THEN 'decade' WHEN k = 3 THEN 'month' WHEN k = 4 THEN 'day' END AS precision,
      CASE WHEN k = 0 THEN make_date(y, m, 1) WHEN k = 1 THEN make_date(y, 1, 1) WHEN other <> '' AND CAST(other AS INTEGER) BETWEEN 1900 AND 2100 THEN make_date(CAST(other AS BIGINT), 1, 1) WHEN k = 2 THEN make_date(y - y % 10, 1, 1) WHEN k = 3 THEN make_date(CASE WHEN m < tm THEN ty ELSE ty - 1 END, m, 1) WHEN k = 4 THEN CAST($NOW AS DATE) - CAST(CASE WHEN td > d THEN td - d WHEN td = d THEN 7 ELSE 7 - (d - td) END AS INTEGER) END AS day FROM z)
    SELECT id, precision, strftime(day, '%Y-%m-%d') AS day FROM e""",
    "memories",
)
def event_times(t):
    """Times that whole texts name."""
    e = tx.event_time(F.col("text"), now())
    return _dated(t).select("id", e["precision"].alias("precision"), F.date_format(e["time"], "yyyy-MM-dd").alias("day"))


@query("entropy", "WITH b AS (SELECT id, unnest(regexp_extract_all(hex(encode(content)), '..')) AS x FROM memories WHERE content IS NOT NULL), c AS (SELECT id, x, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY ALL), t AS (SELECT id, n / sum(n) OVER (PARTITION BY id) AS p FROM c) SELECT m.id, round(coalesce(-sum(p * log2(p)), 0.0), 6) + 0.0 AS bits FROM memories m LEFT JOIN t ON t.id = m.id WHERE content IS NOT NULL GROUP BY m.id", "memories")
def entropy(t):
    """Entropy of every whole text."""
    return t.memories.where("content is not null").select("id", F.round(tx.entropy(F.col("content")), 6).alias("bits"))


@query("title_tags", "SELECT DISTINCT trim(regexp_replace(lower(type_hint || ' / ' || source), '[^a-z0-9]+', '-', 'g'), '-') AS tag FROM memories WHERE source IS NOT NULL", "memories")
def title_tags(t):
    return t.memories.where("source is not null").select(tx.title_tag(F.concat("type_hint", F.lit(" / "), "source")).alias("tag")).distinct()


@query("sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 43200 THEN 0 ELSE 1 END AS new FROM auto_entries), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS started, count(*) AS n FROM s GROUP BY user_id, s.n", "auto_entries")
def sessions(t):
    """Idle gaps of twelve hours end a session."""
    s = t.auto_entries.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_timestamp("w.start").alias("started"), "n")


@query("latest_version", "SELECT user_id, max_by(event_type, event_id) AS event_type FROM auto_entries GROUP BY 1", "auto_entries")
def latest_version(t):
    """State tables are logs; the latest row of a key counts."""
    return t.auto_entries.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))


@query("export_rows", f"SELECT m.id, coalesce(stability, 1.0) AS stability, row_number() OVER (ORDER BY created_at, m.id) AS place FROM memories m LEFT JOIN memory_salience s ON s.memory_id = m.id WHERE {LIVE} AND project = 'p1' AND created_at >= TIMESTAMP '2023-12-01' AND list_contains(coalesce(tags, []), 'en')", "memories memory_salience")
def export_rows(t):
    rows = lc.with_salience(se.live(t.memories), t.memory_salience).where((F.col("project") == "p1") & (F.col("created_at") >= F.lit("2023-12-01").cast("timestamp")) & se.has_all(F.col("tags"), ["en"]))
    return rc.numbered(rows, "created_at", "id").select("id", "stability", "place")


@query("export_graph", "SELECT r.id, s.name AS subject, o.name AS object, r.predicate FROM relationships r JOIN entities s ON s.id = r.subject_id JOIN entities o ON o.id = r.object_id WHERE r.invalid_at IS NULL", "relationships entities")
def export_graph(t):
    e = t.entities
    s, o = e.select(F.col("id").alias("subject_id"), F.col("name").alias("subject")), e.select(F.col("id").alias("object_id"), F.col("name").alias("object"))
    return gr.active(t.relationships).join(s, "subject_id").join(o, "object_id").select("id", "subject", "object", "predicate")


@query("annotate_tags", "SELECT id, array_to_string(list_sort(list_filter(['en', 'new'], x -> NOT list_contains(coalesce(tags, []), x))), ',') AS added, array_to_string(list_sort(list_filter(['src1', 'enriched'], x -> list_contains(coalesce(tags, []), x))), ',') AS removed, array_to_string(list_sort(list_distinct(list_filter(list_concat(coalesce(tags, []), ['en', 'new']), x -> x NOT IN ('src1', 'enriched')))), ',') AS tags FROM memories", "memories")
def annotate_tags(t):
    """What is added and removed of every row's tags, and what is left."""
    new = rc.retagged(F.col("tags"), ["en", "new"], ["src1", "enriched"])
    return t.memories.select("id", *[F.array_join(F.array_sort(new[c]), ",").alias(c) for c in ("added", "removed", "tags")])

