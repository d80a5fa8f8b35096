"""Whole runs over the logical tables: retention, curation, resolution of names and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as cu
from ..operators import resolution as rs
from ..operators import retention as rt
from .registry import now, query
from .table_queries import _SAL, LIVE

GC = rt.Policy(floor=40, threshold=5.5, min_age_days=30, grace_days=30)

_GC = f"""{_SAL}, b AS (SELECT greatest(0, count(*) - 40) AS budget FROM memories WHERE {LIVE}),
    pr AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY stability, id) AS r FROM s WHERE {LIVE} AND stability < 5.5 AND epoch($NOW - created_at) / 86400.0 > 30 AND NOT is_consolidated_original), b WHERE r <= budget),
    ex AS (SELECT id FROM memories, b WHERE {LIVE} AND expires_at < $NOW AND budget > 0), dm AS (SELECT id FROM pr UNION SELECT id FROM ex),
    ph AS (SELECT id FROM memories WHERE deleted_at IS NOT NULL AND epoch($NOW - deleted_at) / 86400.0 > 30),
    oph AS (SELECT m.id FROM memories m WHERE {LIVE} AND id NOT IN (SELECT id FROM dm) AND list_has_any(coalesce(source_ids, []), (SELECT list(id) FROM dm)))"""


def _retention(t):
    tables = {n: getattr(t, n) for n in ("memories", "memory_salience", "memory_embeddings", "session_recalls", "entity_mentions", "entity_facts")}
    return rt.run(tables, now(), GC)


@query("gc_report", f"WITH {_GC} SELECT 'pruned' AS kind, count(*) AS n FROM pr HAVING count(*) > 0 UNION ALL SELECT 'expired', count(*) FROM ex WHERE id NOT IN (SELECT id FROM pr) HAVING count(*) > 0 UNION ALL SELECT 'orphaned', count(*) FROM oph UNION ALL SELECT 'purged', count(*) FROM ph", "memories memory_salience")
def gc_report(t):
    """What one retention run did."""
    return _retention(t)[1]


@query("gc_memories", f"WITH {_GC} SELECT id, deleted_at IS NOT NULL OR id IN (SELECT id FROM dm) AS deleted, id IN (SELECT id FROM oph) AS orphaned FROM memories WHERE id NOT IN (SELECT id FROM ph)", "memories memory_salience")
def gc_memories(t):
    """The memories that a retention run leaves."""
    rows = _retention(t)[0]["memories"]
    return rows.select("id", F.col("deleted_at").isNotNull().alias("deleted"), F.coalesce(F.array_contains("tags", rt.ORPHANED), F.lit(False)).alias("orphaned"))


@query(
    "gc_dependents",
    f"WITH {_GC} SELECT 'memory_embeddings' AS name, memory_id, count(*) AS n FROM memory_embeddings WHERE memory_id NOT IN (SELECT id FROM ph) GROUP BY ALL UNION ALL SELECT 'memory_salience', memory_id, count(*) FROM memory_salience WHERE memory_id NOT IN (SELECT id FROM ph) GROUP BY ALL UNION ALL SELECT 'session_recalls', memory_id, count(*) FROM session_recalls WHERE memory_id NOT IN (SELECT id FROM ph) GROUP BY ALL UNION ALL SELECT 'entity_mentions', memory_id, count(*) FROM entity_mentions WHERE memory_id NOT IN (SELECT id FROM ph) GROUP BY ALL UNION ALL SELECT 'entity_facts', CASE WHEN source_memory_id NOT IN (SELECT id FROM ph) THEN source_memory_id END AS m, count(*) FROM entity_facts GROUP BY ALL",
    "memories memory_salience memory_embeddings session_recalls entity_mentions entity_facts",
)
def gc_dependents(t):
    """Rows that are left of all that depends on memories."""
    new = _retention(t)[0]
    parts = [new[n].select(F.lit(n).alias("name"), F.col("memory_id")) for n in ("memory_embeddings", "memory_salience", "session_recalls", "entity_mentions")]
    parts.append(new["entity_facts"].select(F.lit("entity_facts").alias("name"), F.col("source_memory_id").alias("memory_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("name", "memory_id").agg(F.count("*").alias("n"))


@query("expired_sessions", "WITH l AS (SELECT session_id, max(recalled_at) AS last FROM session_recalls GROUP BY 1), k AS (SELECT session_id FROM l WHERE epoch($NOW - last) <= 129600) SELECT session_id, count(*) AS recalls FROM session_recalls WHERE session_id IN (SELECT session_id FROM k) GROUP BY 1", "session_recalls")
def expired_sessions(t):
    """Recalls that are left when idle sessions have gone."""
    sessions = t.session_recalls.groupBy("session_id").agg(F.max("recalled_at").alias("last_active_at"))
    return rt.expire_sessions(sessions, t.session_recalls, now(), 129600)[1].groupBy("session_id").agg(F.count("*").alias("recalls"))


# ---------------------------------------------------------------- names and facts


def extractions(t):
    """Memories with what an extraction told: their entities and a nation, their facts, and of each fifth structured facts."""
    nation = F.concat(F.lit(" Nation_"), (F.col("doc_id") % 25).cast("string"))
    fact = lambda e, a, v: F.struct(e.alias("entity"), F.lit(a).alias("attribute"), v.alias("value"))
    told = F.array(fact(nation, "Kind", F.col("type_hint")), fact(F.lit("nobody known"), "x", F.col("id")))
    return t.memories.select("id", "content", F.array_append("entities", nation).alias("entities"), "facts", F.when(F.col("doc_id") % 5 == 0, told).alias("structured"))


def _uuid(*parts: str) -> str:
    h = f"sha256(concat_ws(chr(31), {', '.join(parts)}))"
    return "concat_ws('-', " + ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


_NAMES = f"""jb AS (SELECT id, doc_id, type_hint, facts, list_append(entities, concat(' Nation_', doc_id % 25)) AS names FROM memories),
    fn AS (SELECT id AS memory_id, place - 1 AS place, trim(raw) AS raw, lower(trim(raw)) AS name FROM (SELECT id, unnest(names) AS raw, generate_subscripts(names, 1) AS place FROM jb) WHERE trim(raw) <> ''),
    lk AS (SELECT name, arg_min(id, (level, id)) AS entity_id FROM (SELECT lower(name) AS name, id, 0 AS level FROM entities UNION ALL SELECT lower(unnest(aliases)), id, 1 FROM entities) WHERE name IS NOT NULL GROUP BY name),
    nw AS (SELECT name, CASE WHEN regexp_matches(raw, '^\\p{{Lu}}') THEN 'person' ELSE 'concept' END AS entity_type FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY memory_id, place, raw) AS r FROM fn) WHERE r = 1 AND name NOT IN (SELECT name FROM lk)),
    ne AS (SELECT {_uuid("name", "entity_type")} AS id, name, entity_type FROM nw), kn AS (SELECT * FROM lk UNION ALL SELECT name, id FROM ne)"""


@query("resolved_entities", f"WITH {_NAMES} SELECT * FROM ne", "memories entities")
def resolved_entities(t):
    """Entities that the names of all memories make."""
    return rs.resolve(extractions(t), t.entities, now())["entities"].select("id", "name", "entity_type")


@query("resolved_mentions", f"WITH {_NAMES} SELECT {_uuid("'mention'", 'entity_id', 'memory_id', 'CAST(place AS VARCHAR)')} AS id, entity_id, memory_id FROM fn JOIN kn ON kn.name = fn.name", "memories entities")
def resolved_mentions(t):
    """Mentions of found and made entities in all memories."""
    return rs.resolve(extractions(t), t.entities, now())["entity_mentions"].select("id", "entity_id", "memory_id")


_TOLD = f"""{_NAMES}, sf AS (SELECT id AS memory_id, concat('nation_', doc_id % 25) AS name, 'kind' AS attribute, type_hint AS value FROM jb WHERE doc_id % 5 = 0),
    ff AS (SELECT memory_id, name, CASE WHEN contains(raw, ':') AND trim(split_part(raw, ':', 1)) <> '' THEN lower(trim(split_part(raw, ':', 1))) ELSE 'note' END AS attribute, CASE WHEN contains(raw, ':') AND trim(split_part(raw, ':', 1)) <> '' THEN trim(substr(raw, CAST(strpos(raw, ':') + 1 AS BIGINT))) ELSE trim(raw) END AS value
      FROM (SELECT id AS memory_id, lower(trim(names[1])) AS name, unnest(facts) AS raw FROM jb WHERE doc_id % 5 <> 0) WHERE trim(raw) <> ''),
    tf AS (SELECT DISTINCT entity_id, attribute, value, memory_id FROM (SELECT * FROM sf UNION ALL SELECT * FROM ff) a JOIN kn ON kn.name = a.name)"""


@query("resolved_facts", f"WITH {_TOLD} SELECT {_uuid("'fact'", 'entity_id', 'attribute', 'value', 'memory_id')} AS id, entity_id, attribute, value, memory_id AS source_memory_id FROM tf", "memories entities")
def resolved_facts(t):
    """Facts of all memories with the entities they belong to."""
    return rs.resolve(extractions(t), t.entities, now())["entity_facts"].select("id", "entity_id", "attribute", "value", "source_memory_id")


@query("superseded_facts", "SELECT id, invalid_at IS NULL AND value IS NOT DISTINCT FROM arg_max(value, (valid_from, id)) FILTER (WHERE invalid_at IS NULL) OVER (PARTITION BY entity_id, attribute) AS active FROM entity_facts", "entity_facts")
def superseded_facts(t):
    """Only the newest value of an entity's attribute stays active."""
    return rs.supersede(t.entity_facts, now()).select("id", F.col("invalid_at").isNull().alias("active"))


@query(
    "merged_entities",
    "WITH x AS (SELECT * FROM entities UNION ALL SELECT concat('z', id), upper(name), entity_type, ['also ' || id, aliases[1]], last_seen_at FROM entities WHERE entity_type = 'place'), a AS (SELECT n, entity_type, string_agg(a, '|' ORDER BY a) AS aliases FROM (SELECT DISTINCT lower(name) AS n, entity_type, unnest(aliases) AS a FROM x) GROUP BY ALL) SELECT min(id) AS id, x.entity_type, any_value(a.aliases) AS aliases FROM x JOIN a ON a.n = lower(x.name) AND a.entity_type = x.entity_type GROUP BY lower(x.name), x.entity_type",
    "entities",
)
def merged_entities(t):
    """Entities that are there twice in other letters become one with all aliases."""
    e = t.entities
    again = e.where("entity_type = 'place'").select(F.concat(F.lit("z"), "id").alias("id"), F.upper("name").alias("name"), "entity_type", F.array(F.concat(F.lit("also "), "id"), F.col("aliases")[0]).alias("aliases"), "last_seen_at")
    return rs.merge_entities(e.unionByName(again)).select("id", "entity_type", F.array_join("aliases", "|").alias("aliases"))


# ---------------------------------------------------------------- curation


@query("curation_run")
def curation_run(t):
    """Actions of one run over all memories without caps; runs are checked by hand in the tests."""
    none = t.spark.createDataFrame([], cu.ACTIONS), t.spark.createDataFrame([], cu.RUNS)
    policy = cu.Policy(similarity=0.3, weak=4.0, stale_below=2.0, merges=None, flags=None, strengthens=None, candidates=None)
    out = cu.run(t.memories, t.memory_embeddings, t.memory_salience, none[1], none[0], "run-1", now(), policy)
    return out["actions"].select("kind", "memory_id", "merged_id", "stability")
