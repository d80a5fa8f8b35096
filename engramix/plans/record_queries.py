"""Writes of single columns, logs, mentions, small record functions and result shaping, over the logical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as rf
from ..functions import sentences
from ..operators import ingest as ig
from ..operators import records as rc
from .registry import epoch, now, query
from .table_queries import SIGNALS

NONE = "array<string>"


@query("dimension_probe", "SELECT len(embedding) AS dimension FROM memory_embeddings WHERE is_current ORDER BY memory_id LIMIT 1", "memory_embeddings")
def dimension_probe(t):
    return t.memory_embeddings.where("is_current").orderBy("memory_id").limit(1).select(F.size("embedding").alias("dimension"))


@query("model_dimensions", "SELECT DISTINCT CASE label % 4 WHEN 0 THEN 'text-embedding-3-small' WHEN 1 THEN 'BGELargeENV15' WHEN 2 THEN 'all-MiniLM-L6-v2' ELSE model_name END AS model, CASE label % 4 WHEN 0 THEN 1536 WHEN 1 THEN 1024 WHEN 2 THEN 384 END AS dimension FROM memory_embeddings", "memory_embeddings")
def model_dimensions(t):
    k = F.col("label") % 4
    rows = t.memory_embeddings.select(F.when(k == 0, "text-embedding-3-small").when(k == 1, "BGELargeENV15").when(k == 2, "all-MiniLM-L6-v2").otherwise(F.col("model_name")).alias("model")).distinct()
    return rows.select("model", rf.dimension(F.col("model")).alias("dimension"))


@query("status_writes", "WITH w AS (SELECT id, CASE WHEN doc_id % 6 = 0 THEN 'failed' ELSE 'complete' END AS s FROM memories WHERE doc_id % 2 = 0) SELECT m.id, coalesce(w.s, embedding_status) AS embedding_status, coalesce(w.s, extraction_status) AS extraction_status, coalesce(w.s, normalization_status) AS normalization_status, coalesce(w.s, abstraction_status) AS abstraction_status, floor(epoch(updated_at))::BIGINT AS updated_at FROM memories m LEFT JOIN w ON w.id = m.id", "memories")
def status_writes(t):
    m = t.memories
    first = m.where("doc_id % 2 = 0").select("id", F.lit("pending").alias("status"), F.lit(1).alias("at"))
    last = m.where("doc_id % 2 = 0").select("id", F.when(F.col("doc_id") % 6 == 0, "failed").otherwise("complete").alias("status"), F.lit(2).alias("at"))
    names = [f"{x}_status" for x in ("embedding", "extraction", "normalization", "abstraction")]
    for name in names:
        m = rc.set_status(m, first.union(last), name)
    return m.select("id", *names, epoch("updated_at").alias("updated_at"))


@query("abstraction_writes", "SELECT id, CASE WHEN doc_id % 5 = 1 THEN 'short ' || id ELSE md5(abstract_text) END AS abstract, CASE WHEN doc_id % 5 = 1 THEN NULL ELSE md5(overview_text) END AS overview, CASE WHEN doc_id % 5 = 1 THEN 'complete' ELSE abstraction_status END AS status, floor(epoch(CASE WHEN doc_id % 5 = 1 THEN $NOW ELSE updated_at END))::BIGINT AS updated_at FROM memories", "memories")
def abstraction_writes(t):
    own = t.memories.where("doc_id % 5 = 1").select("id", F.concat(F.lit("short "), "id").alias("abstract"), F.lit(None).cast("string").alias("overview"), F.lit("complete").alias("status"))
    out = rc.set_abstraction(t.memories, own, now())
    hit = F.col("doc_id") % 5 == 1
    return out.select("id", F.when(hit, F.col("abstract_text")).otherwise(F.md5("abstract_text")).alias("abstract"), F.md5("overview_text").alias("overview"), F.col("abstraction_status").alias("status"), epoch("updated_at").alias("updated_at"))


@query("event_time_writes", "SELECT id, floor(epoch(CASE WHEN doc_id % 7 = 2 THEN $NOW ELSE event_time END))::BIGINT AS event_time, CASE WHEN doc_id % 7 = 2 THEN 'day' END AS precision FROM memories", "memories")
def event_time_writes(t):
    own = t.memories.where("doc_id % 7 = 2").select("id", now().alias("time"), F.lit("day").alias("precision"))
    return rc.set_event_time(t.memories, own).select("id", epoch("event_time").alias("event_time"), F.col("event_time_precision").alias("precision"))


@query("stability_writes", "WITH w AS (SELECT id, 4.5 AS s FROM memories WHERE doc_id % 9 = 4) SELECT coalesce(memory_id, id) AS memory_id, round(coalesce(s, stability), 6) AS stability, coalesce(reinforcement_count, 0) AS reinforcement_count FROM memory_salience FULL JOIN w ON id = memory_id", "memories memory_salience")
def stability_writes(t):
    own = t.memories.where("doc_id % 9 = 4").select(F.col("id").alias("memory_id"), F.lit(4.5).alias("stability"))
    return rc.set_stability(t.memory_salience, own).select("memory_id", F.round("stability", 6).alias("stability"), "reinforcement_count")


@query("implicit_touch", "WITH w AS (SELECT id FROM memories WHERE doc_id % 4 = 1) SELECT coalesce(memory_id, id) AS memory_id, round(CASE WHEN id IS NULL THEN stability ELSE coalesce(stability * 1.1, 1.1) END, 6) AS stability FROM memory_salience FULL JOIN w ON id = memory_id", "memories memory_salience")
def implicit_touch(t):
    own = t.memories.where("doc_id % 4 = 1").select(F.col("id").alias("memory_id"))
    return rc.touched_implicitly(t.memory_salience, own).select("memory_id", F.round("stability", 6).alias("stability"))


@query("idempotency_keys_kept", "SELECT id FROM memories WHERE expires_at > $NOW", "memories")
def idempotency_keys_kept(t):
    return rc.live_keys(t.memories.select("id", "expires_at"), now()).select("id")


def _runs(t):
    """A log of runs out of the events: a user's events of a day are a run; the last of them ends it."""
    own = t.auto_entries.select(F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"), F.col("ts").alias("at"), "event_id")
    ends = own.groupBy("run_id").agg(F.max(F.struct("at", "event_id")).alias("e")).select("run_id", F.col("e.at").alias("at"), F.col("e.event_id").alias("event_id"))
    begun = own.select("run_id", "at", F.lit("running").alias("status"), F.lit(None).cast("timestamp").alias("window_end"), *[F.lit(None).cast("long").alias(c) for c in ("merged", "stale", "strengthened", "skipped")], F.lit(None).cast("string").alias("error"))
    done, failed = F.col("event_id") % 3 == 0, F.col("event_id") % 3 == 1
    closed = ends.where(done | failed).select("run_id", (F.col("at") + F.expr("INTERVAL 1 MINUTE")).alias("at"), F.when(done, "completed").otherwise("failed").alias("status"), F.when(done, F.col("at")).alias("window_end"), *[F.when(done, F.col("event_id") % m).alias(c) for c, m in (("merged", 5), ("stale", 7), ("strengthened", 11), ("skipped", 13))], F.when(failed, "worker lost").alias("error"))
    return rc.run_log(begun.union(closed))


_RUNS = """WITH r AS (SELECT concat(user_id, '-', strftime(ts, '%Y%m%d')) AS run_id, ts, event_id FROM auto_entries),
e AS (SELECT run_id, min(ts) AS started_at, max(ts) AS ended, max_by(event_id, (ts, event_id)) AS x FROM r GROUP BY 1),
runs AS (SELECT run_id, started_at, CASE WHEN x % 3 < 2 THEN ended + INTERVAL 1 MINUTE END AS completed_at, CASE x % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS status, CASE WHEN x % 3 = 0 THEN ended END AS window_end,
  CASE WHEN x % 3 = 0 THEN x % 5 ELSE 0 END AS merged, CASE WHEN x % 3 = 0 THEN x % 7 ELSE 0 END AS stale, CASE WHEN x % 3 = 0 THEN x % 11 ELSE 0 END AS strengthened, CASE WHEN x % 3 = 0 THEN x % 13 ELSE 0 END AS skipped, CASE WHEN x % 3 = 1 THEN 'worker lost' END AS error FROM e)"""


@query("curation_run_log", f"{_RUNS} SELECT run_id, floor(epoch(started_at))::BIGINT AS started_at, floor(epoch(completed_at))::BIGINT AS completed_at, status, merged, stale, strengthened, skipped, error FROM runs", "auto_entries")
def curation_run_log(t):
    return _runs(t).select("run_id", epoch("started_at").alias("started_at"), epoch("completed_at").alias("completed_at"), "status", "merged", "stale", "strengthened", "skipped", "error")


@query("last_curation_window", f"{_RUNS} SELECT floor(epoch(max_by(window_end, (completed_at, run_id))))::BIGINT AS window_end FROM runs WHERE status = 'completed'", "auto_entries")
def last_curation_window(t):
    return rc.last_window(_runs(t)).select(epoch("window_end").alias("window_end"))


def _actions(t):
    return t.auto_entries.select(F.concat(F.lit("run"), (F.col("user_id") % 7).cast("string")).alias("run_id"), F.concat(F.lit("m"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("memory_id"), F.when(F.col("event_type") == "click", "merge").otherwise("flag").alias("action"), F.col("ts").alias("created_at"))


@query("curation_action_log", "SELECT 'm' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS memory_id, CASE WHEN event_type = 'click' THEN 'merge' ELSE 'flag' END AS action FROM auto_entries WHERE user_id % 7 = 3", "auto_entries")
def curation_action_log(t):
    return rc.action_log(_actions(t), "run3").select("memory_id", "action")


@query("dedup_merge_count", "SELECT count(*) AS merges FROM auto_entries WHERE event_type = 'click'", "auto_entries")
def dedup_merge_count(t):
    return rc.merge_counter(_actions(t))


@query("entity_by_id", "SELECT id, name, entity_type FROM entities WHERE id = 'n7'", "entities")
def entity_by_id(t):
    return t.entities.where(F.col("id") == "n7").select("id", "name", "entity_type")


@query("entity_mention_list", "SELECT x.id, memory_id FROM entity_mentions x WHERE entity_id = 'c7' AND memory_id IN (SELECT id FROM memories WHERE deleted_at IS NULL)", "entity_mentions memories")
def entity_mention_list(t):
    return rc.mentions_of(t.entity_mentions, t.memories, "c7").select("id", "memory_id")


@query("export_with_vectors", "SELECT m.id, model_name AS model, len(embedding) AS components, round(list_sum(embedding), 6) AS total FROM memories m LEFT JOIN (SELECT * FROM memory_embeddings WHERE is_current) e ON e.memory_id = m.id WHERE m.deleted_at IS NULL", "memories memory_embeddings")
def export_with_vectors(t):
    out = rc.with_vectors(t.memories.where("deleted_at is null"), t.memory_embeddings)
    return out.select("id", F.col("embedding_model").alias("model"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("components"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("field_projection", "SELECT id, trust_level, knowledge_tier AS tier FROM memories", "memories")
def field_projection(t):
    rows = t.memories.select("id", "trust_level", F.struct("knowledge_tier", "content").alias("meta"), "content")
    got = rc.project(rows, ["id", "trust_level", "meta.knowledge_tier", "meta.content.more", "absent"])
    return got.select("id", "trust_level", F.col("meta.knowledge_tier").alias("tier"))


@query("least_salience", "SELECT memory_id AS id, stability AS salience FROM memory_salience WHERE stability >= 0.7", "memory_salience")
def least_salience(t):
    return rc.salient(t.memory_salience.select(F.col("memory_id").alias("id"), F.col("stability").alias("salience")), 0.7)


#: Openings that narrate and some that do not; each text gets the one of its number.
_OPENINGS = ["Let me check ", " Let me check ", "Now I'll search ", "Reading the file ", "I will proceed to ", "Here's the result ", "They let me read ", ""]


@query("tool_narration", "SELECT id, CASE WHEN doc_id % 3 = 1 THEN type_hint = 'observation' ELSE doc_id % 8 IN (0, 2, 3, 4, 5) OR regexp_matches(concat(CASE WHEN doc_id % 8 = 7 THEN '' ELSE 'x' END, content), '(?i)^(let me (read|check|look at|search|find|edit|write|run|execute|open|examine)|now i(''ll| will) (read|check|look|search|find|edit|write|run|execute)|(reading|writing|editing|searching|checking|running|executing|looking at) (the |a )?(file|code|test|command|script|directory)|i(''ll| will) (start by|begin by|go ahead and|proceed to) |(here''s|here is) (what i found|the output|the result))') END AS dropped FROM memories WHERE content IS NOT NULL", "memories")
def tool_narration(t):
    """Every whole text behind an opening of its own; every third has a category, which decides."""
    opening = F.element_at(F.array(*[F.lit(o) for o in _OPENINGS]), (F.col("doc_id") % 8 + 1).cast("int"))
    category = F.when(F.col("doc_id") % 3 == 1, F.col("type_hint"))
    return t.memories.where("content is not null").select("id", rc.narrates(F.concat(opening, "content"), category, ("observation",)).alias("dropped"))


@query("composite_filter", "SELECT id, CASE WHEN regexp_matches(content, '[0-9]{4}[- ][0-9]{4}') THEN 'digits' WHEN regexp_matches(content, '(?i)licensed under') THEN 'license' WHEN type_hint = 'summary' THEN 'topic' END AS dropped FROM memories", "memories")
def composite_filter(t):
    return t.memories.select("id", rc.content_filter(F.col("content"), {"digits": "[0-9]{4}[- ][0-9]{4}", "license": "(?i)licensed under"}, F.col("type_hint") == "summary").alias("dropped"))


@query("quarantine_audit", "SELECT id, unnest(['missing_tag', 'wrong_trust', 'missing_history']) AS violation FROM memories WHERE doc_id % 37 <> 0 OR doc_id % 29 = 0 UNION ALL SELECT id, unnest(['wrong_trust', 'missing_history']) FROM memories WHERE doc_id % 37 = 0 AND doc_id % 29 <> 0", "memories")
def quarantine_audit(t):
    return rc.audit(t.memories.withColumn("trust_history", F.lit(None).cast("string")))


@query("actor_types", "SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'bot' ELSE 'user' END AS actor_type FROM memories", "memories")
def actor_types(t):
    return t.memories.select("id", rf.actor_type(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("My-BoT/"), F.coalesce("source", F.lit("")))).otherwise("human")).alias("actor_type"))


@query("session_dates", "SELECT conv_id, turn, floor(epoch(date_trunc('day', messages.at)))::BIGINT AS day FROM messages", "messages")
def session_dates(t):
    k = F.col("turn") % 6
    forms = [F.date_format("at", f) for f in ("h:mm a 'on' d MMMM, yyyy", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "MM/dd/yyyy")]
    text = F.coalesce(*[F.when(k == i, f) for i, f in enumerate(forms)], forms[0])
    return t.messages.select("conv_id", "turn", F.unix_timestamp(rf.session_date(text)).alias("day"))


@query("benchmark_categories", "SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'abstention' WHEN item_id % 3 = 0 THEN 'multi_session' WHEN item_id % 3 = 1 THEN 'information_extraction' ELSE 'unknown' END AS category FROM benchmark")
def benchmark_categories(t):
    k = F.col("item_id") % 3
    kind = F.when(k == 0, "multi-session").when(k == 1, "single-session-user").otherwise("other")
    return t.raw("benchmark").select("item_id", rf.category(kind, F.concat(F.col("item_id").cast("string"), F.when(F.col("item_id") % 4 == 0, "_abs").otherwise(""))).alias("category"))


@query("slug_projects", "SELECT id, concat('p', CAST(doc_id % 4 AS VARCHAR)) AS project FROM memories", "memories")
def slug_projects(t):
    return t.memories.select("id", rf.project_of_slug(F.concat(F.lit("-home-u-p"), (F.col("doc_id") % 4).cast("string"))).alias("project"))


@query("topics")
def topics(t):
    """First sentences of whole texts; the rules are tried one by one in the tests."""
    return t.memories.where("content is not null").select("id", sentences.topic(F.col("content")).alias("topic"))


@query("chunk_headers")
def chunk_headers(t):
    """Headers of all chunks with the topic of their text."""
    return ig.chunks(t.memories, 2048, 1, 512).select("id", "place", "total", "header")


@query("structured_facts", "SELECT id, CASE WHEN doc_id % 3 = 1 THEN 0 WHEN doc_id % 3 = 2 THEN 1 ELSE len(coalesce(facts, [])) END AS flat, CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 0 END AS structured FROM memories", "memories")
def structured_facts(t):
    objects = F.to_json(F.array(*[F.struct(F.lit(e).alias("entity"), F.lit("a").alias("attribute"), F.col("id").alias("value")) for e in ("x", "y")]))
    mixed = F.lit('["plain", {"entity": "", "attribute": "a", "value": "b"}]')
    value = F.when(F.col("doc_id") % 3 == 1, objects).when(F.col("doc_id") % 3 == 2, mixed).otherwise(F.to_json("facts"))
    got = rf.facts(value)
    return t.memories.select("id", F.size(got["flat"]).alias("flat"), F.size(got["structured"]).alias("structured"))


@query("tags_from_json", "SELECT id, array_to_string(coalesce(tags, []), ',') AS tags FROM memories", "memories")
def tags_from_json(t):
    mixed = F.concat(F.lit("[1, null, "), F.array_join(F.transform("tags", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit(", 2.5]"))
    return t.memories.select("id", F.array_join(rf.string_tags(mixed), ",").alias("tags"))


@query("triage_answers", "SELECT id, k AS place, CASE k WHEN 1 THEN 'drop' ELSE 'keep' END AS action, CASE k WHEN 1 THEN type_hint WHEN 3 THEN 'fact' ELSE 'observation' END AS type_hint, CASE k WHEN 1 THEN 'about it all' END AS topic FROM memories, range(1, 5) r(k)", "memories")
def triage_answers(t):
    answer = F.concat(F.lit("3 keep fact\n9 drop fact\nnonsense\n\n1 keep fact\n1 DROP "), "type_hint", F.lit("  about it all\n4 keep rumour"))
    answer = F.regexp_replace(answer, "  about", " about")
    kinds = ["fact", "preference", "instruction", "decision", "observation", "summary"]
    rows = t.memories.select("id", F.inline(rf.decisions(answer, F.lit(4), kinds)))
    return rows.select("id", "place", "action", "type_hint", "topic")


@query("merged_clusters", "WITH c AS (SELECT concat('k', CAST(doc_id // 3 AS VARCHAR)) AS cluster, id, created_at, content FROM memories WHERE content IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY created_at DESC, id DESC) AS i, count(*) OVER (PARTITION BY cluster) AS n FROM c) SELECT cluster, count(*) AS members, md5(string_agg(CASE WHEN n > 1 THEN concat('[', i, '/', n, '] ', content) ELSE content END, chr(10) || chr(10) ORDER BY i)) AS content FROM n GROUP BY 1", "memories")
def merged_clusters(t):
    rows = t.memories.where("content is not null")
    out = rc.merge_clusters(rows.select(F.concat(F.lit("k"), F.floor(F.col("doc_id") / 3).cast("string")).alias("cluster"), "id"), rows)
    return out.select("cluster", "members", F.md5("content").alias("content"))


@query("latest_imports", "SELECT source, max_by(id, (updated_at, -doc_id)) AS id FROM memories WHERE source IS NOT NULL GROUP BY 1", "memories")
def latest_imports(t):
    return rc.latest_import(t.memories.where("source is not null").select("source", "id", F.col("updated_at").alias("at"))).select("source", "id")


@query("rescued_items", "SELECT id, doc_id % 12 = 0 OR doc_id % 5 = 0 AS rescued FROM memories WHERE doc_id % 3 = 0", "memories")
def rescued_items(t):
    items = t.memories.where("doc_id % 3 = 0").select("id", (F.col("doc_id") % 5 == 0).alias("rescued"))
    return rc.rescue(items, t.memories.where("doc_id % 4 = 0").select("id"))


@query("best_spans")
def best_spans(t):
    """The part of every whole text that is nearest to a topic."""
    return rc.spans_of(t.memories, "public licence of the work")


@query("suspicion", f"WITH s AS (SELECT id, trust_level, {SIGNALS} AS signals FROM memories) SELECT id, signals, signals >= CASE WHEN trust_level >= 0.7 THEN 3 WHEN trust_level >= 0.3 THEN 2 ELSE 1 END AS suspicious FROM s", "memories")
def suspicion(t):
    return rc.suspicious_report(t.memories)
