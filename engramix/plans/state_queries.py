"""Time hints, cursors and changes of state over the logical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hints as hi
from ..operators import search as se
from ..operators import state as st
from .registry import epoch, now, query


@query(
    "time_hints",
    """WITH c AS (SELECT conv_id, turn, epoch($NOW)::BIGINT AS n, turn % 4 AS k, turn % 9 + 2 AS d FROM messages)
    SELECT conv_id, turn, CASE k WHEN 0 THEN n - 86400 WHEN 1 THEN n - (d + 1) * 86400 WHEN 2 THEN n - 18 * 86400 ELSE epoch(TIMESTAMP '2024-01-05')::BIGINT END AS after,
      CASE k WHEN 0 THEN n - 1 WHEN 1 THEN n - (d - 1) * 86400 WHEN 2 THEN n - 10 * 86400 END AS before FROM c""",
    "messages",
)
def time_hints(t):
    k = F.col("turn") % 4
    text = F.when(k == 0, "What did we decide yesterday?").when(k == 1, F.concat((F.col("turn") % 9 + 2).cast("string"), F.lit(" days ago"))).when(k == 2, "notes of Two Weeks ago").otherwise("all after 2024-01-05")
    span = hi.time_range(text, now())
    return t.messages.select("conv_id", "turn", epoch(span["after"]).alias("after"), epoch(span["before"]).alias("before"))


@query("time_boost", "SELECT id, access_count * (CASE WHEN coalesce(event_time, created_at) BETWEEN $NOW - INTERVAL 18 DAY AND $NOW - INTERVAL 10 DAY THEN 2.0 ELSE 1.0 END)::DOUBLE AS score FROM memories", "memories")
def time_boost(t):
    span = hi.time_range(F.lit("two weeks ago"), now())
    return t.memories.select("id", hi.time_boost(F.col("access_count").cast("double"), F.coalesce("event_time", "created_at"), span).alias("score"))


@query("since_duration", "SELECT id FROM memories WHERE updated_at > $NOW - INTERVAL 36 HOUR", "memories")
def since_duration(t):
    return t.memories.where(F.col("updated_at") > hi.since("36h", now())).select("id")


@query("list_cursor", "SELECT id, rtrim(translate(to_base64(encode(concat(strftime(created_at, '%Y-%m-%dT%H:%M:%SZ'), '|', id))), '+/', '-_'), '=') AS cursor, id AS back, floor(epoch(created_at))::BIGINT AS at FROM memories", "memories")
def list_cursor(t):
    rows = t.memories.select("id", hi.encode_list_cursor(F.col("created_at"), F.col("id")).alias("cursor"))
    back = hi.decode_list_cursor(F.col("cursor"))
    return rows.select("id", "cursor", back["key"].alias("back"), epoch(back["at"]).alias("at"))


@query("retagged", "SELECT id, array_to_string(CASE WHEN doc_id % 2 = 0 THEN (CASE WHEN list_contains(k, 'en') THEN k ELSE list_append(k, 'en') END) ELSE tags END, ',') AS tags FROM (SELECT id, doc_id, tags, coalesce(list_filter(tags, x -> x <> 'suspicious'), []) AS k FROM memories)", "memories")
def retagged(t):
    out = st.retag(t.memories, t.memories.where("doc_id % 2 = 0"), "en", "suspicious")
    return out.select("id", F.array_join("tags", ",").alias("tags"))


@query("annotations", "SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'seen,kept' END AS notes, floor(epoch(CASE WHEN doc_id % 3 = 0 THEN $NOW ELSE updated_at END))::BIGINT AS updated_at FROM memories", "memories")
def annotations(t):
    own = t.memories.where("doc_id % 3 = 0").select("id", F.explode(F.array(F.struct(F.lit(2).alias("at"), F.lit("kept").alias("note")), F.struct(F.lit(1).alias("at"), F.lit("seen").alias("note")))).alias("n")).select("id", "n.*")
    out = st.annotated(t.memories, own, now())
    return out.select("id", F.array_join("annotations", ",").alias("notes"), epoch("updated_at").alias("updated_at"))


@query(
    "session_tags",
    """WITH c AS (SELECT session_id, max(printf('%012d', epoch(created_at)::BIGINT) || id) AS cleared FROM memories WHERE doc_id % 40 = 7 GROUP BY 1),
    l AS (SELECT m.session_id, printf('%012d', epoch(created_at)::BIGINT) || id AS w, unnest(tags) AS tag, generate_subscripts(tags, 1) AS n FROM memories m WHERE doc_id % 40 <> 7),
    f AS (SELECT l.session_id, tag, min(w || printf('%04d', n)) AS first FROM l LEFT JOIN c ON c.session_id = l.session_id WHERE cleared IS NULL OR w > cleared GROUP BY ALL)
    SELECT session_id, string_agg(tag, ',' ORDER BY first) AS tags FROM f GROUP BY 1""",
    "memories",
)
def session_tags(t):
    log = t.memories.select("session_id", F.col("created_at").alias("at"), "id", "tags", (F.col("doc_id") % 40 == 7).alias("cleared"))
    return st.session_tags(log).withColumn("tags", F.array_join("tags", ","))


@query("idle_sessions", "SELECT session_id, floor(epoch(max(recalled_at)))::BIGINT AS last_at FROM session_recalls GROUP BY 1 HAVING epoch($NOW - max(recalled_at)) > 129600", "session_recalls")
def idle_sessions(t):
    return st.idle_sessions(t.session_recalls, now(), 129600).withColumn("last_at", F.unix_timestamp("last_at"))


_PAIRS = "p AS (SELECT m.id AS memory_id, k.keeper FROM memories m JOIN (SELECT md5(content) AS h, min(id) AS keeper FROM memories WHERE content IS NOT NULL GROUP BY 1) k ON md5(m.content) = k.h WHERE m.id <> k.keeper)"


@query("merged_duplicates", f"WITH {_PAIRS} SELECT m.id, access_count + coalesce(n, 0) AS access_count, coalesce(n, 0) AS merged, deleted_at IS NOT NULL OR m.id IN (SELECT memory_id FROM p) AS deleted FROM memories m LEFT JOIN (SELECT keeper, count(*) AS n FROM p GROUP BY 1) g ON g.keeper = m.id", "memories")
def merged_duplicates(t):
    rows = t.memories.where("content is not null").select("id", F.md5("content").alias("h"))
    pairs = rows.join(rows.groupBy("h").agg(F.min("id").alias("keeper")), "h").where("id <> keeper").select(F.col("id").alias("memory_id"), "keeper")
    return st.merge_duplicates(t.memories, pairs, now()).select("id", "access_count", "merged", F.col("deleted_at").isNotNull().alias("deleted"))


@query("consolidated", "SELECT id, is_consolidated_original OR id IN (SELECT unnest(source_ids) FROM memories WHERE doc_id % 25 = 3) AS original FROM memories", "memories")
def consolidated(t):
    rows, _ = st.consolidate(t.memories, t.memories.where("doc_id % 25 = 3").select("id", "source_ids"))
    return rows.select("id", F.col("is_consolidated_original").alias("original"))


@query("model_switch", "SELECT memory_id, is_current AND model_name = 'model-a' AND model_version = '2' AS is_current FROM memory_embeddings", "memory_embeddings")
def model_switch(t):
    return st.stale(t.memory_embeddings, "model-a", "2").select("memory_id", "is_current")


@query("tier_deactivated", "SELECT memory_id, is_current AND NOT (label = 4 AND tier = 'fast') AS is_current FROM memory_embeddings", "memory_embeddings")
def tier_deactivated(t):
    e = t.memory_embeddings
    return st.deactivated(e, e.where("label = 4").select(F.col("memory_id").alias("id")), "fast").select("memory_id", "is_current")


@query("undo_memories", "SELECT id, deleted_at IS NOT NULL AND doc_id % 23 <> 0 AS deleted, is_consolidated_original AND doc_id % 23 <> 0 AS original, array_to_string(CASE WHEN doc_id % 10 = 1 THEN list_filter(tags, x -> x <> 'en') ELSE tags END, ',') AS tags FROM memories WHERE doc_id % 23 <> 5", "memories")
def undo_memories(t):
    return _undo(t)[0].select("id", F.col("deleted_at").isNotNull().alias("deleted"), F.col("is_consolidated_original").alias("original"), F.array_join("tags", ",").alias("tags"))


@query("undo_salience", "SELECT s.memory_id, coalesce(CASE WHEN m.doc_id % 10 = 2 THEN 1.5 END, stability)::DOUBLE AS stability FROM memory_salience s LEFT JOIN memories m ON m.id = s.memory_id", "memories memory_salience")
def undo_salience(t):
    return _undo(t)[1].select("memory_id", F.col("stability").cast("double").alias("stability"))


def _undo(t):
    m = t.memories
    none = F.lit(None).cast("string")
    after = F.concat(F.lit("m"), F.lpad((F.col("doc_id") + 5).cast("string"), 9, "0"))
    merge = m.where("doc_id % 23 = 0").select(F.lit("r1").alias("run_id"), F.lit("merge").alias("kind"), F.col("id").alias("memory_id"), after.alias("merged_id"), F.lit(None).cast("double").alias("stability"))
    flag = m.where("doc_id % 10 = 1").select(F.lit("r1"), F.lit("flag"), "id", none, F.lit(None).cast("double"))
    strong = m.where("doc_id % 10 = 2").select(F.lit("r1"), F.lit("strengthen"), "id", none, F.lit(1.5))
    other = m.where("doc_id % 10 = 3").select(F.lit("r2"), F.lit("strengthen"), "id", none, F.lit(9.5))
    return st.undo_run(m, t.memory_salience, merge.union(flag).union(strong).union(other), "r1", "en")


_NORM = "sqrt(list_sum(list_transform({0}, x -> x*x)))"
_TOPIC = f"p AS (SELECT embedding AS pv FROM memory_embeddings WHERE memory_id IN ('m000000000', 'm000000001')), c AS (SELECT memory_id, max(list_dot_product(embedding, pv) / ({_NORM.format('embedding')} * {_NORM.format('pv')})) AS best FROM memory_embeddings, p GROUP BY 1)"


@query("off_topic", f"WITH {_TOPIC} SELECT memory_id, best >= 0.3 AS dropped FROM c", "memory_embeddings")
def off_topic(t):
    topics = [r[0] for r in t.memory_embeddings.where(F.col("memory_id").isin("m000000000", "m000000001")).select("embedding").collect()]  # the stated topics
    return st.off_topic(t.memory_embeddings, topics, 0.3).select("memory_id", "dropped")


@query("best_of_tiers", f"WITH {_TOPIC}, s AS (SELECT memory_id AS id, round(greatest(0.0, list_dot_product(embedding, pv) / ({_NORM.format('embedding')} * {_NORM.format('pv')})), 6) AS score, tier FROM memory_embeddings, (SELECT embedding AS pv FROM memory_embeddings WHERE memory_id = 'm000000000') WHERE is_current) SELECT s.id, max(score) AS score FROM s JOIN memories m ON m.id = s.id WHERE deleted_at IS NULL AND NOT is_consolidated_original AND NOT coalesce(list_has_any(tags, ['suspicious', 'curation:flagged']), false) GROUP BY s.id", "memories memory_embeddings")
def best_of_tiers(t):
    vector = t.memory_embeddings.where("memory_id = 'm000000000'").select("embedding").first()[0]
    rows = se.searchable(t.memories)
    return st.best_of_tiers([se.vector_hits(rows, t.memory_embeddings, vector, tier).select("id", "score") for tier in ("fast", "quality")])
