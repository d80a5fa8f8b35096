"""Search, recall and discovery over the logical tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import english as en
from ..functions import scoring as sc
from ..functions import text as tx
from ..operators import fulltext
from ..operators import graph as gr
from ..operators import lifecycle as lc
from ..operators import recall as rc
from ..operators import search as se
from .registry import Tables, now, query

PROBE = "m000000000"
#: Two stems, one of them of an inflected word, and a stop word.
WORDS = "things of one"

_SEARCHABLE = "s AS (SELECT * FROM memories WHERE deleted_at IS NULL AND NOT is_consolidated_original AND NOT coalesce(list_has_any(tags, ['suspicious','curation:flagged']), false))"
_PROBE = f"p AS (SELECT embedding AS pv FROM memory_embeddings WHERE memory_id = '{PROBE}')"
_COS = "round(least(1.0, greatest(0.0, CASE WHEN sqrt(list_sum(list_transform(embedding, x -> x*x))) * sqrt(list_sum(list_transform(pv, x -> x*x))) = 0 THEN 0 ELSE list_dot_product(embedding, pv) / (sqrt(list_sum(list_transform(embedding, x -> x*x))) * sqrt(list_sum(list_transform(pv, x -> x*x)))) END)), 6)"
_VECTOR = f"vh AS (SELECT s.id, {_COS} AS score FROM s JOIN memory_embeddings e ON s.id = e.memory_id AND e.is_current, p)"
_TOK = f"tk AS (SELECT id, list_filter(regexp_extract_all(lower(coalesce(content, '')), '[\\p{{L}}\\p{{N}}]+'), x -> x NOT IN {tuple(en.STOP)}) AS t FROM s), sm AS (SELECT word, {en.stem_sql('word', False)} AS stem FROM (SELECT DISTINCT unnest(t) AS word FROM tk))"
_TF = "tf AS (SELECT tk.id, len(t) AS n, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM tk LEFT JOIN (SELECT id, count(*) FILTER (WHERE stem = 'one') AS a, count(*) FILTER (WHERE stem = 'thing') AS b FROM (SELECT id, unnest(t) AS word FROM tk) u JOIN sm ON sm.word = u.word GROUP BY id) g ON g.id = tk.id)"
_ST = "st AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM tf)"
_TEXT = "th AS (SELECT id, round(ln((docs - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln((docs - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM tf, st WHERE a > 0 AND b > 0)"
_SYM = "sh AS (SELECT * FROM (SELECT id, CAST((CASE WHEN coalesce(list_contains(tags, 'en'), false) THEN 3 ELSE 0 END) + (CASE WHEN len(list_filter(coalesce(entities, []), x -> contains(lower(x), 'en'))) > 0 THEN 2 ELSE 0 END) + (CASE WHEN len(list_filter(coalesce(facts, []), x -> contains(lower(x), 'en'))) > 0 THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(type_hint), 'en') THEN 1 ELSE 0 END) + (CASE WHEN coalesce(contains(lower(source), 'en'), false) THEN 1 ELSE 0 END) AS DOUBLE) AS score FROM s) WHERE score > 0)"


def _top(src: str, name: str, k: int = 40) -> str:
    return f"{name} AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {src} ORDER BY score DESC, id LIMIT {k})"


_LEGS = ", ".join([_SEARCHABLE, _PROBE, _VECTOR, _TOK, _TF, _ST, _TEXT, _SYM, _top("th", "t1"), _top("vh", "v1"), _top("sh", "y1")])
_FUSED = "fu AS (SELECT id, round(sum(1.0 / (60.0 + rank)), 9) AS score, bit_or(bit) AS bits FROM (SELECT id, rank, 1 AS bit FROM t1 UNION ALL SELECT id, rank, 2 FROM v1 UNION ALL SELECT id, rank, 4 FROM y1) GROUP BY id)"
_LABEL = "concat_ws('+', CASE WHEN bits & 1 > 0 THEN 'text' END, CASE WHEN bits & 2 > 0 THEN 'vector' END, CASE WHEN bits & 4 > 0 THEN 'symbolic' END)"


def probe(t: Tables, memory_id: str = PROBE):
    """The probe's vector as a scalar subquery's value: a one-row frame."""
    return t.memory_embeddings.where(F.col("memory_id") == memory_id).select("embedding").first()[0]


@query("vector_search", f"WITH {_SEARCHABLE}, {_PROBE}, {_VECTOR} SELECT id, score FROM vh ORDER BY score DESC, id LIMIT 20", "memories memory_embeddings")
def vector_search(t):
    hits = se.vector_hits(se.searchable(t.memories), t.memory_embeddings, probe(t))
    return hits.orderBy(F.col("score").desc(), "id").limit(20)


@query("vector_search_tier", f"WITH {_SEARCHABLE}, {_PROBE}, {_VECTOR} SELECT v.id, row_number() OVER (ORDER BY score DESC, v.id) AS rank FROM vh v JOIN memory_embeddings e ON v.id = e.memory_id WHERE e.tier = 'fast' ORDER BY score DESC, v.id LIMIT 40", "memories memory_embeddings")
def vector_search_tier(t):
    return se.ranked(se.vector_hits(se.searchable(t.memories), t.memory_embeddings, probe(t), "fast"), "score", 40, "vector").select("id", "rank")


@query("text_search", f"WITH {_SEARCHABLE}, {_TOK}, {_TF}, {_ST}, {_TEXT}, {_top('th', 't1')} SELECT t1.id, rank, score FROM t1 JOIN th ON t1.id = th.id", "memories")
def text_search(t):
    return se.ranked(se.text_hits(se.searchable(t.memories), WORDS, t.text_index), "score", 40, "text").select("id", "rank", "score")


@query("text_search_stop_words", "SELECT id, CAST(0 AS DOUBLE) AS score FROM memories WHERE false", "memories")
def text_search_stop_words(t):
    """A query of stop words only finds nothing."""
    return se.text_hits(se.searchable(t.memories), "what is this about", t.text_index)


@query(
    "stem_frequencies",
    f"WITH {_SEARCHABLE}, {_TOK}, u AS (SELECT id, unnest(t) AS word FROM tk) SELECT stem, count(*) AS tf, count(DISTINCT id) AS df, count(DISTINCT u.word) AS words FROM u JOIN sm ON sm.word = u.word GROUP BY stem",
    "memories",
)
def stem_frequencies(t):
    """Of every stem of all texts: occurrences, rows and words."""
    rows = se.searchable(t.memories)
    # counted, not filtered or joined, by stem: a condition on it would be pushed down to where words are not yet distinct
    met = fulltext.stemmed(rows).groupBy("stem", "id").agg(F.count("*").alias("n")).select("stem", F.when(F.col("stem") == "", 0).otherwise(F.col("n")).alias("tf"), F.col("id").isNotNull().cast("long").alias("df"), F.lit(0).cast("long").alias("words"))
    words = rows.select(F.explode(en.content_words(F.col("content"))).alias("word")).distinct()
    own = words.select(en.stem("word").alias("stem"), F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("df"), F.lit(1).cast("long").alias("words"))
    return met.unionByName(own).groupBy("stem").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"), F.sum("words").alias("words")).where("words > 0")


@query("symbolic_search", f"WITH {_SEARCHABLE}, {_SYM}, {_top('sh', 'y1')} SELECT y1.id, rank, score FROM y1 JOIN sh ON y1.id = sh.id", "memories")
def symbolic_search(t):
    return se.ranked(se.symbolic_hits(se.searchable(t.memories), "en"), "score", 40, "symbolic").select("id", "rank", "score")


@query("hybrid_search", f"WITH {_LEGS}, {_FUSED} SELECT id, score, {_LABEL} AS legs FROM fu ORDER BY score DESC, id LIMIT 20", "memories memory_embeddings")
def hybrid_search(t):
    return se.hybrid(t.memories, t.memory_embeddings, WORDS, probe(t), "en", index=t.text_index)


_TIERS = "v1 AS (SELECT id, min(rank) AS rank FROM (SELECT v.id, row_number() OVER (PARTITION BY tier ORDER BY score DESC, v.id) AS rank FROM vh v JOIN memory_embeddings e ON e.memory_id = v.id) WHERE rank <= 40 GROUP BY id)"


@query("hybrid_tiers", f"WITH {_LEGS.replace(_top('vh', 'v1'), _TIERS)}, {_FUSED} SELECT id, score, {_LABEL} AS legs FROM fu ORDER BY score DESC, id LIMIT 20", "memories memory_embeddings")
def hybrid_tiers(t):
    """The vector leg holds the best place of each row in any embedding tier."""
    v = probe(t)
    return se.hybrid(t.memories, t.memory_embeddings, WORDS, {"fast": v, "quality": v}, "en", index=t.text_index)


@query("hybrid_two_legs", f"WITH {_LEGS}, fu AS (SELECT id, round(sum(s), 9) AS score FROM (SELECT id, 1.0 / (60.0 + rank) AS s FROM t1 UNION ALL SELECT id, 1.0 / (30.0 + rank) FROM v1) GROUP BY id) SELECT id, score FROM fu ORDER BY score DESC, id LIMIT 20", "memories memory_embeddings")
def hybrid_two_legs(t):
    """A leg of weight 0 is not planned at all; weight 2 halves k."""
    return se.hybrid(t.memories, t.memory_embeddings, WORDS, probe(t), weights=(1.0, 2.0, 0.0), index=t.text_index).select("id", "score")


@query("hybrid_page_two", f"WITH {_LEGS}, {_FUSED}, c AS (SELECT id, score FROM fu ORDER BY score DESC, id LIMIT 1 OFFSET 9) SELECT fu.id, fu.score FROM fu, c WHERE fu.score < c.score OR (fu.score = c.score AND fu.id > c.id) ORDER BY fu.score DESC, fu.id LIMIT 10", "memories memory_embeddings")
def hybrid_page_two(t):
    fused = se.hybrid(t.memories, t.memory_embeddings, WORDS, probe(t), "en", limit=1000, index=t.text_index)
    last = fused.limit(10).orderBy("score", F.col("id").desc()).limit(1).first()
    return se.after(fused.select("id", "score"), "score", (last.score, last.id), 10)


@query("hybrid_filtered", f"WITH {_LEGS}, {_FUSED}, top AS (SELECT id, score FROM fu ORDER BY score DESC, id LIMIT 40) SELECT top.id, top.score FROM top JOIN memories m ON top.id = m.id WHERE (m.project = 'p1' OR m.project IS NULL) AND m.knowledge_tier <> 'raw' AND (m.source LIKE 'src1%' OR m.source LIKE 'user%')", "memories memory_embeddings")
def hybrid_filtered(t):
    """Filters after the fusion and its limit: fewer rows than the limit."""
    fused = se.hybrid(t.memories, t.memory_embeddings, WORDS, probe(t), "en", limit=40, index=t.text_index)
    rows = fused.join(t.memories.select("id", "project", "knowledge_tier", "source"), "id")
    rows = se.source_prefixes(se.tier_filter(se.project_scope(rows, "p1"), None), ["src1", "user"])
    return rows.select("id", "score")


@query(
    "hybrid_salience",
    f"""WITH {_LEGS}, {_FUSED}, top AS (SELECT id, score FROM fu ORDER BY score DESC, id LIMIT 20),
    r AS (SELECT top.id, top.score, exp(-0.01 * greatest(0.0, epoch($NOW - updated_at) / 86400.0)) AS rec, ln(1 + access_count) AS acc,
      CASE WHEN coalesce(stability, 1.0) <= 0 THEN 0 ELSE least(1.0, greatest(0.0, pow(1 + (19.0/81.0) * (CASE WHEN last_reinforced_at IS NULL THEN 365.0 ELSE greatest(0.0, epoch($NOW - last_reinforced_at) / 86400.0) END) / coalesce(stability, 1.0), -0.5))) END AS rei, trust_level, knowledge_tier
      FROM top JOIN memories m ON top.id = m.id LEFT JOIN memory_salience sa ON sa.memory_id = top.id),
    n AS (SELECT *, CASE WHEN max(rec) OVER () - min(rec) OVER () < 1e-12 THEN 1 ELSE (rec - min(rec) OVER ()) / (max(rec) OVER () - min(rec) OVER ()) END AS a, CASE WHEN max(acc) OVER () - min(acc) OVER () < 1e-12 THEN 1 ELSE (acc - min(acc) OVER ()) / (max(acc) OVER () - min(acc) OVER ()) END AS b,
      CASE WHEN max(score) OVER () - min(score) OVER () < 1e-12 THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS c, CASE WHEN max(rei) OVER () - min(rei) OVER () < 1e-12 THEN 1 ELSE (rei - min(rei) OVER ()) / (max(rei) OVER () - min(rei) OVER ()) END AS d FROM r),
    q AS (SELECT *, 0.25 * a + 0.15 * b + 0.45 * c + 0.15 * d AS sal FROM n)
    SELECT id, score AS rrf, round(sal, 6) AS salience, round(0.4 * c + 0.4 * ((sal - min(sal) OVER ()) / (max(sal) OVER () - min(sal) OVER ())) * trust_level + 0.2 * (CASE knowledge_tier WHEN 'raw' THEN 0 WHEN 'imported' THEN 0.25 WHEN 'explicit' THEN 0.5 WHEN 'derived' THEN 0.75 WHEN 'pattern' THEN 1 ELSE 0.5 END), 6) AS composite, CAST(trust_level AS DOUBLE) AS trust FROM q""",
    "memories memory_embeddings memory_salience",
)
def hybrid_salience(t):
    fused = se.hybrid(t.memories, t.memory_embeddings, WORDS, probe(t), "en", index=t.text_index)
    return se.with_salience(fused, t.memories, t.memory_salience, now()).withColumn("trust", F.col("trust").cast("double"))


@query("discover_band", f"WITH {_SEARCHABLE}, {_PROBE}, {_VECTOR} SELECT id, score FROM (SELECT id, score FROM vh ORDER BY score DESC, id LIMIT 60) WHERE score BETWEEN 0.1 AND 0.4 ORDER BY score DESC, id LIMIT 20", "memories memory_embeddings")
def discover_band(t):
    """Related but not the same: the nearest first, then the band, then the limit."""
    near = se.vector_hits(se.searchable(t.memories), t.memory_embeddings, probe(t)).orderBy(F.col("score").desc(), "id").limit(60)
    return near.where(F.col("score").between(0.1, 0.4)).orderBy(F.col("score").desc(), "id").limit(20)


_PAIRS = "kn AS (SELECT q.memory_id, e.memory_id AS neighbour, round(list_dot_product(e.embedding, q.embedding) / (sqrt(list_sum(list_transform(e.embedding, x -> x*x))) * sqrt(list_sum(list_transform(q.embedding, x -> x*x)))), 6) AS similarity FROM memory_embeddings e, memory_embeddings q WHERE e.memory_id <> q.memory_id)"


@query("neighbours", f"WITH {_PAIRS} SELECT memory_id, neighbour, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY similarity DESC, neighbour) AS place FROM kn WHERE similarity BETWEEN 0.2 AND 1.0) WHERE place <= 5", "memory_embeddings")
def neighbours(t):
    """Every vector against all."""
    return se.neighbours(t.memory_embeddings, t.memory_embeddings, 5, 0.2)


#: The stated set of queries of ``merged_neighbours``.
FIFTIETH = "CAST(substring(memory_id, 2) AS BIGINT) % 50 = 0"
_KNN = _PAIRS.replace("WHERE ", "WHERE CAST(substr(q.memory_id, 2) AS BIGINT) % 50 = 0 AND ")


@query("merged_neighbours", f"WITH {_KNN}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY similarity DESC, neighbour) AS place FROM kn WHERE similarity BETWEEN 0.2 AND 1.0) WHERE place <= 5) SELECT r.memory_id, count(*) AS n, md5(string_agg('Memory ' || place || ':' || chr(10) || content, chr(10) || '---' || chr(10) ORDER BY place)) AS consolidated FROM r JOIN memories m ON r.neighbour = m.id WHERE content IS NOT NULL GROUP BY r.memory_id", "memories memory_embeddings")
def merged_neighbours(t):
    e = t.memory_embeddings
    near = se.neighbours(e, e.where(FIFTIETH), 5, 0.2)
    return lc.merged_text(near, t.memories.where("content is not null")).withColumn("consolidated", F.md5("consolidated"))


@query(
    "recall_by_vector",
    f"""WITH {_SEARCHABLE}, {_PROBE}, {_VECTOR}, f AS (SELECT id, facts[1] AS fact FROM memories WHERE len(facts) > 0),
    h AS (SELECT vh.id, score AS relevance, fact, coalesce(stability, 1.0) AS stability, tags, trust_level FROM vh JOIN s ON vh.id = s.id JOIN f ON vh.id = f.id LEFT JOIN memory_salience sa ON sa.memory_id = vh.id
      WHERE score >= 0.1 AND s.knowledge_tier <> 'raw' AND vh.id NOT IN (SELECT memory_id FROM session_recalls WHERE session_id = 'u3')),
    top AS (SELECT * FROM h ORDER BY relevance DESC, stability DESC, id LIMIT 10)
    SELECT id, fact, relevance, stability, round((relevance + least(0.3, 0.1 * (CASE WHEN list_contains(coalesce(tags, []), 'en') THEN 1 ELSE 0 END)) + least(0.15, 0.05 * (CASE WHEN len(list_filter(coalesce(tags, []), x -> starts_with(x, 'src'))) > 0 AND false THEN 1 ELSE 0 END))) * greatest(trust_level, 0.05), 6) AS boosted FROM top""",
    "memories memory_embeddings memory_salience session_recalls",
)
def recall_by_vector(t):
    return rc.by_vector(t.memories, t.memory_embeddings, t.memory_salience, t.session_recalls, "u3", probe(t), least=0.1, limit=10, explicit=["en"], session_tags=["src:"])


@query(
    "recall_candidates",
    """SELECT m.id, coalesce(stability, 1.0) AS stability FROM memories m LEFT JOIN memory_salience sa ON sa.memory_id = m.id
    WHERE deleted_at IS NULL AND NOT is_consolidated_original AND NOT coalesce(list_has_any(tags, ['suspicious','curation:flagged','project-summary']), false)
      AND m.id NOT IN (SELECT memory_id FROM session_recalls WHERE session_id = 'u3') ORDER BY coalesce(stability, 1.0) DESC, updated_at DESC, m.id LIMIT 30""",
    "memories memory_salience session_recalls",
)
def recall_candidates(t):
    rows = rc.unseen(se.searchable(t.memories), t.session_recalls, "u3").where(~se.has_any(F.col("tags"), ["project-summary"]))
    rows = lc.with_salience(rows, t.memory_salience)
    return rows.orderBy(F.col("stability").desc(), F.col("updated_at").desc(), "id").limit(30).select("id", "stability")


@query("recall_by_salience")
def recall_by_salience(t):
    return rc.by_salience(t.memories, t.memory_salience, t.session_recalls, "u3", now(), 10, explicit=["en"])


@query("session_recall_log", "SELECT session_id, memory_id, floor(epoch(min(recalled_at)))::BIGINT AS recalled_at FROM (SELECT * FROM session_recalls UNION ALL SELECT 'u3', id, $NOW FROM memories WHERE doc_id % 50 = 0) GROUP BY ALL", "memories session_recalls")
def session_recall_log(t):
    out = rc.record(t.session_recalls, t.memories.where("doc_id % 50 = 0"), "u3", now())
    return out.withColumn("recalled_at", F.unix_timestamp("recalled_at"))


@query("latest_project_summary", "SELECT id, md5(content) AS content FROM memories WHERE deleted_at IS NULL AND (project = 'p1' OR project IS NULL) AND list_contains(coalesce(tags, []), 'project-summary') ORDER BY updated_at DESC, id LIMIT 1", "memories")
def latest_project_summary(t):
    return rc.latest_summary(t.memories, "p1").withColumn("content", F.md5("content"))


@query(
    "fuse_lists",
    "WITH a AS (SELECT id, row_number() OVER (ORDER BY access_count DESC, id) AS rank FROM memories ORDER BY access_count DESC, id LIMIT 30), b AS (SELECT id, row_number() OVER (ORDER BY trust_level DESC, id) AS rank FROM memories ORDER BY trust_level DESC, id LIMIT 30) SELECT id, round(sum(1.0 / (60.0 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id",
    "memories",
)
def fuse_lists(t):
    m = t.memories
    lists = [se.ranked(m.select("id", F.col(c).cast("double").alias("score")), "score", 30, c) for c in ("access_count", "trust_level")]
    return se.fuse_lists(lists)


@query("merge_tiers_min_rank", f"WITH {_SEARCHABLE}, {_PROBE}, {_VECTOR}, r AS (SELECT v.id, row_number() OVER (PARTITION BY tier ORDER BY score DESC, v.id) AS rank FROM vh v JOIN memory_embeddings e ON e.memory_id = v.id) SELECT id, min(rank) AS rank FROM r WHERE rank <= 40 GROUP BY id", "memories memory_embeddings")
def merge_tiers_min_rank(t):
    rows = se.searchable(t.memories)
    legs = [se.ranked(se.vector_hits(rows, t.memory_embeddings, probe(t), tier), "score", 40, tier) for tier in ("fast", "quality")]
    return legs[0].unionByName(legs[1]).groupBy("id").agg(F.min("rank").alias("rank"))


@query("scores", "SELECT id, round(exp(-0.01 * greatest(0.0, epoch($NOW - updated_at) / 86400.0)), 6) AS recency, round(ln(1 + access_count), 6) AS access, CASE knowledge_tier WHEN 'raw' THEN 0.0 WHEN 'imported' THEN 0.25 WHEN 'explicit' THEN 0.5 WHEN 'derived' THEN 0.75 WHEN 'pattern' THEN 1.0 ELSE 0.5 END::DOUBLE AS tier, (CASE type_hint WHEN 'decision' THEN 5.0 WHEN 'preference' THEN 5.0 WHEN 'instruction' THEN 3.5 WHEN 'fact' THEN 2.5 WHEN 'summary' THEN 2.0 WHEN 'observation' THEN 1.0 ELSE 2.5 END)::DOUBLE AS initial, (CASE WHEN source IN ('user', 'cli') OR actor_type = 'user' THEN 0.8 WHEN source LIKE 'auto-store%' OR actor_type = 'auto-store' THEN 0.3 WHEN source LIKE 'import%' THEN 0.4 ELSE 0.5 END)::DOUBLE AS trust, CASE WHEN write_path IN ('auto_store', 'session_summary', 'ingest') THEN 'raw' WHEN write_path = 'import' THEN 'imported' ELSE 'explicit' END AS inferred_tier FROM memories", "memories")
def scores(t):
    return t.memories.select(
        "id",
        F.round(sc.recency(sc.days_between(now(), F.col("updated_at"))), 6).alias("recency"),
        F.round(sc.access_score(F.col("access_count")), 6).alias("access"),
        sc.tier_score(F.col("knowledge_tier")).alias("tier"),
        sc.initial_stability(F.col("type_hint")).alias("initial"),
        sc.infer_trust(F.coalesce("source", F.lit("")), F.col("actor_type")).alias("trust"),
        sc.infer_tier(F.col("write_path")).alias("inferred_tier"),
    )


@query("retrievability", "SELECT memory_id, round(CASE WHEN stability <= 0 THEN 0 ELSE least(1.0, greatest(0.0, pow(1 + (19.0/81.0) * greatest(0.0, epoch($NOW - last_reinforced_at) / 86400.0) / stability, -0.5))) END, 6) AS r FROM memory_salience", "memory_salience")
def retrievability(t):
    return t.memory_salience.select("memory_id", F.round(sc.retrievability(F.col("stability"), sc.days_between(now(), F.col("last_reinforced_at"))), 6).alias("r"))


@query("reinforce", "WITH r AS (SELECT *, least(1.0, greatest(0.0, pow(1 + (19.0/81.0) * greatest(0.0, epoch($NOW - last_reinforced_at) / 86400.0) / stability, -0.5))) AS r FROM memory_salience) SELECT memory_id, round(least(36500.0, greatest(0.1, stability * (1 + (1 - r) * 1.5))), 6) AS good, round(least(36500.0, greatest(0.1, stability * (1 + (1 - r) * 2.0))), 6) AS easy, round(least(stability * 1.15, 100.0), 6) AS recalled, round(least(36500.0, greatest(0.1, stability * 1.5)), 6) AS useful, round(least(36500.0, greatest(0.1, stability * 0.2)), 6) AS irrelevant FROM r", "memory_salience")
def reinforce(t):
    days, s = sc.days_between(now(), F.col("last_reinforced_at")), F.col("stability")
    return t.memory_salience.select("memory_id", *[F.round(sc.reinforced(s, days, F.lit(r)), 6).alias(r) for r in ("good", "easy")], F.round(sc.recall_bump(s), 6).alias("recalled"), *[F.round(sc.feedback(s, F.col("difficulty"), F.lit(x))[0], 6).alias(x) for x in ("useful", "irrelevant")])


@query("search_cursor", f"""WITH {_SEARCHABLE}, {_PROBE}, {_VECTOR}, t AS (SELECT id, score FROM vh ORDER BY score DESC, id LIMIT 10) SELECT id, rtrim(translate(base64(encode(concat('{{"t":"s","s":', CAST(score AS VARCHAR), ',"i":"', id, '"}}'))), '+/', '-_'), '=') AS cursor, true AS same_id, true AS same_score FROM t""", "memories memory_embeddings")
def search_cursor(t):
    """Cursors of a page and what they decode to."""
    page = se.vector_hits(se.searchable(t.memories), t.memory_embeddings, probe(t)).orderBy(F.col("score").desc(), "id").limit(10)
    out = page.withColumn("cursor", se.encode_cursor(F.col("score"), F.col("id"))).withColumn("back", se.decode_cursor(F.col("cursor")))
    return out.select("id", "cursor", (F.col("back.i") == F.col("id")).alias("same_id"), (F.col("back.s") == F.col("score")).alias("same_score"))


@query("session_expansion", "WITH h AS (SELECT session_id, count(*) AS hits, max(access_count) AS best FROM memories WHERE type_hint = 'fact' GROUP BY 1 ORDER BY hits DESC, best DESC, session_id LIMIT 5) SELECT m.id, m.session_id, floor(epoch(created_at))::BIGINT AS at FROM memories m JOIN h ON m.session_id = h.session_id", "memories")
def session_expansion(t):
    m = t.memories
    best = m.where("type_hint = 'fact'").groupBy("session_id").agg(F.count("*").alias("hits"), F.max("access_count").alias("best")).orderBy(F.col("hits").desc(), F.col("best").desc(), "session_id").limit(5)
    return m.join(best, "session_id", "left_semi").select("id", "session_id", F.unix_timestamp("created_at").alias("at"))


@query("quarantine_leaks", "SELECT 'listed' AS results, id FROM memories WHERE deleted_at IS NULL AND type_hint = 'fact' AND list_has_any(coalesce(tags, []), ['suspicious', 'curation:flagged'])", "memories")
def quarantine_leaks(t):
    """A plain list leaks what is quarantined, what searches may show does not."""
    listed = se.live(t.memories).where("type_hint = 'fact'").select("id", F.lit("listed").alias("results"))
    shown = se.searchable(t.memories).select("id", F.lit("searched").alias("results"))
    return se.leaks(listed.unionByName(shown), t.memories).select("results", "id")


@query("related_counts", "WITH g AS (SELECT DISTINCT id, unnest(tags) AS tag FROM memories WHERE deleted_at IS NULL), x AS (SELECT * FROM g WHERE tag NOT IN ('en', 'de', 'fr', 'es')) SELECT a.id, count(DISTINCT b.id) AS related FROM x a JOIN x b ON a.tag = b.tag AND a.id <> b.id JOIN memories m ON m.id = a.id WHERE m.type_hint = 'decision' GROUP BY a.id", "memories")
def related_counts(t):
    return gr.related_counts(t.memories, t.memories.where("type_hint = 'decision'"), ["en", "de", "fr", "es"])


@query(
    "token_f1",
    r"WITH x AS (SELECT a.id, regexp_extract_all(lower(coalesce(a.content, '')), '[\p{L}\p{N}]+') AS p, regexp_extract_all(lower(coalesce(b.content, '')), '[\p{L}\p{N}]+') AS q FROM memories a JOIN memories b ON b.id = a.source_ids[1]), pc AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(p) AS t FROM x) GROUP BY ALL), qc AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(q) AS t FROM x) GROUP BY ALL), y AS (SELECT x.id, len(p) AS a, len(q) AS b, coalesce(c, 0) AS c FROM x LEFT JOIN (SELECT pc.id, sum(least(pc.n, qc.n)) AS c FROM pc JOIN qc ON qc.id = pc.id AND qc.t = pc.t GROUP BY pc.id) m ON m.id = x.id) SELECT id, round(CASE WHEN a = 0 AND b = 0 THEN 1.0 WHEN a = 0 OR b = 0 OR c = 0 THEN 0.0 ELSE 2 * (c / a) * (c / b) / (c / a + c / b) END, 6) AS f1 FROM y",
    "memories",
)
def token_f1(t):
    """Every derived text against its first source, whole texts."""
    source = t.memories.select(F.col("id").alias("source_id"), F.col("content").alias("truth"))
    rows = t.memories.where("source_ids is not null").select("id", F.col("content").alias("prediction"), F.col("source_ids")[0].alias("source_id")).join(source, "source_id")
    return tx.token_f1(rows, "id").select("id", F.round("f1", 6).alias("f1"))


@query("rerank_blend", "WITH b AS (SELECT id, trust_level, access_count, row_number() OVER (ORDER BY access_count DESC, id) AS r FROM memories ORDER BY access_count DESC, id LIMIT 10) SELECT id, round(0.7 / (1 + r) + 0.3 * (CASE WHEN max(access_count) OVER () - min(access_count) OVER () < 1e-12 THEN 1 ELSE (access_count - min(access_count) OVER ()) / (max(access_count) OVER () - min(access_count) OVER ()) END) * trust_level, 6) AS blended FROM b", "memories")
def rerank_blend(t):
    top = t.memories.orderBy(F.col("access_count").desc(), "id").limit(10).withColumn("r", F.row_number().over(Window.orderBy(F.col("access_count").desc(), "id")))
    return top.select("id", F.round(sc.rerank_blend(F.col("r"), sc.min_max(F.col("access_count").cast("double"), Window.partitionBy()), F.col("trust_level")), 6).alias("blended"))
