"""Intake of messages, imports and hashes over the logical tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .. import scratch
from ..functions import hashes
from ..operators import intake as it
from ..operators import lifecycle as lc
from ..sources import importing, tail
from ..streaming import jobs, sweeps
from .registry import epoch, query
from .table_queries import _LE, _NORM

LIMITS = it.Limits(batch=8, content=500, excluded=(("licence", "(?i)licensed under"), ("digits", "[0-9]{3}-[0-9]{4}")))


def chat_messages(t):
    """Every turn of every conversation as a message; each seventh conversation is sent again."""
    rows = t.messages.select(
        F.col("conv_id").cast("string").alias("request"), F.col("turn").cast("long").alias("idx"), F.lit("chatbot").alias("source"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.concat(F.lit("p"), (F.col("conv_id") % 4).cast("string")).alias("project"),
        "role", "content", "at", F.lit(None).cast("string").alias("idempotency_key"), F.lit(None).cast("string").alias("reply_to_id"), "conv_id",
    )
    again = rows.where("conv_id % 7 = 0").withColumn("request", F.concat(F.lit("retry-"), F.col("request")))
    return rows.unionByName(again).drop("conv_id")


_KEY = " || ".join(f"{_LE(x)} || encode({x})" for x in ("source", "session_id", "coalesce(role, '')", "content", "strftime(moment, '%Y-%m-%dT%H:%M:%S.%fZ')"))
_JUDGED = f"""x AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS request, turn AS idx, 'chatbot' AS source, concat('s', conv_id) AS session_id, role, content, messages.at AS moment FROM messages),
    y AS (SELECT * FROM x UNION ALL SELECT conv_id, concat('retry-', request), idx, source, session_id, role, content, moment FROM x WHERE conv_id % 7 = 0),
    z AS (SELECT *, count(*) OVER (PARTITION BY request) AS n FROM y),
    e AS (SELECT *, CASE WHEN n > 8 THEN concat('batch size ', n, ' exceeds configured max_batch_size 8') WHEN content IS NULL THEN 'no content' WHEN strlen(content) > 500 THEN concat('content too large: ', strlen(content), ' bytes exceeds max_content_size 500') END AS error,
      CASE WHEN regexp_matches(content, '(?i)licensed under') THEN 'licence' WHEN regexp_matches(content, '[0-9]{{3}}-[0-9]{{4}}') THEN 'digits' END AS filtered FROM z),
    k AS (SELECT *, CASE WHEN error IS NULL AND filtered IS NULL THEN sha256({_KEY}) END AS key FROM e),
    j AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN filtered IS NOT NULL THEN 'filtered' WHEN row_number() OVER (PARTITION BY key ORDER BY moment, request, idx) > 1 THEN 'duplicate' ELSE 'stored' END AS status,
      concat_ws('-', substr(key, 1, 8), substr(key, 9, 4), substr(key, 13, 4), substr(key, 17, 4), substr(key, 21, 12)) AS made FROM k),
    m AS (SELECT *, CASE WHEN key IS NOT NULL THEN made END AS memory_id FROM j),
    r AS (SELECT *, last_value(memory_id IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY moment, request, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)"""


@query("ingest_statuses", f"WITH {_JUDGED} SELECT request, CAST(idx AS BIGINT) AS idx, status, coalesce(error, filtered) AS reason, memory_id, CASE WHEN memory_id IS NOT NULL THEN before END AS reply_to_id FROM r", "messages")
def ingest_statuses(t):
    """Status of every message: refused, filtered, duplicate or stored, and what it replies to."""
    judged = it.judge(chat_messages(t), t.spark.createDataFrame([], it.KEYS), t.spark.createDataFrame([], it.HEADS), LIMITS)
    return judged.select("request", "idx", "status", "reason", "memory_id", "reply_to_id")


@query("ingested_memories", f"WITH {_JUDGED} SELECT memory_id AS id, session_id, floor(epoch(moment))::BIGINT AS moment, before AS reply_to_id, 'bot' AS actor_type, concat('session:', session_id, ',project:p', conv_id % 4) AS tags FROM r WHERE status = 'stored'", "messages")
def ingested_memories(t):
    """The rows that intake adds to the memories."""
    judged = it.judge(chat_messages(t), t.spark.createDataFrame([], it.KEYS), t.spark.createDataFrame([], it.HEADS), LIMITS)
    rows = it.tables(judged)["memories"]
    plain = F.array_remove("tags", "warning:prompt-injection")
    return rows.select("id", "session_id", epoch("created_at").alias("moment"), "reply_to_id", "actor_type", F.array_join(plain, ",").alias("tags"))


@query(
    "fnv_hashes",
    "WITH b AS (SELECT id, list_transform(regexp_extract_all(hex(encode(content)), '..'), x -> CAST(concat('0x', x) AS UBIGINT)) AS bytes FROM memories WHERE content IS NOT NULL) SELECT id, printf('%016x', CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), CAST(bytes AS HUGEINT[])), lambda h, x: (CAST(xor(CAST(h AS UBIGINT), CAST(x AS UBIGINT)) AS HUGEINT) * 1099511628211) % 18446744073709551616) AS UBIGINT)) AS hash FROM b",
    "memories",
)
def fnv_hashes(t):
    """FNV-1a of every whole text."""
    return t.memories.where("content is not null").select("id", hashes.fnv1a_hex(F.col("content")).alias("hash"))


_NOISY = "strlen(trim(content)) < 50 OR contains(lower(trim(content)), 'license')"


@query(
    "import_resumed",
    f"WITH o AS (SELECT DISTINCT sha256({_NORM}) AS hash FROM memories WHERE content IS NOT NULL AND doc_id % 10 = 0), c AS (SELECT sha256({_NORM}) AS hash FROM memories WHERE content IS NOT NULL AND NOT ({_NOISY})) SELECT DISTINCT hash, CAST(1 AS BIGINT) AS n FROM c WHERE hash NOT IN (SELECT hash FROM o)",
    "memories",
)
def import_resumed(t):
    """An import of all texts that ended after three batches, resumed over its half-written manifest: each chunk once."""
    rows = t.memories.where("content is not null")
    chunks = rows.select("content", "source", "tags", "created_at")
    job = importing.Import(t.spark, scratch.folder(t.spark), 8)
    for most in (3, None):
        job.run(chunks, rows.where("doc_id % 10 = 0"), noise=["License"], most=most)
    return job.stored().groupBy("hash").agg(F.count("*").alias("n"))


@query("swept", "SELECT id, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 1 ELSE 2 END AS run FROM memories WHERE deleted_at IS NULL AND extraction_status = 'pending'", "memories")
def swept(t):
    """The run of a sweep that did each pending memory, of three over a growing table."""
    sweep = sweeps.Sweep(t.spark, scratch.folder(t.spark), "backfill")
    pending = lc.queue(t.memories, "extraction").select("id", F.col("created_at").alias("at"), "doc_id")
    for run in range(3):
        sweep.run(pending.where(F.col("doc_id") % 3 <= run), lambda rows: None, datetime(2024, 2, 1, run))
    return sweep.log().select("id", "run")


@query("followed_logs", "SELECT coalesce(role, '') AS role, count(*) AS n, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM messages WHERE role IN ('user', 'assistant') AND trim(content) <> '' GROUP BY 1", "messages")
def followed_logs(t):
    """Entries of all conversations written as logs in two steps and followed by one stream that is stopped in between."""
    folder = scratch.folder(t.spark)
    line = F.to_json(F.struct(F.struct("role", "content").alias("message"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")))
    for part in range(2):
        t.messages.where(F.col("conv_id") % 2 == part).select(line.alias("value")).write.text(f"{folder}/logs/part={part}")
        stream = tail.follow_logs(t.spark, [f"{folder}/logs"], suffix=".txt")
        jobs.into(stream, jobs.append_once(f"{folder}/store"), f"{folder}/offsets").awaitTermination()
    rows = t.spark.read.parquet(f"{folder}/store")
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))
