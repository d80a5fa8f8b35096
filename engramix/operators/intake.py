"""Taking in messages: one chain from raw messages to the rows of all tables.

A message is (request, idx, source, session_id, project, role, content, at) and
perhaps its own idempotency_key and reply_to_id. The stages run in a fixed order:
requests that are too large and messages that are too long are refused, content
is redacted, excluded patterns filter, known keys are duplicates, and what is
left is stored. Every message gets a status row; nothing is dropped silently.

A memory's id follows from its key, so a repeated run makes the same rows. A
message replies to the last message of its session that is stored or a duplicate;
``heads`` carries the last one of each session from run to run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import redaction
from ..functions import text as tx

MESSAGE = "request string, idx long, source string, session_id string, project string, role string, content string, at timestamp, idempotency_key string, reply_to_id string"
KEYS = "idempotency_key string, memory_id string"
HEADS = "source string, session_id string, memory_id string, at timestamp"
#: Trust and first stability of what is taken in, and of what a classifier rates low.
TRUST, STABILITY, STABILITY_LOW, DIFFICULTY = 0.3, 2.5, 1.5, 5.0


@dataclass(frozen=True)
class Limits:
    """Messages of a request, bytes of a content, and patterns that exclude, by name."""

    batch: int = 100
    content: int = 65536
    excluded: tuple[tuple[str, str], ...] = ()


def memory_id(key: Column) -> Column:
    """An id in the form of a UUID out of a key's first 128 bits."""
    return F.when(key.isNotNull(), F.concat_ws("-", *[F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def judge(messages: DataFrame, keys: DataFrame, heads: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Messages with redacted content, key, status (stored, duplicate, filtered, error), reason, memory_id and reply_to.

    ``keys``: unexpired (idempotency_key, memory_id); ``heads``: the last memory
    of each session so far. Of messages with one key the first by (at, request,
    idx) is stored. A request over the limit is refused whole. Messages without
    content are errors. Rows that repeat request, idx and key are one message:
    each has its status row, its memory is stored once.
    """
    size = messages.groupBy("request").agg(F.count("*").alias("_n"))
    rows = redaction.redact(messages.join(size, "request"), "content").withColumnRenamed("content", "_raw")
    rows = rows.withColumn("content", F.col("redacted.content")).withColumn("redactions", F.col("redacted.redactions")).drop("redacted")
    length = F.octet_length("_raw")
    error = (
        F.when(F.col("_n") > limits.batch, F.concat(F.lit("batch size "), F.col("_n").cast("string"), F.lit(f" exceeds configured max_batch_size {limits.batch}")))
        .when(F.col("_raw").isNull(), F.lit("no content"))
        .when(length > limits.content, F.concat(F.lit("content too large: "), length.cast("string"), F.lit(f" bytes exceeds max_content_size {limits.content}")))
    )
    filtered = F.lit(None).cast("string")
    for name, pattern in reversed(limits.excluded):
        filtered = F.when(F.col("content").rlike(pattern), F.lit(name)).otherwise(filtered)
    key = F.coalesce("idempotency_key", tx.message_key(F.col("source"), F.col("session_id"), F.col("at"), F.col("role"), F.col("_raw")))
    rows = rows.withColumn("reason", F.coalesce(error, filtered)).withColumn("_error", error.isNotNull())
    rows = rows.withColumn("idempotency_key", F.when(F.col("reason").isNull(), key))
    # a key is met first by the least (at, request, idx); the aggregate is combined in each task before it is dealt by key
    place = F.struct("at", "request", "idx")
    first = rows.where(F.col("idempotency_key").isNotNull()).groupBy("idempotency_key").agg(F.min(place).alias("_first"))
    known = first.join(keys.select("idempotency_key", F.col("memory_id").alias("_known")).dropDuplicates(["idempotency_key"]), "idempotency_key", "left")
    rows = rows.join(known, "idempotency_key", "left")
    status = F.when(F.col("_error"), "error").when(F.col("reason").isNotNull(), "filtered").when(F.col("_known").isNotNull() | (F.col("_first") != place), "duplicate").otherwise("stored")
    rows = rows.withColumn("status", status).withColumn("memory_id", F.coalesce("_known", memory_id(F.col("idempotency_key"))))
    before = Window.partitionBy("source", "session_id").orderBy("at", "request", "idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.last("memory_id", ignorenulls=True).over(before))
    last = heads.groupBy("source", "session_id").agg(F.max_by("memory_id", "at").alias("_head"))
    rows = rows.join(last, ["source", "session_id"], "left")
    reply = F.when(F.col("memory_id").isNotNull(), F.coalesce("reply_to_id", "_before", "_head"))
    return rows.select("request", "idx", "source", "session_id", "project", "role", "content", "redactions", "at", "idempotency_key", "status", "reason", "memory_id", reply.alias("reply_to_id"))


def tables(judged: DataFrame, birth_year: int | None = None) -> dict[str, DataFrame]:
    """What judged messages add to each table, by its name."""
    own = judged.where("status = 'stored'").dropDuplicates(["memory_id"])
    tags = F.array_compact(F.array(F.concat(F.lit("session:"), F.col("session_id")), F.concat(F.lit("project:"), F.col("project")), F.when(F.size(tx.injection_signals(F.col("content"))) > 0, F.lit("warning:prompt-injection"))))
    event = tx.event_time(F.col("content"), F.col("at"), birth_year)
    bot = F.when(F.contains(F.lower("source"), F.lit("bot")), "bot").otherwise("user")
    memories = own.withColumn("_event", event).select(
        F.col("memory_id").alias("id"), "content", F.lit("auto").alias("type_hint"), "source", tags.alias("tags"), F.col("at").alias("created_at"), bot.alias("actor_type"), F.lit("global").alias("audience"), "project", "session_id",
        F.lit(TRUST).alias("trust_level"), F.lit("ingest").alias("write_path"), "reply_to_id", F.col("_event.time").alias("event_time"), F.col("_event.precision").alias("event_time_precision"), F.lit("pending").alias("embedding_status"), F.lit("pending").alias("extraction_status"),
    )
    last = judged.where(F.col("memory_id").isNotNull()).groupBy("source", "session_id").agg(F.max_by(F.struct("memory_id", "at"), F.struct("at", "request", "idx")).alias("l"))
    return {
        "memories": memories,
        "salience": own.select("memory_id", F.lit(STABILITY).alias("stability"), F.lit(DIFFICULTY).alias("difficulty"), F.lit(0).cast("long").alias("reinforcement_count"), F.lit(None).cast("timestamp").alias("last_reinforced_at")),
        "keys": own.select("idempotency_key", "memory_id"),
        "heads": last.select("source", "session_id", "l.memory_id", "l.at"),
        "companions": own.select("memory_id", "source", "session_id", "at"),
        "status": judged.select("request", "idx", "status", "memory_id", "reason", F.when(F.col("status") == "stored", "pending").alias("embedding_status")),
    }


class Store:
    """The tables below a folder. Every run writes parts of its own number, so a repeated run replaces its own rows only.

    A run sees what runs of smaller numbers left. That makes it the target of
    ``foreachBatch``: a micro-batch that is repeated after a failure writes the
    same parts again.
    """

    def __init__(self, spark: SparkSession, path: str, limits: Limits = Limits(), birth_year: int | None = None):
        self.spark, self.path, self.limits, self.birth_year = spark, path.rstrip("/"), limits, birth_year

    def read(self, table: str, schema: str | None = None, before: int | None = None) -> DataFrame:
        """Rows of all runs, or of runs before a number; without any the empty table of ``schema``."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            if schema is None:
                raise FileNotFoundError(f"{self.path}/{table}")
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}")
        return rows if before is None else rows.where(F.col("run") < before)

    def take(self, messages: DataFrame, run: int) -> DataFrame:
        """Judge messages and write all tables; the status rows."""
        heads = self.read("heads", HEADS, run)
        judged = judge(messages, self.read("keys", KEYS, run), heads, self.limits)
        judged = scratch.save(judged, f"{self.path}/judged/run={run}")
        for name, rows in tables(judged, self.birth_year).items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/run={run}")
        return self.read("status").where(F.col("run") == run)

    def __call__(self, messages: DataFrame, run: int) -> None:
        self.take(messages, run)

    def companion_lines(self) -> DataFrame:
        """(source, value): a JSON line for every stored memory, to be written beside its source."""
        return self.read("companions").select("source", F.to_json(F.struct("memory_id", "source", "session_id", "at")).alias("value"))
