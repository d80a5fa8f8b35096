"""Writing messages: reply chains, windows of repeats, idempotency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sentences
from ..functions import text as tx


def reply_chain(messages: DataFrame, group: str, order: str, key: Column, ok: str) -> DataFrame:
    """reply_to: the last message before that was stored."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("reply_to", F.last(F.when(F.col(ok), key), ignorenulls=True).over(w))


def idempotent(new: DataFrame, keys: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rows already stored under an unexpired key)."""
    live = keys.where(F.col("expires_at") > now).select("idempotency_key", "memory_id")
    return new.join(live, "idempotency_key", "left_anti"), new.join(live, "idempotency_key")


def validate(rows: DataFrame, content: int = 102400, tags: int = 32, tag: int = 256) -> DataFrame:
    """rejected: the first limit a row breaks."""
    t = F.coalesce("tags", F.array().cast("array<string>"))
    reason = F.when(F.octet_length("content") > content, "content too long").when(F.size(t) > tags, "too many tags").when(F.exists(t, lambda x: F.octet_length(x) > tag), "tag too long")
    return rows.withColumn("rejected", reason)


def normalise_facts(rows: DataFrame) -> DataFrame:
    """(id, entity, entity_type, attribute, value): flat facts belong to the first entity."""
    raw = rows.where(F.size("entities") > 0).select("id", F.col("entities")[0].alias("entity"), F.explode("facts").alias("raw"))
    attribute, value = tx.fact(F.col("raw"))
    return raw.select("id", "entity", tx.entity_type(F.col("entity")).alias("entity_type"), attribute.alias("attribute"), value.alias("value"))


def chunks(rows: DataFrame, size: int = 2048, overlap: int = 1, least: int = 0) -> DataFrame:
    """(id, place, total, start, end, header, chunk): whole sentences of at most ``size`` bytes, the last ``overlap`` carried over; none for a text that fits one chunk."""
    return sentences.chunk_rows(rows.select("id", "content"), size, overlap, least)
