"""Readers of memory records and conversation logs.

All parsing is declarative (``from_json`` over text lines, whole-file text
splits), so files are read in parallel and malformed lines become nulls in
place of failures. Archives and SQLite files, which no Spark reader opens, go
through ``binaryFile`` and one Arrow function per file.
"""

from __future__ import annotations

import io
import json
import posixpath
import sqlite3
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

#: Limits on archives: bytes of one entry, entries of one archive.
MAX_ENTRY, MAX_ENTRIES = 50 * 1024 * 1024, 10_000

MEMORY_LINE = "record_type string, content string, type_hint string, source string, tags array<string>, created_at timestamp, actor string, project string, embedding array<double>, embedding_model string, name string, entity_type string, aliases array<string>, subject string, subject_type string, object string, object_type string, predicate string, entity string, attribute string, value string, _corrupt string"


def jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """One record a line; broken lines are kept in ``_corrupt``."""
    return spark.read.schema(MEMORY_LINE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").json(path)


def jsonl_memories(spark: SparkSession, path: str) -> DataFrame:
    """Memory lines of a JSONL import; graph and broken lines left out."""
    rows = jsonl_lines(spark, path)
    return rows.where(F.col("record_type").isNull() & F.col("content").isNotNull()).select("content", F.coalesce("type_hint", F.lit("fact")).alias("type_hint"), "source", "tags", "created_at", "actor", "project", "embedding", "embedding_model")


def jsonl_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Entities, relationships and facts of an import; references resolved by (name, type)."""
    rows = jsonl_lines(spark, path)
    key = F.sha2(F.concat_ws("\x1f", F.lower("name"), "entity_type"), 256)
    refs = rows.where("record_type = 'entity'").select("name", "entity_type", "aliases").unionByName(
        rows.where("record_type = 'relationship'").select(F.explode(F.array(F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("entity_type")), F.struct(F.col("object").alias("name"), F.col("object_type").alias("entity_type")))).alias("r")).select("r.name", "r.entity_type", F.array().cast("array<string>").alias("aliases"))
    )
    entities = refs.where("name is not null").groupBy("name", "entity_type").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>"))))).alias("aliases")).withColumn("id", key)
    ids = entities.select("id", "name", "entity_type")
    s, o = ids.toDF("subject_id", "subject", "subject_type"), ids.toDF("object_id", "object", "object_type")
    edges = rows.where("record_type = 'relationship'").select("subject", "subject_type", "object", "object_type", "predicate").join(s, ["subject", "subject_type"]).join(o, ["object", "object_type"]).select("subject_id", "object_id", "predicate")
    facts = rows.where("record_type = 'fact'").select("entity", "entity_type", "attribute", "value").join(ids.toDF("entity_id", "entity", "entity_type"), ["entity", "entity_type"]).select("entity_id", "attribute", "value")
    return {"entities": entities, "relationships": edges, "facts": facts}


def ingest_messages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files that hold a JSON array or JSON lines, told by their first character; broken ones are in ``_corrupt``."""
    kind = f"{schema}, _corrupt string"
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_at"), F.ltrim("value").alias("_line")).where("_line != ''")
    # the first line of each file, found in each task before files are dealt
    arrays = lines.groupBy("_path").agg(F.min_by(F.substring("_line", 1, 1), "_at").alias("_first")).where("_first = '['").select("_path")

    def read(whole: bool) -> DataFrame:
        reader = spark.read.schema(kind).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").option("multiLine", whole)
        rows = reader.json(path)
        return rows.select("*", F.col("_metadata.file_path").alias("_path"))

    return read(True).join(arrays, "_path", "left_semi").unionByName(read(False).join(arrays, "_path", "left_anti")).drop("_path")


def markdown_sections(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, heading, content): sections that start at '# ' or '## '."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = files.select("path", F.posexplode(F.split("value", r"(?m)^(?=#{1,2} )")).alias("place", "content")).where(F.col("content").rlike(r"\S"))
    return parts.select("path", "place", F.nullif(F.regexp_extract("content", r"^#{1,2} +(.*)", 1), F.lit("")).alias("heading"), F.regexp_replace("content", r"^\s+|\s+$", "").alias("content"))


def section_chunks(sections: DataFrame, source: str) -> DataFrame:
    """Sections (path, place, heading, content) as chunks to import, tagged by their source and heading."""
    tags = F.array_compact(F.array(F.lit("imported"), F.lit(f"imported:{source}"), F.concat(F.lit("section:"), F.col("heading"))))
    return sections.select("path", "place", "content", F.lit(source).alias("source"), tags.alias("tags"))


def text_of(json_column: Column) -> Column:
    """Text of a message body: a string, or the text blocks of an array joined by line breaks."""
    blocks = F.from_json(json_column, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    plain = F.when(~F.ltrim(json_column).startswith("["), json_column)
    return F.coalesce(plain, F.nullif(joined, F.lit("")))


def log_entries(lines: DataFrame) -> DataFrame:
    """(path, role, content, at, session_id, project, parser) of log lines (path, value); three forms are tried in order."""
    v = F.col("value")
    get = lambda p: F.get_json_object(v, p)
    path_agent = F.nullif(F.regexp_extract("path", r"/agents/([^/]+)/", 1), F.lit(""))
    nested = get("$.message.role").isin("user", "assistant")
    kind = F.when(nested & (get("$.type") == "message"), "agent").when(nested, "assistant").when(F.coalesce(get("$.content"), get("$.text"), get("$.display")).isNotNull(), "generic")
    stamp = get("$.timestamp")
    at = F.coalesce(F.try_to_timestamp(stamp), F.timestamp_millis(F.when(stamp.rlike(r"^\d{10,}$"), stamp).try_cast("long")))
    content = F.when(kind.isin("agent", "assistant"), text_of(get("$.message.content"))).otherwise(F.coalesce(get("$.content"), get("$.text"), get("$.display")))
    rows = lines.select("path", F.coalesce(get("$.message.role"), get("$.role")).alias("role"), content.alias("content"), at.alias("at"), F.coalesce(get("$.sessionId"), get("$.session_id")).alias("session_id"), F.coalesce(get("$.project"), get("$.cwd")).alias("project"), kind.alias("parser"), path_agent.alias("agent"))
    return rows.where(F.col("parser").isNotNull() & F.col("content").isNotNull() & (F.trim("content") != ""))


def history_chunks(entries: DataFrame, source: str, assistant_only: bool = True) -> DataFrame:
    """Log entries of the nested form as chunks to import: what the assistant said, as observations; or both sides."""
    kept = entries.where((F.col("parser") == "assistant") & ((F.col("role") == "assistant") | F.lit(not assistant_only)))
    return kept.select("path", "content", F.lit(source).alias("source"), F.lit("observation").alias("type_hint"), "at", "session_id", "project")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.trim("value") != "")


def safe_entry(name: str) -> bool:
    """An archive entry that stays within its folder."""
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in posixpath.normpath(name.replace("\\", "/")).split("/")


def conversations_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, conversation, rejected): conversation objects of export archives or plain JSON files.

    Entries that are too large, too many or not safe to open are rows without a
    conversation and with the reason in ``rejected``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            out = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                texts = []
                if data[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        entries = z.infolist()
                        if len(entries) > MAX_ENTRIES:
                            out.append((name, None, f"{len(entries) - MAX_ENTRIES} entries beyond the {MAX_ENTRIES}th"))
                        for e in entries[:MAX_ENTRIES]:
                            if not e.filename.endswith("conversations.json"):
                                continue
                            if not safe_entry(e.filename):
                                out.append((name, None, f"unsafe entry {e.filename}"))
                            elif e.file_size > MAX_ENTRY:
                                out.append((name, None, f"entry {e.filename} of {e.file_size} bytes"))
                            else:
                                texts.append(z.read(e))
                else:
                    texts.append(data)
                for t in texts:
                    out += [(name, json.dumps(c), None) for c in json.loads(t)]
            yield pd.DataFrame(out, columns=["path", "conversation", "rejected"])

    return files.mapInPandas(run, "path string, conversation string, rejected string")


def _tree_order(mapping: dict | None) -> list[tuple[str, str]]:
    """(role, text) of a conversation's tree, depth first, first child first; a node that is met again is left out."""
    mapping = mapping or {}
    stack = [k for k, n in mapping.items() if not n or n.get("parent") not in mapping][::-1]
    seen, out = set(), []
    while stack:
        key = stack.pop()
        node = mapping.get(key)
        if key in seen or not node:
            continue
        seen.add(key)
        stack += [c for c in (node.get("children") or [])[::-1]]
        message = node.get("message") or {}
        role = (message.get("author") or {}).get("role")
        parts = (message.get("content") or {}).get("parts") or []
        text = "\n".join(p for p in parts if isinstance(p, str) and p)
        if role in ("user", "assistant") and text.strip():
            out.append((role, text))
    return out


def tree_messages(conversations: DataFrame) -> DataFrame:
    """(conversation_id, title, place, role, content): messages of tree exports, depth first, first child first.

    A conversation is one row and is put in order within it: no joins, and a
    cycle ends where it closes.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf["conversation"]:
                c = json.loads(text) if text else None
                if isinstance(c, dict):
                    out += [(c.get("id") or c.get("conversation_id"), c.get("title"), i, role, said) for i, (role, said) in enumerate(_tree_order(c.get("mapping")))]
            yield pd.DataFrame(out, columns=["conversation_id", "title", "place", "role", "content"])

    return conversations.select("conversation").mapInPandas(run, "conversation_id string, title string, place int, role string, content string")


def flat_messages(conversations: DataFrame) -> DataFrame:
    """(conversation_id, title, place, role, content): messages of list exports; empty ones dropped."""
    c = conversations.select(F.from_json("conversation", "uuid string, name string, chat_messages array<struct<sender:string,text:string>>").alias("c")).select("c.*")
    rows = c.select(F.col("uuid").alias("conversation_id"), F.col("name").alias("title"), F.posexplode("chat_messages").alias("place", "m"))
    return rows.select("conversation_id", "title", "place", F.col("m.sender").alias("role"), F.col("m.text").alias("content")).where(F.trim("content") != "")


def sqlite_chunks(spark: SparkSession, path: str, agent_like: str | None = None, model: str | None = None, dimension: int | None = None) -> DataFrame:
    """Rows of ``chunks`` tables in SQLite files; a vector is reused if model and length match."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(data))  # opened in memory: no file on the executor
                where = " WHERE source LIKE ?" if agent_like else ""
                got = pd.read_sql_query(f"SELECT id, text, source, path, embedding, model, updated_at FROM chunks{where}", con, params=[agent_like] if agent_like else None)
                con.close()
                yield got.assign(file=name)[["file", "id", "text", "source", "path", "embedding", "model", "updated_at"]].astype({"id": str})

    rows = files.mapInPandas(run, "file string, id string, text string, source string, path string, embedding string, model string, updated_at long")
    v = F.from_json("embedding", "array<double>")
    fits = F.lit(True)
    if model is not None:
        fits = fits & (F.lower("model") == model.lower())
    if dimension is not None:
        fits = fits & (F.size(v) == dimension)
    stem = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    return rows.withColumn("vector", F.when(fits, v)).withColumn("updated_at", F.timestamp_millis("updated_at")).withColumn("agent", tx.agent_name(F.col("path"), F.col("source"), stem)).drop("embedding")
