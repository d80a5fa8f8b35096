"""Small functions of single records: names, topics, dates, dimensions, facts and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components of a vector by the name of the model that made it.
DIMENSIONS = {
    "AllMiniLML6V2": 384,
    "all-MiniLM-L6-v2": 384,
    "BGESmallENV15": 384,
    "bge-small-en-v1.5": 384,
    "AllMiniLML12V2": 384,
    "all-MiniLM-L12-v2": 384,
    "BGEBaseENV15": 768,
    "bge-base-en-v1.5": 768,
    "BGELargeENV15": 1024,
    "bge-large-en-v1.5": 1024,
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "text-embedding-ada-002": 1536,
    "gemini-embedding-001": 768,
    "google/gemini-embedding-001": 768,
}
#: Benchmark category by question type.
CATEGORIES = {
    "single-session-user": "information_extraction",
    "single-session-assistant": "information_extraction",
    "single-session-preference": "information_extraction",
    "multi-session": "multi_session",
    "temporal-reasoning": "temporal_reasoning",
    "knowledge-update": "knowledge_update",
}
#: Date formats of benchmark sessions, in the order in which they are tried.
DATES = ["d MMMM, yyyy", "yyyy-M-d", "MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy"]

STRUCTURED = "array<struct<entity:string, attribute:string, value:string>>"


def dimension(model: Column) -> Column:
    """Components of a model's vectors; null for unknown models."""
    return F.try_element_at(F.create_map(*[F.lit(x) for item in DIMENSIONS.items() for x in item]), model)


def category(question_type: Column, question_id: Column) -> Column:
    """Benchmark category; ids that end in _abs test abstention."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for item in CATEGORIES.items() for x in item]), question_type)
    return F.when(F.coalesce(question_id.endswith("_abs"), F.lit(False)), "abstention").otherwise(F.coalesce(known, F.lit("unknown")))


def session_date(text: Column) -> Column:
    """Timestamp of the date a benchmark session names; a time of day before ' on ' is left out."""
    day = F.when(F.contains(text, F.lit(" on ")), F.substring_index(text, " on ", -1)).otherwise(text)
    return F.coalesce(*[F.try_to_timestamp(day, F.lit(f)) for f in DATES])


def actor_type(source: Column) -> Column:
    return F.when(F.contains(F.lower(source), F.lit("bot")), "bot").otherwise("user")


def project_of_slug(slug: Column) -> Column:
    """Last part of a path written with hyphens."""
    return F.element_at(F.split(F.ltrim(slug, F.lit("-")), "-"), -1)


def facts(value: Column) -> Column:
    """struct(flat, structured) of a JSON array of facts: objects if every one names an entity, else its strings."""
    objects = F.from_json(value, STRUCTURED)
    elements = F.from_json(value, "array<string>")
    strings = F.filter(elements, lambda x: x.isNotNull() & ~x.startswith("{") & ~x.startswith("["))
    told = F.coalesce(F.size(objects) > 0, F.lit(False)) & F.coalesce(F.forall(objects, lambda f: F.coalesce(f["entity"] != "", F.lit(False))), F.lit(False))
    none = F.array().cast("array<string>")
    return F.struct(F.when(told, none).otherwise(F.coalesce(strings, none)).alias("flat"), F.when(told, objects).otherwise(F.array().cast(STRUCTURED)).alias("structured"))


def string_tags(value: Column) -> Column:
    """The strings of a JSON array; anything else in it is dropped, and no array gives none."""
    quoted = F.regexp_extract_all(F.when(F.trim(value).startswith("["), value), F.lit(r'"((?:[^"\\]|\\.)*)"\s*(?=[,\]])'), F.lit(1))
    return F.coalesce(quoted, F.array().cast("array<string>"))


def decisions(answer: Column, expected: Column, kinds: list[str]) -> Column:
    """array<struct(place, action, type_hint, topic)> of a triage answer, one for each of ``expected`` rows.

    Lines are '<number> <action> <type> [topic]'; a row without a good line is
    kept as an observation, and of several lines for a row the last counts.
    """
    lines = F.filter(F.transform(F.split(answer, "\n"), F.trim), lambda x: x != "")
    parsed = F.transform(lines, lambda x: F.split(x, " ", 4))

    def one(place: Column) -> Column:
        own = F.filter(parsed, lambda p: p[0] == place.cast("string"))
        p = F.get(own, F.size(own) - 1)
        kind = F.get(p, 2)
        return F.struct(
            place.alias("place"),
            F.coalesce(F.when(F.lower(F.get(p, 1)) == "drop", "drop").when(F.lower(F.get(p, 1)) == "merge", "merge"), F.lit("keep")).alias("action"),
            F.coalesce(F.when(kind.isin(kinds), kind), F.lit("observation")).alias("type_hint"),
            F.nullif(F.trim(F.get(p, 3)), F.lit("")).alias("topic"),
        )

    return F.transform(F.sequence(F.lit(1), expected), one)


def merged_text(members: Column) -> Column:
    """Contents of array<struct(created_at, id, content)>, newest first, each with its place if there are several."""
    newest = F.reverse(F.array_sort(members))
    n = F.size(newest)
    parts = F.transform(newest, lambda m, i: F.when(n > 1, F.concat(F.lit("["), (i + 1).cast("string"), F.lit("/"), n.cast("string"), F.lit("] "), m["content"])).otherwise(m["content"]))
    return F.array_join(parts, "\n\n")
