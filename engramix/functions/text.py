"""Text functions as column expressions; regular expressions stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Injection signals by name, and their patterns.
INJECTION = [
    ("override_instruction", r"(?i)\bignore\s+(all\s+)?previous\b"),
    ("override_instruction", r"(?i)\boverride\s+(your\s+)?instructions?\b"),
    ("override_instruction", r"(?i)\bdisregard\b"),
    ("imperative_directive", r"(?i)\byou\s+must\b"),
    ("role_override", r"(?i)\byou\s+are\s+now\b"),
    ("system_prompt_injection", r"(?i)\bsystem\s*:\s*"),
    ("memory_wipe", r"(?i)\bforget\s+(everything|all)\b"),
    ("behavioral_override", r"(?i)\b(always|never)\s+(do|say|respond|answer)\b"),
    ("persona_injection", r"(?i)\bact\s+as\s+(if|though)?\s*\b"),
    ("instruction_injection", r"(?i)\bnew\s+instructions?\s*:"),
]
#: Of each pattern, words of which every match holds one; looking for a word first costs a small part of the pattern.
NEEDED = [["ignore"], ["override"], ["disregard"], ["must"], ["now"], ["system"], ["forget"], ["always", "never"], ["act"], ["instruction"]]
#: Phrases that an import marks, looked for in lower case.
IMPORT_INJECTION = ["ignore previous instructions", "ignore all previous", "disregard previous", "system:", "you are now", "new instructions:", "forget everything", "override your", "act as if", "[system]"]
#: Phrases that make a message worth storing.
TRIGGERS = ["always", "never", "prefer", "use ", "remember", "convention", "rule", "decision", "chose", "choose", "default to", "make sure", "important:", "note:", "todo:", "don't", "do not", "must", "should", "architecture", "pattern", "standard", "we use", "we don't", "configured", "setup", "workflow"]
#: Month and weekday names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
#: Answers that decline.
ABSTENTIONS = ["i don't know", "not mentioned", "no information", "cannot answer", "unknown"]


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def injection_signals(text: Column) -> Column:
    """Distinct names of the signals that match, in table order."""
    # ASCII letters alone are matched in either case, and lower() makes those small wherever they stand
    low = F.lower(text)
    found = []
    for (name, pattern), words in zip(INJECTION, NEEDED, strict=True):
        held = F.contains(low, F.lit(words[0]))
        for word in words[1:]:
            held = held | F.contains(low, F.lit(word))
        found.append(F.when(held & text.rlike(pattern), F.lit(name)))
    # no lambda, so the texts are read by generated code; takes out nulls and repeats
    return F.array_except(F.array(*found), F.array(F.lit(None).cast("string")))


def import_injection(text: Column) -> Column:
    """Whether an import marks a text."""
    low, hit = F.lower(text), F.lit(False)
    for p in IMPORT_INJECTION:
        hit = hit | F.contains(low, F.lit(p))
    return F.coalesce(hit, F.lit(False))


def is_suspicious(text: Column, trust: Column) -> Column:
    """The more trusted, the more signals it takes."""
    need = F.when(trust >= 0.7, 3).when(trust >= 0.3, 2).otherwise(1)
    return F.size(injection_signals(text)) >= need


def worth_storing(text: Column) -> Column:
    low = F.lower(text)
    hit = F.lit(False)
    for t in TRIGGERS:
        hit = hit | F.contains(low, F.lit(t))
    return hit | ((F.octet_length(text) > 100) & (F.contains(low, F.lit(".")) | F.contains(low, F.lit(":"))))


def is_noise(text: Column, patterns: list[str], least: int = 50) -> Column:
    low = F.lower(F.trim(text))
    hit = F.octet_length(F.trim(text)) < least
    for p in patterns:
        hit = hit | F.contains(low, F.lit(p.lower()))
    return hit


def normalise(text: Column) -> Column:
    """Lower case, without markdown marks, white space collapsed."""
    s = F.lower(F.trim(text))
    for pattern, to in ((r"(?m)^[#\s]+", ""), (r"[*_]", ""), (r"(?m)^[>\s]+", ""), ("`", ""), (r"(?m)^(?:[-+] )+", ""), (r"\s+", " ")):
        s = F.regexp_replace(s, pattern, to)
    return F.trim(s)


def content_hash(text: Column) -> Column:
    return F.sha2(normalise(text), 256)


def _length_prefix(text: Column) -> Column:
    """The byte length of a text as four bytes, the lowest first."""
    digits = F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")
    return F.concat(*[F.unhex(F.substring(digits, i, 2)) for i in (7, 5, 3, 1)])


def idempotency_key(*fields: Column) -> Column:
    """SHA-256 over fields, each led by its length in bytes (32 bits, little-endian); null counts as empty."""
    texts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.sha2(F.concat(*[part for t in texts for part in (_length_prefix(t), F.encode(t, "UTF-8"))]), 256)


def message_key(source: Column, session: Column, at: Column, role: Column, content: Column) -> Column:
    """Key of a message: source, session, role, content and the time in UTC with microseconds."""
    utc = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return idempotency_key(source, session, role, content, utc)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def at_depth(depth: int, content: Column, abstract: Column, overview: Column) -> Column:
    return F.coalesce(abstract if depth == 0 else overview if depth == 1 else content, content)


def embedding_text(content: Column, abstract: Column, tags: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(abstract, content), F.array_join(tags, " "))


def fact(raw: Column) -> tuple[Column, Column]:
    """(attribute, value) of 'attribute: value'; without a colon a note."""
    at = F.instr(raw, ":")
    head = F.trim(F.substring_index(raw, ":", 1))
    return F.when((at > 0) & (head != ""), head).otherwise("note"), F.when((at > 0) & (head != ""), F.trim(raw.substr(at + 1, F.length(raw)))).otherwise(F.trim(raw))


def entity_type(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{Lu}"), "person").otherwise("concept")


def agent_from_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"/agents/([^/]+)/", 1), F.lit(""))


def agent_name(path: Column, source: Column, stem: Column) -> Column:
    """Agent of a chunk: of sessions the second part of the path unless it is a date, else the stem of the file."""
    part = F.get(F.split(path, "/"), F.lit(1))
    dated = part.contains("-") & (F.octet_length(part) == 10)
    return F.when((source == "sessions") & part.isNotNull() & ~dated, part).otherwise(stem)


def title_tag(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), F.lit("-"))


def runs(offsets: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows that hold ``most`` units and ``rows`` rows at most, one row at least; offsets: where rows begin and the last ends."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, min(a + rows, int(np.searchsorted(offsets, int(offsets[a]) + most, "right")) - 1))
        yield a, b
        a = b


def entropy(text: Column) -> Column:
    """Shannon entropy of the bytes, in bits; 0 for an empty text. Bytes are counted in the Arrow buffers as they are, a quarter of a megabyte at a time."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out = np.zeros(len(texts))
        for a, b in runs(off, 1 << 18, 512):
            size = np.diff(off[a : b + 1])
            n = np.bincount(np.repeat(np.arange(b - a, dtype=np.int32) << 8, size) + data[off[a] : off[b]], minlength=(b - a) << 8).reshape(b - a, 256)
            p = n / np.maximum(size, 1)[:, None]
            out[a:b] = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
        return pa.array(out + 0.0)

    return F.when(text.isNotNull(), run(text))


def _f1(p: pa.Array, q: pa.Array) -> pa.Array:
    """F1 of rows of two columns of lists without nulls, some hundred thousand elements at a time."""
    sizes = np.diff(p.offsets.to_numpy()), np.diff(q.offsets.to_numpy())
    out = np.zeros(len(p))
    for a, b in runs(np.concatenate([[0], np.cumsum(sizes[0] + sizes[1], dtype=np.int64)]), 1 << 18, 1 << 12):
        lists = [x.slice(a, b - a).flatten() for x in (p, q)]
        codes = pa.concat_arrays(lists).dictionary_encode().indices.to_numpy().astype(np.int64)
        width = int(codes.max(initial=0)) + 1
        own = [np.unique(np.repeat(np.arange(b - a), n[a:b]) * width + c, return_counts=True) for n, c in zip(sizes, np.split(codes, [len(lists[0])]), strict=True)]
        both, i, j = np.intersect1d(own[0][0], own[1][0], assume_unique=True, return_indices=True)
        c = np.bincount(both // width, np.minimum(own[0][1][i], own[1][1][j]), b - a)
        x, y = c / np.maximum(sizes[0][a:b], 1), c / np.maximum(sizes[1][a:b], 1)
        f1 = np.divide(2 * x * y, x + y, out=np.zeros(b - a), where=c > 0)
        out[a:b] = np.where(sizes[0][a:b] + sizes[1][a:b] == 0, 1.0, f1)
    return pa.array(out)


def token_f1(rows: DataFrame, *keep: str) -> DataFrame:
    """rows (prediction, truth and the key columns ``keep``) to (keep, f1): F1 of the tokens as multisets; both empty is 1.

    A row's tokens are sorted and counted beside each other where the row is, so
    neither the number of rows of a task nor a long text makes a large table.
    """
    lists = [F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in ("prediction", "truth")]
    return rows.select(*keep, F.arrow_udf(_f1, "double")(*lists).alias("f1"))


def abstains(text: Column) -> Column:
    hit = F.lit(False)
    for p in ABSTENTIONS:
        hit = hit | F.contains(F.lower(text), F.lit(p))
    return hit


def event_time(text: Column, now: Column, birth_year: int | None = None) -> Column:
    """struct(time, precision) of the most specific time a text names, or null."""
    months, days = "|".join(MONTHS), "|".join(WEEKDAYS)

    def hit(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))

    def place(name: Column, names: list[str]) -> Column:
        return F.array_position(F.array(*[F.lit(n) for n in names]), F.lower(name)).cast("int")

    def first_of(year: Column, month: Column) -> Column:
        return F.make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0))

    month_year = rf"(?i)\bin\s+({months})\s+(\d{{4}})\b"
    year = hit(r"\bin\s+(\d{4})\b").cast("int")
    decade = hit(r"(?i)\bin\s+the\s+(\d{2})s\b").cast("int")
    last_month = place(hit(rf"(?i)\blast\s+({months})\b"), MONTHS)
    last_day = place(hit(rf"(?i)\blast\s+({days})\b"), WEEKDAYS)
    this_year, this_month, today = F.year(now), F.month(now), F.weekday(now) + 1
    back = F.when(today > last_day, today - last_day).when(today == last_day, 7).otherwise(7 - (last_day - today))

    def found(time: Column, precision: str) -> Column:
        return F.struct(time.alias("time"), F.lit(precision).alias("precision"))

    y4 = hit(month_year, 2).cast("int")
    out = F.when(y4.isNotNull() & (y4 > 0), found(first_of(y4, place(hit(month_year), MONTHS)), "month"))
    out = out.when(year.between(1900, 2100), found(first_of(year, F.lit(1)), "year"))
    out = out.when(decade.isNotNull(), found(first_of(F.when(2000 + decade <= this_year, 2000 + decade).otherwise(1900 + decade), F.lit(1)), "decade"))
    if birth_year is not None:
        age = hit(r"(?i)\bwhen\s+I\s+was\s+(\d{1,3})\b").cast("int")
        out = out.when(age.isNotNull(), found(first_of(F.lit(birth_year) + age, F.lit(1)), "year"))
    out = out.when(last_month.isNotNull() & (last_month > 0), found(first_of(F.when(last_month < this_month, this_year).otherwise(this_year - 1), last_month), "month"))
    return out.when(last_day.isNotNull() & (last_day > 0), found(F.date_sub(now.cast("date"), back).cast("timestamp"), "day"))
