"""Time hints in queries, time boosts and list cursors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases, days back to the start and days back to the end (None: open).
RECENT = [
    ("last week|past week", 7, None),
    ("last month|past month", 30, None),
    ("last year|past year", 365, None),
    ("a few days ago", 5, 1),
    ("a few weeks ago", 28, 7),
    ("a few months ago", 90, 30),
]
#: Unit, days in it and days around the point meant.
UNITS = {"day": (1, 1), "week": (7, 4), "month": (30, 15), "year": (365, 60)}
#: Number words.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
_DATE = r"(\d{4}-\d{2}-\d{2})"


def _days(n) -> Column:
    return F.make_dt_interval(F.lit(n) if isinstance(n, int) else n)


def number(word: Column) -> Column:
    """Digits or a number word; null for anything else."""
    table = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    return F.coalesce(word.try_cast("int"), F.try_element_at(table, word))


def time_range(text: Column, now: Column) -> Column:
    """struct<after, before> of the first time hint of a query; null without one. Either end may be open."""
    q, day, none = F.lower(text), F.date_trunc("day", now), F.lit(None).cast("timestamp")

    def span(after, before) -> Column:
        return F.struct(after.alias("after"), before.alias("before"))

    out = F.when(q.contains("yesterday"), span(day - _days(1), day - F.expr("INTERVAL 1 SECOND"))).when(q.contains("today"), span(day, none))
    for phrase, start, end in RECENT:
        out = out.when(q.rlike(phrase), span(now - _days(start), none if end is None else now - _days(end)))
    ago = r"(\w+)\s+(day|week|month|year)s?\s+ago"
    n, unit = number(F.regexp_extract(q, ago, 1)), F.regexp_extract(q, ago, 2)
    for name, (length, around) in UNITS.items():
        out = out.when(n.isNotNull() & (unit == name), span(now - _days(n * length + around), now - _days(n * length - around)))

    def date(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(q, pattern, group), F.lit("")).try_cast("timestamp")

    since, until = rf"after\s+{_DATE}", rf"before\s+{_DATE}"
    between = rf"between\s+{_DATE}\s+and\s+{_DATE}"
    out = out.when(date(since).isNotNull(), span(date(since), none)).when(date(until).isNotNull(), span(none, date(until)))
    return out.when(date(between).isNotNull() & date(between, 2).isNotNull(), span(date(between), date(between, 2)))


def in_range(at: Column, span: Column) -> Column:
    """Whether a time lies in a range; open ends hold everything, no range holds nothing."""
    return span.isNotNull() & F.coalesce(at >= span["after"], F.lit(True)) & F.coalesce(at <= span["before"], F.lit(True)) & at.isNotNull()


def time_boost(score: Column, at: Column, span: Column, factor: float = 2.0) -> Column:
    """Scores of rows within the range hinted at count ``factor`` times."""
    return F.when(in_range(at, span), score * factor).otherwise(score)


def since(duration: str, now: Column) -> Column:
    """The time ``30m``, ``1h`` or ``1d`` before now."""
    unit = {"m": "MINUTES", "h": "HOURS", "d": "DAYS"}.get(duration[-1:])
    if unit is None or not duration[:-1].isdigit():
        raise ValueError(f"not a duration: {duration!r}")
    return now - F.expr(f"INTERVAL {int(duration[:-1])} {unit}")


def encode_list_cursor(at: Column, key: Column) -> Column:
    """URL-safe base64, without padding, of ``time|key``."""
    plain = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("|"), key)
    return F.rtrim(F.translate(F.base64(F.encode(plain, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def decode_list_cursor(cursor: Column) -> Column:
    """struct<at, key>; both null if the cursor is not one."""
    padded = F.rpad(F.translate(cursor, "-_", "+/"), F.length(cursor) + (4 - F.length(cursor) % 4) % 4, F.lit("="))
    plain = F.decode(F.unbase64(padded), "UTF-8")
    at = F.substring_index(plain, "|", 1).try_cast("timestamp")
    return F.struct(at.alias("at"), F.when(at.isNotNull(), F.regexp_extract(plain, r"^[^|]*\|(.*)$", 1)).alias("key"))
