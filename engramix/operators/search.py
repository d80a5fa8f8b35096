"""Search legs, fusion and ranking.

Every leg is a frame (id, rank, leg); legs are united and summed by id, so
fusion is one aggregation. Top-k is always an order with the id as tie-break and
a limit, which Spark runs as a per-task top-k.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import english
from ..functions import scoring as sc
from . import fulltext
from .near import neighbours  # noqa: F401

#: Candidates of a leg.
CANDIDATES = 40
#: Bits of the legs in a fused hit.
LEG_BITS = {"text": 1, "vector": 2, "symbolic": 4}
NOT_SHOWN = ["suspicious", "curation:flagged"]


def has_any(tags: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def has_all(tags: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), tags)) == 0, F.lit(False))


def live(memories: DataFrame) -> DataFrame:
    return memories.where(F.col("deleted_at").isNull())


def searchable(memories: DataFrame) -> DataFrame:
    """Live, not quarantined, not superseded."""
    return live(memories).where(~has_any(F.col("tags"), NOT_SHOWN)).where(~F.col("is_consolidated_original"))


def leaks(results: DataFrame, memories: DataFrame) -> DataFrame:
    """Results (id, ...) that are quarantined and should not have been returned."""
    hidden = memories.where(has_any(F.col("tags"), NOT_SHOWN)).select("id")
    return results.join(hidden, "id", "left_semi")


def tier_filter(memories: DataFrame, tiers: list[str] | str | None) -> DataFrame:
    """None hides raw; 'all' hides nothing; else the tiers listed."""
    if tiers == "all":
        return memories
    return memories.where(F.col("knowledge_tier") != "raw") if tiers is None else memories.where(F.col("knowledge_tier").isin(tiers))


def project_scope(memories: DataFrame, project: str | None) -> DataFrame:
    """The project's own and global rows."""
    return memories if project is None else memories.where((F.col("project") == project) | F.col("project").isNull())


def source_prefixes(memories: DataFrame, prefixes: list[str]) -> DataFrame:
    return memories.where(reduce(lambda a, b: a | b, [F.col("source").startswith(p) for p in prefixes]))


def ranked(hits: DataFrame, score: str, k: int, leg: str) -> DataFrame:
    """The k best by (score desc, id), with their places."""
    top = hits.orderBy(F.col(score).desc(), "id").limit(k)
    return top.select("id", F.row_number().over(Window.orderBy(F.col(score).desc(), "id")).cast("long").alias("rank"), F.lit(leg).alias("leg"), F.col(score).alias("score"))


def vector_hits(memories: DataFrame, embeddings: DataFrame, query: list[float] | Column, tier: str | None = None) -> DataFrame:
    """(id, score) of rows with a current vector: cosine within [0, 1], rounded so that ties are ties."""
    current = embeddings.where("is_current")
    if tier is not None:
        current = current.where(F.col("tier") == tier)
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    own = memories.select("id").join(current.select("memory_id", "embedding"), F.col("id") == F.col("memory_id"))
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), sc.cosine(F.col("embedding"), q)))
    return own.select("id", F.round(s, 6).alias("score"))


def text_hits(memories: DataFrame, query: str, index: fulltext.Index | Callable[[], fulltext.Index] | None = None) -> DataFrame:
    """(id, score): BM25 of rows that hold all query words, by their stems; a query of stop words finds nothing.

    With an index, or a function that opens one, only the postings of the query's
    stems are read, and rows of ``memories`` are kept; without one the postings are
    made from ``memories``. A query of stop words opens none.
    """
    stems = english.query_stems(memories.sparkSession, query)
    if not stems:
        return memories.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    if index is None:
        return fulltext.scored(fulltext.Index.of(memories), stems)
    return fulltext.scored(index() if callable(index) else index, stems).join(memories.select("id"), "id", "left_semi")


def symbolic_hits(memories: DataFrame, query: str) -> DataFrame:
    """(id, score): tags 3, entities 2, facts 2, type 1, source 1; the query is one token."""
    q, low = F.lit(query), query.lower()

    def within(c: str) -> Column:
        return F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lit(low)))

    score = (
        F.when(F.array_contains(F.coalesce(F.col("tags"), F.array().cast("array<string>")), q), 3).otherwise(0)
        + F.when(within("entities"), 2).otherwise(0)
        + F.when(within("facts"), 2).otherwise(0)
        + F.when(F.contains(F.lower("type_hint"), F.lit(low)), 1).otherwise(0)
        + F.when(F.contains(F.lower("source"), F.lit(low)), 1).otherwise(0)
    )
    return memories.select("id", score.cast("double").alias("score")).where("score > 0")


def fuse(legs: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Reciprocal rank fusion: (id, score, legs); ``legs`` maps a leg to its hits and its k."""
    parts = [hits.select("id", (1.0 / (F.lit(float(k)) + F.col("rank"))).alias("s"), F.lit(LEG_BITS.get(name, 0)).alias("bit")) for name, (hits, k) in legs.items()]
    fused = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.round(F.sum("s"), 9).alias("score"), F.bit_or("bit").alias("bits"))
    name = F.concat_ws("+", *[F.when(F.col("bits").bitwiseAND(bit) > 0, leg) for leg, bit in LEG_BITS.items()])
    return fused.select("id", "score", name.alias("legs"))


def fuse_lists(lists: list[DataFrame], k: float = 60.0) -> DataFrame:
    """Fusion of any number of rank lists with one k."""
    return fuse({f"list{i}": (x, k) for i, x in enumerate(lists)}).select("id", "score")


def best_places(legs: list[DataFrame]) -> DataFrame:
    """(id, rank): the best place of each row in any of the lists."""
    return reduce(DataFrame.unionByName, [x.select("id", "rank") for x in legs]).groupBy("id").agg(F.min("rank").alias("rank"))


def hybrid(memories: DataFrame, embeddings: DataFrame, query: str, vector: list[float] | Column | dict[str, list[float]] | None, symbol: str | None = None, limit: int = 20, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), base_k: float = 60.0, candidates: int = CANDIDATES, index: fulltext.Index | Callable[[], fulltext.Index] | None = None) -> DataFrame:
    """Three legs, fused; a leg of weight 0 is left out of the plan. ``vector`` may map embedding tiers to vectors: then a row's place is its best of any tier."""
    rows = searchable(memories)
    legs = {}
    for leg, weight in zip(("text", "vector", "symbolic"), weights, strict=True):
        k = sc.leg_k(base_k, weight)
        if k is None or (leg == "vector" and vector is None):
            continue
        if leg == "vector" and isinstance(vector, dict):
            legs[leg] = (best_places([ranked(vector_hits(rows, embeddings, v, tier), "score", candidates, tier) for tier, v in vector.items()]), k)
            continue
        hits = text_hits(rows, query, index) if leg == "text" else vector_hits(rows, embeddings, vector) if leg == "vector" else symbolic_hits(rows, symbol or query)
        legs[leg] = (ranked(hits, "score", candidates, leg), k)
    return fuse(legs).orderBy(F.col("score").desc(), "id").limit(limit)


def with_salience(hits: DataFrame, memories: DataFrame, salience: DataFrame, now: Column) -> DataFrame:
    """Salience of fused hits: (id, rrf, salience, composite, trust)."""
    rows = hits.join(memories.select("id", "updated_at", "access_count", "trust_level", "knowledge_tier"), "id").join(salience, F.col("id") == F.col("memory_id"), "left")
    last = F.when(F.col("last_reinforced_at").isNull(), sc.NEVER_REINFORCED_DAYS).otherwise(sc.days_between(now, F.col("last_reinforced_at")))
    rows = rows.withColumn("salience", sc.salience(sc.days_between(now, F.col("updated_at")), F.col("access_count"), F.col("score"), F.coalesce("stability", F.lit(1.0)), last))
    return rows.select("id", F.col("score").alias("rrf"), F.round("salience", 6).alias("salience"), F.round(sc.composite(F.col("score"), F.col("salience"), F.col("trust_level"), F.col("knowledge_tier")), 6).alias("composite"), F.col("trust_level").alias("trust"))


def after(rows: DataFrame, score: str, cursor: tuple[float, str], limit: int) -> DataFrame:
    """The page that follows (score, id) in (score desc, id) order."""
    s, i = cursor
    return rows.where((F.col(score) < s) | ((F.col(score) == s) & (F.col("id") > i))).orderBy(F.col(score).desc(), "id").limit(limit)


def encode_cursor(score: Column, key: Column, kind: str = "s") -> Column:
    """Keyset cursor: URL-safe base64, without padding, of JSON with its kind (s: search, l: list)."""
    plain = F.to_json(F.struct(F.lit(kind).alias("t"), score.alias("s"), key.alias("i")))
    return F.rtrim(F.translate(F.base64(F.encode(plain, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def _opened(cursor: Column) -> Column:
    padded = F.rpad(F.translate(cursor, "-_", "+/"), F.length(cursor) + (4 - F.length(cursor) % 4) % 4, F.lit("="))
    return F.from_json(F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")), "t string, s double, i string")


def cursor_error(cursor: Column) -> Column:
    """Why a text is no search cursor, or null if it is one."""
    c = _opened(cursor)
    kind = F.coalesce(c["t"], F.lit(""))
    return F.when(cursor.isNull() | c.isNull() | (c["t"].isNull() & c["s"].isNull() & c["i"].isNull()), "invalid cursor").when(kind != "s", F.concat(F.lit("invalid cursor type '"), kind, F.lit("': expected search cursor (t=s)"))).when(c["s"].isNull() | c["i"].isNull(), "incomplete cursor")


def decode_cursor(cursor: Column) -> Column:
    """struct(t, s, i) of a search cursor; null for anything else, list cursors too."""
    return F.when(cursor_error(cursor).isNull(), _opened(cursor))
