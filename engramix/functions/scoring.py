"""Ranking arithmetic as column expressions. All of it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Weights of recency, access, semantic relevance and reinforcement.
RECENCY, ACCESS, SEMANTIC, REINFORCEMENT = 0.25, 0.15, 0.45, 0.15
NEVER_REINFORCED_DAYS = 365.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero or lengths differ."""
    n = norm(a) * norm(b)
    return F.when((n == 0) | (F.size(a) != F.size(b)), 0.0).otherwise(dot(a, b) / n)


def days_between(later: Column, earlier: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(later) - F.unix_micros(earlier)) / 86400e6)


def recency(days: Column, decay: float = 0.01) -> Column:
    return F.exp(-decay * days)


def access_score(count: Column) -> Column:
    return F.log1p(count.cast("double"))


def retrievability(stability: Column, days: Column) -> Column:
    """Power forgetting curve, within [0, 1]; 0 where stability is not positive."""
    r = F.pow(1 + (19.0 / 81.0) * days / stability, F.lit(-0.5))
    return F.when(stability <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), r)))


def min_max(value: Column, over) -> Column:
    """(v - min) / (max - min) over a window; 1 where all are equal."""
    lo, hi = F.min(value).over(over), F.max(value).over(over)
    return F.when(hi - lo < 1e-12, 1.0).otherwise((value - lo) / (hi - lo))


def salience(days_updated: Column, accesses: Column, semantic: Column, stability: Column, days_reinforced: Column) -> Column:
    """Weighted sum of the four dimensions, each normalised over the result set."""
    page = Window.partitionBy()
    parts = (
        (RECENCY, recency(days_updated)),
        (ACCESS, access_score(accesses)),
        (SEMANTIC, semantic),
        (REINFORCEMENT, retrievability(stability, days_reinforced)),
    )
    total = F.lit(0.0)
    for weight, value in parts:
        total = total + weight * min_max(value, page)
    return total


#: Score of a knowledge tier.
TIER_SCORES = {"raw": 0.0, "imported": 0.25, "explicit": 0.5, "derived": 0.75, "pattern": 1.0}
#: Initial stability by type.
INITIAL_STABILITY = {"decision": 5.0, "preference": 5.0, "instruction": 3.5, "fact": 2.5, "summary": 2.0, "observation": 1.0}
#: Embedding dimensions by model.
MODEL_DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "all-MiniLM-L6-v2": 384, "bge-small-en-v1.5": 384, "bge-base-en-v1.5": 768}


def lookup(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def tier_score(tier: Column) -> Column:
    return lookup(tier, TIER_SCORES, 0.5)


def initial_stability(type_hint: Column) -> Column:
    return lookup(type_hint, INITIAL_STABILITY, 2.5)


def composite(rrf: Column, sal: Column, trust: Column, tier: Column) -> Column:
    """Shown beside the salience order; a single hit has 1."""
    page = Window.partitionBy()
    score = 0.4 * min_max(rrf, page) + 0.4 * min_max(sal, page) * trust + 0.2 * tier_score(tier)
    return F.when(F.count(F.lit(1)).over(page) == 1, 1.0).otherwise(score)


def infer_trust(source: Column, actor_type: Column) -> Column:
    return F.when(source.isin("user", "cli") | (actor_type == "user"), 0.8).when(source.startswith("auto-store") | (actor_type == "auto-store"), 0.3).when(source.startswith("import"), 0.4).otherwise(0.5)


def infer_tier(write_path: Column) -> Column:
    return F.when(write_path.isin("auto_store", "session_summary", "ingest"), "raw").when(write_path == "import", "imported").otherwise("explicit")


def tag_matches(wanted: Column, tag: Column) -> Column:
    """A wanted tag that ends in ':' matches as a prefix."""
    return F.when(wanted.endswith(":"), tag.startswith(wanted)).otherwise(tag == wanted)


def _any_matches(tags: Column, wanted: str) -> Column:
    return F.exists(tags, lambda t: tag_matches(F.lit(wanted), t))


def tag_boost(wanted: list[str], tags: Column, weight: float, cap: float) -> Column:
    """weight for every wanted tag that any tag matches, up to cap."""
    own = F.coalesce(tags, F.array().cast("array<string>"))
    hits = F.lit(0)
    for w in wanted:
        hits = hits + _any_matches(own, w).cast("int")
    return F.least(F.lit(cap), weight * hits)


def reinforced(stability: Column, days: Column, rating: Column) -> Column:
    """Stability after a review: the more forgotten, the larger the gain."""
    m = F.when(rating == "easy", 2.0).otherwise(1.5)
    return F.least(F.lit(36500.0), F.greatest(F.lit(0.1), stability * (1 + (1 - retrievability(stability, days)) * m)))


def recall_bump(stability: Column, factor: float = 1.15, ceiling: float = 100.0) -> Column:
    return F.least(stability * factor, F.lit(ceiling))


def feedback(stability: Column, difficulty: Column, signal: Column) -> tuple[Column, Column]:
    """Stability and difficulty after 'useful' or 'irrelevant'."""
    s = F.when(signal == "useful", stability * 1.5).when(signal == "irrelevant", stability * 0.2).otherwise(stability)
    d = F.when(signal == "useful", difficulty * 0.9).when(signal == "irrelevant", difficulty * 1.2).otherwise(difficulty)
    return F.least(F.lit(36500.0), F.greatest(F.lit(0.1), s)), F.least(F.lit(10.0), F.greatest(F.lit(1.0), d))


def priority(trust: Column, age_minutes: Column) -> Column:
    return F.when((trust <= 0.3) & (age_minutes < 60), 1).when(trust <= 0.7, 2).otherwise(3)


def routed(rules: dict[str, dict], default: str, type_hint: Column, stability: Column, size: Column) -> Column:
    """Embedding tier of a row: the first tier, in the order given, all of whose conditions hold, else the default.

    Conditions are any of ``types`` (a list; an empty one asks nothing),
    ``stability`` and ``size`` (least values); what is null meets none. The
    default tier's own conditions are not asked.
    """
    out = None
    for tier, asked in rules.items():
        if tier == default:
            continue
        hit = F.lit(True)
        if asked.get("types"):
            hit &= F.coalesce(type_hint.isin(*asked["types"]), F.lit(False))
        if asked.get("stability") is not None:
            hit &= F.coalesce(stability >= asked["stability"], F.lit(False))
        if asked.get("size") is not None:
            hit &= F.coalesce(size >= asked["size"], F.lit(False))
        out = F.when(hit, tier) if out is None else out.when(hit, tier)
    return F.lit(default) if out is None else out.otherwise(default)


def rerank_blend(llm_rank: Column, normalised_salience: Column, trust: Column) -> Column:
    return 0.7 / (1 + llm_rank) + 0.3 * normalised_salience * trust


def leg_k(base: float, weight: float) -> float | None:
    """k of a search leg; a weight of 0 switches the leg off."""
    return None if weight <= 0 else base / weight
