"""Redaction of secrets and personal data.

Overlapping rules, prefix-keeping masks and an entropy test need the matches of
all rules side by side, so this is a pandas function. It gets only the texts that
the JVM's screen lets through, all others stay null on the way to it. The screen
looks for the words that a rule's matches hold before it tries the rule's pattern,
and is evaluated once a text.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Category, pattern (group 1 is masked), characters kept in front (None: none), entropy test.
RULES = [
    ("aws_key", r"(AKIA[0-9A-Z]{16})", 4, False),
    ("anthropic_key", r"(sk-ant-api03-[A-Za-z0-9_-]{20,})", 13, False),
    ("openai_key", r"(sk-(?:proj|live|test|org-)[A-Za-z0-9_-]{20,})", 3, False),
    ("github_pat", r"(ghp_[A-Za-z0-9]{36})", 4, False),
    ("github_fine_pat", r"(github_pat_[A-Za-z0-9_]{22,})", 11, False),
    ("slack_token", r"(xox[bp]-[0-9]{10,}-[0-9]{10,}-[A-Za-z0-9]{20,})", 5, False),
    ("stripe_key", r"(sk_(?:live|test)_[A-Za-z0-9]{24,})", 8, False),
    ("npm_token", r"(npm_[A-Za-z0-9]{36})", 4, False),
    ("gcp_key", r"(AIza[A-Za-z0-9_-]{35})", 4, False),
    ("twilio_key", r"(SK[0-9a-f]{32})", 2, False),
    ("huggingface_token", r"(hf_[A-Za-z0-9]{34})", 3, False),
    ("pypi_token", r"(pypi-[A-Za-z0-9_-]{50,})", 5, False),
    ("generic_secret", r"""(?i)(?:secret|token|password|api_?key|apikey)\s*[=:]\s*["']?([A-Za-z0-9_\-/.+]{16,})["']?""", None, True),
]
#: Personal data.
PERSONAL = [
    ("ssn", r"\b(\d{3}-\d{2}-\d{4})\b", None, False),
    ("credit_card", r"\b(\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4})\b", None, False),
]
#: What every match of a rule holds, in lower case where the rule ignores case; rules that are not listed have digits only.
HOLDS = {
    "aws_key": ("AKIA",), "anthropic_key": ("sk-ant-api03-",), "openai_key": ("sk-proj", "sk-live", "sk-test", "sk-org-"), "github_pat": ("ghp_",), "github_fine_pat": ("github_pat_",), "slack_token": ("xoxb-", "xoxp-"), "stripe_key": ("sk_live_", "sk_test_"),
    "npm_token": ("npm_",), "gcp_key": ("AIza",), "twilio_key": ("SK",), "huggingface_token": ("hf_",), "pypi_token": ("pypi-",), "generic_secret": ("secret", "token", "password", "api_key", "apikey"),
}
#: Bits per byte below which a generic secret is a placeholder.
ENTROPY = 3.5
RESULT = "content string, redactions int, categories string"


def entropy_bits(text: str) -> float:
    data = text.encode()
    return -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values()) if data else 0.0


def redact_text(text: str, compiled: list, allowed: frozenset[str] = frozenset()) -> tuple[str, int, str]:
    spans, kinds = [], set()
    low = text.lower()
    for kind, rule, keep, check in compiled:
        if not _may_hold(kind, text, low):
            continue
        for m in rule.finditer(text):
            hit = m.group(1)
            if hit in allowed or (check and entropy_bits(hit) < ENTROPY):
                continue
            kinds.add(kind)
            spans.append((m.start(1), m.end(1), hit[: keep or 0] + f"[REDACTED:{kind}]"))
    out, at, n = [], 0, 0
    for start, end, mask in sorted(spans, key=lambda s: s[0]):
        if start >= at:
            out += [text[at:start], mask]
            at, n = end, n + 1
    return "".join([*out, text[at:]]), n, ",".join(sorted(kinds))


def _may_hold(kind: str, text: str, low: str) -> bool:
    words = HOLDS.get(kind)
    return words is None or any(w in (low if kind == "generic_secret" else text) for w in words)


def matches(kind: str, pattern: str, text: Column) -> Column:
    """Whether a rule's pattern occurs; texts without what it holds are not tried."""
    words = HOLDS.get(kind)
    if words is None:
        return text.rlike(pattern)
    of = F.lower(text) if kind == "generic_secret" else text
    held = F.contains(of, F.lit(words[0]))
    for w in words[1:]:
        held = held | F.contains(of, F.lit(w))
    return held & text.rlike(pattern)


def redact(df: DataFrame, column: str = "content", personal: bool = True, allowed: tuple[str, ...] = ()) -> DataFrame:
    """df with ``redacted`` struct(content, redactions, categories) of a text column."""
    rules = RULES + (PERSONAL if personal else [])

    @F.pandas_udf(RESULT)
    def apply(texts: pd.Series) -> pd.DataFrame:
        compiled = [(k, re.compile(p, re.ASCII), keep, e) for k, p, keep, e in rules]
        return pd.DataFrame([redact_text(t, compiled, frozenset(allowed)) if t is not None else (None, 0, "") for t in texts], columns=["content", "redactions", "categories"])

    screen = F.lit(False)
    for kind, pattern, _, _ in rules:
        screen = screen | matches(kind, pattern, F.col(column))
    # the screened text is a column of its own, so the screen is evaluated once
    rows = df.withColumn("_screened", F.when(F.coalesce(screen, F.lit(False)), F.col(column)))
    untouched = F.struct(F.col(column).alias("content"), F.lit(0).alias("redactions"), F.lit("").alias("categories"))
    return rows.withColumn("redacted", apply(F.col("_screened"))).withColumn("redacted", F.when(F.col("_screened").isNotNull(), F.col("redacted")).otherwise(untouched)).drop("_screened")


def occurrences(text: Column, rules: list | None = None) -> dict[str, Column]:
    """Number of matches of each rule (without the entropy test), by its name."""
    return {k: F.when(F.coalesce(matches(k, p, text), F.lit(False)), F.regexp_count(text, F.lit(p))).otherwise(0).cast("long") for k, p, _, _ in (rules or RULES + PERSONAL)}


def screened(text: Column, rules: list | None = None) -> Column:
    """Names of the rules whose pattern occurs (without the entropy test)."""
    found = F.array(*[F.when(matches(k, p, text), F.lit(k)) for k, p, _, _ in (rules or RULES + PERSONAL)])
    return F.filter(found, lambda x: x.isNotNull())
