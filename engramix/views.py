"""Logical tables over the driver's tables: deterministic, no clock, no randomness.

Every view is defined once as SQL that Spark and DuckDB both run after a few
dialect words are filled in, so an operator and its oracle start from the same
rows and only the operator itself is compared.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The reference time of all queries.
NOW = "2024-02-01 00:00:00"

#: View -> (tables it reads, SQL). ``{now}``, ``{arr:a, b}`` and ``{days:n}`` are dialect words.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "memories": (
        ("documents", "labels"),
        """
        SELECT concat('m', lpad(CAST(d.doc_id AS {str}), 9, '0')) AS id, d.doc_id, d.text AS content,
          CASE d.doc_id % 6 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' WHEN 2 THEN 'instruction' WHEN 3 THEN 'decision' WHEN 4 THEN 'observation' ELSE 'summary' END AS type_hint,
          CASE WHEN d.doc_id % 11 = 0 THEN 'user' WHEN d.doc_id % 13 = 0 THEN concat('auto-store/', d.source) ELSE d.source END AS source,
          CASE WHEN d.doc_id % 29 = 0 THEN NULL WHEN d.doc_id % 37 = 0 THEN {arr:d.lang, d.source, 'suspicious'} WHEN d.doc_id % 41 = 0 THEN {arr:d.lang, d.source, 'curation:flagged'} WHEN d.doc_id % 43 = 0 THEN {arr:d.lang, 'project-summary'} WHEN d.doc_id % 7 = 0 THEN {arr:d.lang, d.source, 'enriched'} ELSE {arr:d.lang, d.source} END AS tags,
          {now} - {days:d.doc_id % 90} - {minutes:d.doc_id % 1440} AS created_at,
          {now} - {days:d.doc_id % 45} - {minutes:d.doc_id % 1440} AS updated_at,
          d.doc_id % 17 AS access_count,
          concat('actor', CAST(d.doc_id % 5 AS {str})) AS actor,
          CASE d.doc_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'agent' WHEN 2 THEN 'system' ELSE 'auto-store' END AS actor_type,
          CASE WHEN d.doc_id % 10 = 0 THEN 'self' ELSE 'global' END AS audience,
          CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE concat('p', CAST(d.doc_id % 4 AS {str})) END AS project,
          concat('s', CAST(d.doc_id % 50 AS {str})) AS session_id,
          CASE WHEN d.doc_id % 2 = 0 THEN 'coder' ELSE NULL END AS agent_role,
          CAST(CASE WHEN l.toxic = 1 THEN 0.1 WHEN l.quality = 1 THEN 0.8 WHEN l.quality = 0 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS trust_level,
          CASE d.doc_id % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'imported' WHEN 2 THEN 'explicit' WHEN 3 THEN 'derived' ELSE 'pattern' END AS knowledge_tier,
          CASE WHEN d.doc_id % 5 = 3 THEN {arr:concat('m', lpad(CAST(d.doc_id - 1 AS {str}), 9, '0')), concat('m', lpad(CAST(d.doc_id - 3 AS {str}), 9, '0'))} END AS source_ids,
          CASE d.doc_id % 4 WHEN 0 THEN 'auto_store' WHEN 1 THEN 'import' WHEN 2 THEN 'ingest' ELSE NULL END AS write_path,
          CASE WHEN d.doc_id % 8 = 0 THEN {now} - {days:d.doc_id % 365} END AS event_time,
          CASE WHEN d.doc_id % 23 = 0 THEN {now} - {days:d.doc_id % 60} END AS deleted_at,
          CASE WHEN d.doc_id % 19 = 0 THEN {now} - {days:1} WHEN d.doc_id % 19 = 1 THEN {now} + {days:1} END AS expires_at,
          d.doc_id % 31 = 0 AS is_consolidated_original,
          CASE WHEN length(d.text) > 400 THEN substr(d.text, 1, 100) END AS abstract_text,
          CASE WHEN length(d.text) > 2000 THEN substr(d.text, 1, 500) END AS overview_text,
          CASE d.doc_id % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'complete' END AS embedding_status,
          CASE d.doc_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'complete' END AS extraction_status,
          CASE d.doc_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'skipped' ELSE 'complete' END AS abstraction_status,
          CASE d.doc_id % 8 WHEN 0 THEN 'pending' ELSE 'complete' END AS normalization_status,
          {arr:concat('Lang ', upper(d.lang)), d.source} AS entities,
          CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE {arr:concat('lang: ', d.lang), concat('size:', CAST(d.n_chars AS {str})), 'plain remark'} END AS facts
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        """,
    ),
    "memory_embeddings": (
        ("embeddings",),
        """
        SELECT concat('m', lpad(CAST(vec_id AS {str}), 9, '0')) AS memory_id, CAST(embedding AS {doubles}) AS embedding, label,
          CASE WHEN vec_id % 3 = 0 THEN 'quality' ELSE 'fast' END AS tier, vec_id % 7 <> 0 AS is_current,
          CASE WHEN vec_id % 3 = 0 THEN 'model-b' ELSE 'model-a' END AS model_name, CAST(1 + vec_id % 2 AS {str}) AS model_version
        FROM embeddings
        """,
    ),
    "memory_salience": (
        ("events", "documents"),
        """
        SELECT concat('m', lpad(CAST(event_id % n AS {str}), 9, '0')) AS memory_id,
          CAST(0.2 + (count(*) % 13) * 0.5 AS DOUBLE) AS stability, CAST(5.0 AS DOUBLE) AS difficulty,
          CAST(count(*) % 6 AS BIGINT) AS reinforcement_count, CAST(max(ts) AS TIMESTAMP) AS last_reinforced_at
        FROM events CROSS JOIN (SELECT greatest(count(*), 1) AS n FROM documents ) d GROUP BY event_id % n
        """,
    ),
    "session_recalls": (
        ("events", "documents"),
        """
        SELECT concat('u', CAST(user_id AS {str})) AS session_id, concat('m', lpad(CAST(event_id % n AS {str}), 9, '0')) AS memory_id, min(CAST(ts AS TIMESTAMP)) AS recalled_at
        FROM events CROSS JOIN (SELECT greatest(count(*), 1) AS n FROM documents ) d GROUP BY user_id, event_id % n
        """,
    ),
    "entities": (
        ("customer", "nation", "region"),
        """
        SELECT concat('c', CAST(c_custkey AS {str})) AS id, c_name AS name, 'person' AS entity_type, {arr:lower(c_name), c_mktsegment} AS aliases, {now} - {days:c_custkey % 300} AS last_seen_at FROM customer
        UNION ALL SELECT concat('n', CAST(n_nationkey AS {str})), n_name, 'place', {arr:lower(n_name), substr(n_name, 1, 3)}, {now} - {days:n_nationkey} FROM nation
        UNION ALL SELECT concat('r', CAST(r_regionkey AS {str})), r_name, 'place', {arr:lower(r_name), 'region'}, {now} - {days:r_regionkey} FROM region
        """,
    ),
    "relationships": (
        ("customer", "nation", "orders"),
        """
        SELECT concat('cn', CAST(c_custkey AS {str})) AS id, concat('c', CAST(c_custkey AS {str})) AS subject_id, concat('n', CAST(c_nationkey AS {str})) AS object_id, 'lives_in' AS predicate, 'temporal' AS relationship_type,
          {now} - {days:c_custkey % 100} AS valid_from, CASE WHEN c_custkey % 10 = 0 THEN {now} - {days:1} END AS invalid_at FROM customer
        UNION ALL SELECT concat('nr', CAST(n_nationkey AS {str})), concat('n', CAST(n_nationkey AS {str})), concat('r', CAST(n_regionkey AS {str})), 'part_of', 'semantic', {now} - {days:30}, NULL FROM nation
        UNION ALL SELECT concat('lk', CAST(c_custkey AS {str})), concat('c', CAST(c_custkey AS {str})), concat('n', CAST((c_custkey * 7) % 25 AS {str})), CASE WHEN c_custkey % 2 = 0 THEN 'likes' ELSE 'dislikes' END, 'semantic', {now} - {days:c_custkey % 50}, NULL FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT concat('dl', CAST(c_custkey AS {str})), concat('c', CAST(c_custkey AS {str})), concat('n', CAST((c_custkey * 7) % 25 AS {str})), 'dislikes', 'semantic', {now} - {days:c_custkey % 20}, NULL FROM customer WHERE c_custkey % 12 = 0
        """,
    ),
    "entity_facts": (
        ("orders", "documents"),
        """
        SELECT concat('f', CAST(o_orderkey AS {str})) AS id, concat('c', CAST(o_custkey AS {str})) AS entity_id, 'orderpriority' AS attribute, o_orderpriority AS value, CAST(o_orderdate AS TIMESTAMP) AS valid_from,
          CASE WHEN o_orderstatus = 'F' THEN {now} - {days:o_orderkey % 200} END AS invalid_at, concat('m', lpad(CAST(o_orderkey % n AS {str}), 9, '0')) AS source_memory_id
        FROM orders CROSS JOIN (SELECT greatest(count(*), 1) AS n FROM documents ) d
        """,
    ),
    "entity_mentions": (
        ("orders", "documents"),
        """
        SELECT concat('e', CAST(o_orderkey AS {str})) AS id, concat('c', CAST(o_custkey AS {str})) AS entity_id, concat('m', lpad(CAST(o_orderkey % n AS {str}), 9, '0')) AS memory_id, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders CROSS JOIN (SELECT greatest(count(*), 1) AS n FROM documents ) d
        """,
    ),
    "predicate_contradictions": ((), "SELECT * FROM (VALUES ('likes', 'dislikes'), ('dislikes', 'likes'), ('trusts', 'distrusts'), ('distrusts', 'trusts')) t(predicate_a, predicate_b)"),
    "messages": (
        ("conversations",),
        "SELECT conv_id, turn, role, text AS content, {now} - {days:30} + {minutes:conv_id % 1000 + turn * 2} AS at, turn % 5 <> 3 AS stored FROM conversations",
    ),
    "auto_entries": (
        ("events",),
        "SELECT event_id, user_id, event_type, concat(CAST(user_id AS {str}), '/', event_type) AS content_key, CAST(ts AS TIMESTAMP) AS ts, value FROM events",
    ),
}


def _fill(sql: str, spark: bool) -> str:
    out, i = [], 0
    now = f"TIMESTAMP '{NOW}'"
    while True:
        j = sql.find("{", i)
        if j < 0:
            return "".join(out) + sql[i:]
        out.append(sql[i:j])
        k, depth = j + 1, 1
        while depth:
            depth += {"{": 1, "}": -1}.get(sql[k], 0)
            k += 1
        word, _, rest = sql[j + 1 : k - 1].partition(":")
        rest = _fill(rest, spark)
        out.append(
            {
                "now": now,
                "str": "STRING" if spark else "VARCHAR",
                "doubles": "ARRAY<DOUBLE>" if spark else "DOUBLE[]",
                "arr": f"array({rest})" if spark else f"[{rest}]",
                "days": f"make_interval(0, 0, 0, CAST({rest} AS INT))" if spark else f"to_days(CAST({rest} AS INTEGER))",
                "minutes": f"make_interval(0, 0, 0, 0, 0, CAST({rest} AS INT))" if spark else f"to_minutes(CAST({rest} AS INTEGER))",
            }[word]
        )
        i = k


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table as a DataFrame."""
    tables, sql = VIEWS[name]
    return spark.sql(_fill(sql, True).replace("{{", "{"), **{}) if not tables else _bound(spark, sf_dir, tables, sql)


def _bound(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], sql: str) -> DataFrame:
    # tables are passed as frames, so nothing is registered in the session
    text = _fill(sql, True)
    for t in tables:
        for before in ("FROM ", "JOIN "):
            text = text.replace(f"{before}{t} ", f"{before}{{{t}}} ").replace(f"{before}{t}\n", f"{before}{{{t}}}\n")
        if text.endswith(f"FROM {t}"):
            text = text[: -len(t)] + f"{{{t}}}"
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables if f"{{{t}}}" in text})


def oracle(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views in front; ``x -> f(x)`` stands for its lambda form."""
    sql = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({_fill(VIEWS[n][1], False)})" for n in names)
    body = sql.lstrip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes}, {body[4:]}"
    return f"WITH {ctes} {body}"
