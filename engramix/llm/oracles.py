"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[j : j + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS j FROM i)),
x AS (SELECT r, j, n, array_to_string(w[j : j + n - 1], ' ') AS s FROM (SELECT d.r, d.w, l.n, unnest(range(1, len(d.w) - l.n + 2)) AS j FROM d, (SELECT DISTINCT n FROM p) l WHERE len(d.w) >= l.n)),
h AS (SELECT x.r, x.j, x.n, p.item_id FROM x JOIN p ON p.n = x.n AND p.s = x.s),
hw AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(j, j + n)) AS k FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw ON hw.r = d.r LEFT JOIN hi ON hi.r = d.r
"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[j : j + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS j FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * met >= 90 * (p.n + q.n - met)),
g AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT g.x, e.y FROM g JOIN e ON g.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(y) FROM g WHERE g.x = d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP5 = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, place, role, text, md5(string_agg(concat(coalesce('r' || role, 'n'), chr(31), coalesce('t' || text, 'n'), chr(30)), '') OVER (PARTITION BY conv_id ORDER BY place)) AS h FROM t),
f AS (SELECT conv_id, max(place) AS n, max_by(h, place) AS h FROM p GROUP BY conv_id),
k AS (SELECT h, n, min(conv_id) AS conv_id, count(*) AS copies FROM f GROUP BY h, n),
m AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM p JOIN f ON f.conv_id = p.conv_id WHERE p.h = k.h AND p.place = k.n AND p.place < f.n))
SELECT m.conv_id, m.n AS n_turns, m.copies, string_agg('<|im_start|>' || coalesce(p.role, '') || chr(10) || replace(coalesce(p.text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY p.place) AS rendered
FROM m JOIN p ON p.conv_id = m.conv_id GROUP BY ALL
"""

OP9 = """
WITH d AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first FROM d GROUP BY x),
a AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS letters)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: letters[CAST((CAST('0x' || substr(d.x, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f ON f.x = d.x, a
"""


def _templates() -> str:
    rows = ", ".join(f"({i}, '{lic}', '{text}')" for i, (lic, text) in enumerate(licenses.TEMPLATES))
    return f"(VALUES {rows}) AS v(template, licence, wording)"


OP3 = rf"""
WITH tp AS (SELECT * FROM {_templates()}),
tt AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest(regexp_extract_all(lower(wording), '{licenses.TERM}')) AS term FROM tp) GROUP BY ALL),
files AS (SELECT doc_id, text, CASE WHEN doc_id % 200 = 0 THEN base || '/LICENSE-' || doc_id WHEN doc_id % 20 = 0 THEN base || '/' || (doc_id // 100) || '/LICENSE-' || doc_id ELSE base || '/' || (doc_id // 100) || '/' || doc_id || '.txt' END AS path
  FROM (SELECT *, coalesce(source, 'nosource') || '/' || coalesce(lang, 'nolang') AS base FROM documents)),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM files),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{licenses.TERM}')) AS term FROM files WHERE text IS NOT NULL) WHERE term IN (SELECT term FROM tt) GROUP BY term),
idf AS (SELECT t.term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) t LEFT JOIN df ON df.term = t.term, n),
tw AS (SELECT template, licence, tt.term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS tn FROM tt JOIN idf ON idf.term = tt.term),
un AS (SELECT doc_id, line, words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS words, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files) WHERE regexp_matches(lower(words), '{licenses.NAMES}')
  UNION ALL SELECT doc_id, -1, text FROM files WHERE regexp_matches(path, '{licenses.LICENCE_FILE}') AND regexp_matches(lower(text), '{licenses.NAMES}')),
ut AS (SELECT doc_id, line, term, count(*) AS tf FROM (SELECT doc_id, line, unnest(regexp_extract_all(lower(words), '{licenses.TERM}')) AS term FROM un) GROUP BY ALL),
uw AS (SELECT doc_id, line, ut.term, tf * coalesce(idf, ln(n + 1) + 1) AS u, sqrt(sum(tf * coalesce(idf, ln(n + 1) + 1) * tf * coalesce(idf, ln(n + 1) + 1)) OVER (PARTITION BY doc_id, line)) AS nn FROM ut LEFT JOIN idf ON idf.term = ut.term, n),
sc AS (SELECT doc_id, line, template, licence, round(sum(u * w) / (any_value(nn) * any_value(tn)), 6) AS score FROM uw JOIN tw ON tw.term = uw.term GROUP BY ALL),
own AS (SELECT doc_id, licence, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) AS r FROM sc WHERE score >= 0.6) WHERE r = 1),
fd AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
dl AS (SELECT dir, licence FROM (SELECT fd.dir, own.licence, row_number() OVER (PARTITION BY fd.dir ORDER BY score DESC, path) AS r FROM fd JOIN own ON own.doc_id = fd.doc_id WHERE regexp_matches(path, '{licenses.LICENCE_FILE}')) WHERE r = 1),
nr AS (SELECT dir, from_dir, licence FROM (SELECT a.dir, dl.dir AS from_dir, dl.licence, row_number() OVER (PARTITION BY a.dir ORDER BY length(dl.dir) DESC) AS r FROM (SELECT DISTINCT dir FROM fd) a JOIN dl ON a.dir = dl.dir OR starts_with(a.dir, dl.dir || '/') OR dl.dir = '') WHERE r = 1)
SELECT fd.doc_id, path, coalesce(own.licence, nr.licence) AS licence, coalesce(score, 0.0) AS score,
  CASE WHEN own.licence IS NOT NULL AND regexp_matches(path, '{licenses.LICENCE_FILE}') THEN 'file' WHEN own.licence IS NOT NULL THEN 'header' WHEN nr.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own.licence IS NULL THEN from_dir END AS from_dir
FROM fd LEFT JOIN own ON own.doc_id = fd.doc_id LEFT JOIN nr ON nr.dir = fd.dir
"""

_INTEGERS = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _assigned(n: int) -> str:
    """Nearest entries of codebook n; ties to the lower index."""
    return f"""a{n} AS (SELECT r, p.part, min((CAST(list_sum(list_transform(list_zip(p.s, c.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), e)) AS best FROM p JOIN c{n} c ON c.part = p.part GROUP BY ALL)"""


def _moved(n: int) -> str:
    """Codebook n + 1 out of assignment n; unused entries stay."""
    return f"""c{n + 1} AS (SELECT c.part, c.e, coalesce(m.s, c.s) AS s FROM c{n} c LEFT JOIN (
  SELECT part, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS s FROM (
    SELECT p.part, a.best[2] AS e, i, CAST(sum(p.s[i + 1]) AS DOUBLE) AS total, count(*) AS n FROM p JOIN a{n} a ON a.r = p.r AND a.part = p.part, (SELECT unnest(range((SELECT max(w) FROM k))) AS i) GROUP BY ALL) GROUP BY part, e) m ON m.part = c.part AND m.e = c.e)"""


OP11 = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v, len(v) // 16 AS w FROM (SELECT vec_id, label, {_INTEGERS} AS v FROM embeddings WHERE {_FINITE})),
p AS (SELECT r, part, v[part * w + 1 : part * w + w] AS s FROM k, (SELECT unnest(range(16)) AS part)),
c0 AS (SELECT part, r - 1 AS e, s FROM p WHERE r <= 64),
{_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2),
d AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN d ON d.r = k.r, h
"""

OP12 = f"""
WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_INTEGERS} AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM k a JOIN k b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""

ORACLES = {"op2_decontamination": OP2, "op3_license_scan": OP3, "op4_jaccard_join": OP4, "op5_chat_format": OP5, "op9_warc": OP9, "op11_vector_codes": OP11, "op12_hard_negatives": OP12}
