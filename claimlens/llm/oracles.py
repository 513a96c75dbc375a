"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op2_cover_tree_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 5
"""

ORACLES["op4_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""


def _fill(level: int, names: list[str], weight: str) -> str:
    """One level of the budget tree: children of equal parents share their parent's budget."""
    path = ", ".join(names[:level + 1])
    same = "PARTITION BY " + ", ".join(names[:level]) if level else ""
    top = f"JOIN b{level - 1} USING ({', '.join(names[:level])})" if level else ", (SELECT floor(sum(tokens) * 0.6) AS top FROM leaf)"
    return f"""
n{level} AS (SELECT {path}, sum(cap) AS c, {weight} AS w FROM leaf GROUP BY {path}),
l{level} AS (
  SELECT {path}, c, w, c / w AS r,
    (top - coalesce(sum(c) OVER ({same} ORDER BY c / w, {names[level]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER ({same} ORDER BY c / w, {names[level]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam
  FROM n{level} {top} WHERE c > 0),
b{level} AS (
  SELECT {path}, CASE WHEN r <= lam THEN c ELSE w * max(CASE WHEN r > lam THEN lam END) OVER ({same}) END AS top
  FROM l{level}),"""


_LEVELS = ["domain", "lang", "source"]
ORACLES["op5_mix"] = f"""
WITH d AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+'))::BIGINT AS n_tokens FROM documents),
t AS (SELECT *, CASE WHEN n_tokens >= 1000 THEN 'long' WHEN n_tokens >= 200 THEN 'medium' ELSE 'short' END AS domain FROM d),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens, 2 * sum(n_tokens)::DOUBLE AS cap FROM t GROUP BY ALL),
{_fill(0, _LEVELS, "CASE domain WHEN 'long' THEN 3.0::DOUBLE WHEN 'medium' THEN 5.0 ELSE 2.0 END")}
{_fill(1, _LEVELS, "CASE lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END")}
{_fill(2, _LEVELS, "1.0::DOUBLE")}
plan AS (
  SELECT domain, lang, source, floor(round(top, 3)) AS budget, tokens, floor(floor(round(top, 3)) / tokens)::BIGINT AS whole
  FROM b2 JOIN leaf USING (domain, lang, source)),
o AS (
  SELECT t.*, whole, budget - whole * tokens AS rest,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17/' || whole || '/' || doc_id)
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM t JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, whole + CASE WHEN upto <= rest AND whole < 2 THEN 1 ELSE 0 END AS times
FROM o WHERE whole > 0 OR (upto <= rest AND whole < 2)
"""


def _found(kind: str, at: int, pattern: str, keep: str = "true", options: str = "") -> str:
    """Spans of one kind: the pieces between the matches give the places of the matches."""
    p = pattern.replace("'", "''")
    o = f", '{options}'" if options else ""
    return f"""
  SELECT n, {at} AS nth, '{kind}' AS kind, start, start + length(m) AS stop FROM (
    SELECT n, ms[i] AS m, (list_sum(list_transform(parts[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
    FROM (SELECT n, regexp_extract_all(t, '{p}', 0{o}) AS ms, regexp_split_to_array(t, '{p}'{o}) AS parts FROM d), range(1, 1 + len(ms)) r(i))
  WHERE {keep}"""


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ASSIGN_SQL = _ASSIGN.replace("'", "''")
ORACLES["op12_blob_ledger"] = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_found("assign", 0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN_SQL}', 2)) >= 6")}
  UNION ALL {_found("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")}
  UNION ALL {_found("hex", 2, "[0-9a-f]{24,}")}
  UNION ALL {_found("pem", 3, "-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")}
  UNION ALL {_found("jwt", 4, "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+")}),
g AS (
  SELECT n, count(*) FILTER (WHERE nth = 0) AS n_assign, count(*) FILTER (WHERE nth = 1) AS n_access, count(*) FILTER (WHERE nth = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) FILTER (WHERE nth < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) AS spans
  FROM s GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (n)
"""

ORACLES["op11_multiindex_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.e, r.e)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
    AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

ORACLES["op7_jaccard_join"] = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT n, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM d),
e AS (SELECT n, unnest(g) AS x FROM s),
p AS (SELECT a.n AS a, b.n AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.n < b.n GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.n = a JOIN s y ON y.n = b WHERE 100 * k >= 90 * (len(x.g) + len(y.g) - k)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM m UNION SELECT r.a, m.b FROM r JOIN m ON r.b = m.a),
c AS (SELECT a, min(t.doc_id) AS low FROM r JOIN s t ON t.n = r.b GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM m GROUP BY a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, least(s.doc_id, low) AS component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM s LEFT JOIN c ON c.a = s.n LEFT JOIN k ON k.a = s.n
"""
