"""The same results in DuckDB's SQL, for the operators that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]"
_RULES = {
    "base": "base_failed",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 40 * n_words",
}


def _rate(name: str) -> str:
    """Posterior mean of a host's failure rate under a beta prior fitted by moments."""
    k, noise = f"k_{name}", "(m * (1 - m))"
    return (
        f"SELECT host, CASE WHEN k > 0 AND k < n THEN (own + m * s) / (n_docs + m * s + (1 - m) * s) "
        f"ELSE (own + 1.0) / (n_docs + 2.0) END AS rate FROM ("
        f"SELECT *, least(greatest({noise} / greatest(sq / n - m * m - {noise} * hosts / n, {noise} / 1e4) - 1, 1.0), 1e4) AS s "
        f"FROM (SELECT host, n_docs, {k} AS own, sum(n_docs) OVER ()::DOUBLE AS n, sum({k}) OVER ()::DOUBLE AS k, "
        f"count(*) OVER () AS hosts, sum({k}::DOUBLE * {k} / n_docs) OVER () AS sq, "
        f"sum({k}) OVER ()::DOUBLE / sum(n_docs) OVER () AS m FROM hosts))"
    )


QUALITY = f"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
runs AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(ws, i, i + 4)) AS times
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS place FROM runs WHERE times > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, host, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
hosts AS (
  SELECT host, count(*) AS n_docs, {", ".join(f"count(*) FILTER ({rule}) AS k_{name}" for name, rule in _RULES.items())}
  FROM f GROUP BY host),
bad AS ({" UNION ALL ".join(f"SELECT host FROM ({_rate(name)}) WHERE rate > 0.5" for name in _RULES)})
SELECT doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  host IN (SELECT host FROM bad) AS host_rejected,
  NOT base_failed AND host NOT IN (SELECT host FROM bad) AS kept FROM f
"""

DEDUP = r"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(normal) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS normal
  FROM documents)
WINDOW w AS (PARTITION BY normal ORDER BY length(t) DESC, doc_id)
"""

NGRAMS = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{_WORD}+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3
    THEN list_transform(range(1, len(ws) - 1), lambda i: list_slice(ws, i, i + 2)) WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS g
  FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(lowest, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS lowest FROM reach GROUP BY x) USING (doc_id)
"""

ARCHIVES = """
SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest,
  CASE WHEN strlen(payload) >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(payload) >= 100 AND first <> page_id THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""

AUDIT = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws FROM documents),
flags AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {{
    'A': len(ws) < 200,
    'B': 100 * len(list_distinct(ws)) < 50 * len(ws),
    'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)}} AS failed
  FROM d LEFT JOIN flags USING (doc_id)),
grouped AS (SELECT part, good, toxic, failed, count(*) AS n FROM fails GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)),
steps AS (
  SELECT o AS filter_order, step::INTEGER AS step, substr(o, step, 1) AS letter,
    string_split(substr(o, 1, step - 1), '')[1:step - 1] AS earlier
  FROM orders, range(1, 6) AS s(step) WHERE length(o) = 5),
outcomes AS (
  SELECT *, failed[letter] AS own, len(list_filter(earlier, lambda x: failed[x])) > 0 AS gone,
    len(list_filter(map_values(failed), lambda x: x)) AS failures FROM grouped, steps),
counted AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT own AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (own AND failures = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (own AND NOT gone AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (own AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM outcomes GROUP BY ALL)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: isfinite(c))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum(list_transform(list_zip(q.x, c.x, true), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""

SQL = {
    "op1_quality_rules": QUALITY,
    "op2_exact_dedup": DEDUP,
    "op6_ngram_join": NGRAMS,
    "op8_archives": ARCHIVES,
    "op11_filter_audit": AUDIT,
    "op12_topk_search": TOP_K,
}
