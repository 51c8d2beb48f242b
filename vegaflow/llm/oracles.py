"""SQL for DuckDB of the operators that SQL can express, stated plainly: whole products, whole rounds, audit strings."""

from __future__ import annotations

WHOLE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

PRODUCTS_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND {WHOLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
"""


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of all distances; an assignment is the least of distance * entries + entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT p.row_id, p.part, any_value(p.x) AS x, min(CAST(list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.x) + list_dot_product(b.x, b.x) AS BIGINT) * {entries} + b.entry) AS k FROM p JOIN b{r} b USING (part) GROUP BY 1, 2)""")
        if r < rounds:
            steps.append(f"""n{r} AS (SELECT part, entry, list(floor(s / c) ORDER BY i) AS x FROM (SELECT part, entry, i, sum(v) AS s, count(*) AS c FROM (SELECT part, k % {entries} AS entry, unnest(x) AS v, unnest(generate_series(1, len(x))) AS i FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN n{r} n ON n.part = b.part AND n.entry = b.entry)""")
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS row_id, vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS e FROM embeddings WHERE embedding IS NOT NULL AND {WHOLE}),
p AS MATERIALIZED (SELECT row_id, vec_id, part, list_slice(e, part * len(e) // {parts} + 1, (part + 1) * len(e) // {parts}) AS x FROM kept, (SELECT unnest(generate_series(0, {parts - 1})) AS part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < {entries}),
{', '.join(steps)},
coded AS (SELECT row_id, string_agg(printf('%02x', k % {entries}), '' ORDER BY part) AS code, CAST(sum(k // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY 1),
book AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(x) AS v, unnest(generate_series(1, len(x))) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM book) AS codebooks_sha256 FROM kept JOIN coded USING (row_id)
"""


#: A sign that is not white space, in the contract's words.
MARK = "[^\\x20\\x09-\\x0D]"

#: The checksum of ``conv_id:turn`` by its polynomial, byte by byte; a repaired history is a string of edits and a text, compared as they are.
REPAIR_SQL = f"""
WITH RECURSIVE bits AS (SELECT i, i AS v, 0 AS k FROM (SELECT unnest(generate_series(0::BIGINT, 255::BIGINT)) AS i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
sums AS (SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295::BIGINT) % 20 AS kind FROM (SELECT DISTINCT key FROM keyed), crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, kind FROM keyed JOIN sums USING (key)),
live AS (SELECT conv_id, turn, role, text FROM hurt WHERE kind <> 0 UNION ALL SELECT conv_id, turn, role, text FROM hurt WHERE kind = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM live),
turns AS MATERIALIZED (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '{MARK}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
totals AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM turns GROUP BY 1),
said(state, role, after) AS (VALUES ('', 'user', 'u'), ('s', 'user', 'u'), ('u', 'assistant', 'a'), ('a', 'user', 'u')),
runs AS (SELECT DISTINCT state, state AS reached, '' AS edits, '' AS lines FROM said UNION ALL SELECT state, after, 'I', chr(10) || role || ':' FROM said UNION ALL SELECT a.state, b.after, 'II', chr(10) || a.role || ':' || chr(10) || b.role || ':' FROM said a JOIN said b ON b.state = a.after),
way AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS state, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM totals
  UNION ALL
  SELECT conv_id, i, state, r.cost, r.audit, r.lines FROM (
    SELECT conv_id, i, state, min({{'cost': cost, 'audit': audit, 'lines': lines}}) AS r FROM (
      SELECT w.conv_id, t.i, w.cost + 3 * length(x.edits) + CASE e.op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.op <> 'D' AND t.fault = 'truncated' THEN 3 ELSE 0 END AS cost, w.audit || x.edits || e.op AS audit,
        w.lines || x.lines || CASE e.op WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || t.role || ':' || t.text ELSE chr(10) || s.role || ':' || t.text END AS lines,
        CASE WHEN e.op = 'D' THEN x.reached WHEN e.op = 'R' OR t.initial = s.after THEN s.after WHEN t.initial = 's' AND x.reached = '' THEN 's' END AS state
      FROM way w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1 JOIN runs x ON x.state = w.state JOIN said s ON s.state = x.reached, (VALUES ('D'), ('K'), ('R')) e(op)
      WHERE e.op = 'D' OR t.fault NOT IN ('blank', 'duplicate')) WHERE state IS NOT NULL GROUP BY 1, 2, 3)),
done AS (SELECT w.conv_id, min({{'cost': w.cost + 3 * length(x.edits), 'audit': w.audit || x.edits, 'lines': w.lines || x.lines}}) AS r FROM way w JOIN totals t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i JOIN runs x ON x.state = w.state WHERE x.reached IN ('', 'a') GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(r.cost, 0) AS cost, coalesce(r.audit, '') AS audit, sha256(coalesce(substring(r.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
