"""DuckDB twins of the queries that SQL can express."""

LINE_DEDUP = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped
  FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

CHAT_FORMAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
shown AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS text_chars,
         length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g')) AS role_chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + role_chars + 1 + text_chars + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""

JACCARD_JOIN = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT rid, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM docs),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY 1),
shared AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS hits FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid < b.rid AND a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y WHERE 100 * hits >= 80 * (p.n + q.n - hits)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(node, other) AS (
  SELECT x, y FROM sides
  UNION SELECT r.node, s.y FROM reached r JOIN sides s ON s.x = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(min(o.doc_id), d.doc_id), d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes USING (rid) LEFT JOIN reached r ON r.node = d.rid LEFT JOIN docs o ON o.rid = r.other GROUP BY d.rid, d.doc_id, n
"""

ORACLES = {"op4_line_dedup": LINE_DEDUP, "op5_chat_format": CHAT_FORMAT, "op7_jaccard_join": JACCARD_JOIN}
