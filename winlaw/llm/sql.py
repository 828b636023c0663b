"""DuckDB SQL for the corpus queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op7_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT doc_id, line, i,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), gone AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(gone.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN gone ON keyed.k = gone.k
GROUP BY doc_id
"""

ORACLES["op2_chat_template"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS t,
         length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS r
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(12 + r + 1 + t + 10 + 1)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

ORACLES["op6_decontaminate"] = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS gram
  FROM b, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS t(i) WHERE len(w) > 0
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS gram
  FROM d, (SELECT DISTINCT n FROM g), unnest(range(0, greatest(len(w) - n + 1, 0))) AS t(i)
), h AS (
  SELECT doc_id, i, p.n, item_id FROM p JOIN g ON p.n = g.n AND p.gram = g.gram
), c AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS w FROM h) GROUP BY doc_id
), k AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

ORACLES["op5_sketched_substrings"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 35], ' ') AS s FROM d, unnest(range(0, greatest(len(w) - 34, 0))) AS t(i)
), rep AS (
  SELECT doc_id, i FROM win JOIN (SELECT s FROM win GROUP BY s HAVING count(*) > 1) USING (s)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM rep
), kept AS (
  SELECT doc_id, len(w) AS n, list_extract(w, i + 1) AS word, i FROM d, unnest(range(0, len(w))) AS t(i)
), left_over AS (
  SELECT kept.doc_id, count(gone.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY kept.i) FILTER (WHERE gone.i IS NULL), '') AS text
  FROM kept LEFT JOIN gone ON kept.doc_id = gone.doc_id AND kept.i = gone.i GROUP BY kept.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over.text, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""
