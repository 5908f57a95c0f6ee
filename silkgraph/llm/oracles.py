"""DuckDB SQL of the queries whose result SQL can state."""

from __future__ import annotations

#: Table ``crc``: one row with the 256 entries of CRC-32, by its rule.
_CRC_TABLE = """crc AS (
  SELECT list(v ORDER BY k) AS t FROM (
    SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                          lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
    FROM range(256) r(k)))"""


def _crc(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes; ``crc`` has to be in the FROM clause."""
    digit = "strpos('0123456789ABCDEF', substr(hex({0}), {1}, 1)) - 1"
    byte = f"16 * ({digit.format(text, '2 * i + 1')}) + {digit.format(text, '2 * i + 2')}"
    data = f"list_transform(range(0, length(hex({text})) // 2), lambda i: ({byte})::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


PREFIX_TRIE = f"""
WITH {_CRC_TABLE},
own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc('conv_id::VARCHAR')} % 9 AS h FROM own, crc),
forked AS (
  SELECT o.conv_id, coalesce(list_slice(b.s, 1, h), []) || list_slice(o.s, h + 1, len(o.s)) AS s
  FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = base),
members AS (
  SELECT conv_id, d, list_slice(s, 1, d) AS p, d = len(s) AS last
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM forked)),
node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends
  FROM members GROUP BY p, d),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY 1, 2),
whole AS (
  SELECT node.*, coalesce(k, 0) AS k, CASE WHEN d > 0 THEN (n - 1) * strlen(list_extract(p, d).x) ELSE 0 END AS saved
  FROM node LEFT JOIN kids USING (p, d)),
above AS (
  SELECT list_slice(p, 1, a) AS p, a AS d, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
  FROM (SELECT p, k, saved, unnest(range(0, d + 1)) AS a FROM whole) GROUP BY 1, 2)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n AS n_convs, w.k AS n_children,
       leaves::BIGINT AS n_leaves, above.saved::BIGINT AS saved_tokens, w.ends AS ends_sha256
FROM whole w JOIN above USING (p, d) LEFT JOIN node u ON w.d > 0 AND u.d = w.d - 1 AND u.p = list_slice(w.p, 1, w.d - 1)
"""

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
marked AS (
  SELECT run, c, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h
  FROM (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run), crc),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM marked)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT a.word AS long, a.n AS long_n, b.word AS short, b.n AS short_n FROM holes a JOIN words b ON a.rest = b.word),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT long, long_n, short, short_n FROM shorter
  UNION ALL SELECT short, short_n, long, long_n FROM shorter),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
ways AS (
  SELECT word, form AS at FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.at AS root FROM ways w JOIN forms f ON f.word = w.at WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
"""
