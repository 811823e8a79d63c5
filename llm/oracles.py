"""DuckDB SQL for the operators that SQL can express; plain restatements, quadratic where that is simplest."""

from __future__ import annotations

WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s
  FROM w
),
s AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets WHERE len(s) > 0),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, least(sets.doc_id, coalesce(m.b, sets.doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY 1) m ON m.a = sets.doc_id
"""

RELATIVE_LZ = f"""
WITH w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM twice),
words AS (SELECT doc_id, ws[j] AS word, j FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.j) AS kept, count(*) AS n
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j WHERE gone.j IS NULL GROUP BY 1
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

RUNS = r"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda n: list_reduce(
        list_concat([n::UBIGINT], range(8)::UBIGINT[]), lambda c, k: xor(c >> 1, 3988292384::UBIGINT * (c & 1)))) AS t),
hashed AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
            lambda c, b: xor(c >> 8, t[(1 + (xor(c, b) & 255))::BIGINT])), 4294967295::UBIGINT)::BIGINT AS h
    FROM documents, crc_table),
placed AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM hashed),
told AS (
    SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < g % n THEN w[i + 1]
        ELSE w[1 + g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8))] END) ELSE w END AS w
    FROM placed),
-- every run holds six words in a row that stand again one period on
grams AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS gram FROM told, unnest(range(len(w) - 5)) AS u(i)),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + 5 + q AS l FROM islands GROUP BY doc_id, q, island HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM stretches GROUP BY doc_id, s, l),
best AS (SELECT doc_id, count(*) AS n_runs, arg_min((s, l, q), (-l, s, q)) AS b, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    list((s + q, s + l)) AS covered FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, i FROM runs, unnest(range(s + q, s + l)) AS u(i)),
gone AS (SELECT doc_id, list(i) AS d FROM dropped GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b[1] AS start, b[2] AS length, b[3] AS period, 1000 * b[2] // b[3] AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256,
    sha256(coalesce(array_to_string(CASE WHEN d IS NULL THEN w ELSE list_transform(list_filter(range(len(w)), lambda i: NOT list_contains(d, i)), lambda i: w[i + 1]) END, ' '), '')) AS collapsed_sha256
FROM told t LEFT JOIN best USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

CHAT = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(14 + length(regexp_replace(role, '\\|###|</turn>|:', '\\\0', 'g')) + length(regexp_replace(text, '\\|###|</turn>', '\\\0', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
