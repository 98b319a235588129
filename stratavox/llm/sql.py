"""SQL (DuckDB) for the results of queries that SQL can express on whole tables."""

from __future__ import annotations

from .quality import PHRASES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_PHRASES = "|".join(x.replace("'", "''") for phrases in PHRASES.values() for x in phrases)

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 85 * (len(x.g) + len(y.g) - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(root) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.g
"""

QUALITY_RULES = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
again AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g JOIN again USING (doc_id, g), range(5) t(j) GROUP BY doc_id),
lines AS (SELECT doc_id, l, {_WORDS.format("l")} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines WHERE len(w) > 0 GROUP BY doc_id),
bad AS (SELECT doc_id, count(*) AS n_lines, sum(len(w)) AS n FROM lines WHERE len(w) > 0 AND (
    len(list_filter(w, lambda x: x IN ('|', '>', '»', '›', '·', '•'))) >= greatest(2, len(w) // 5)
    OR (len(w) <= 40 AND regexp_matches(lower(l), '{_PHRASES}'))
    OR 5 * (length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) > strlen(l)
    OR (len(w) >= 30 AND NOT regexp_matches(l, '[.!?;:…。؟！？]'))) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(bad.n_lines, 0) AS n_lines_removed, coalesce(bad.n, 0) AS n_words_removed
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN bad USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * n_words_removed <= n_words AS kept,
  CAST(n_lines_removed AS BIGINT) AS n_lines_removed, CAST(n_words_removed AS BIGINT) AS n_words_removed FROM f
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
first AS (SELECT g, min(doc_id) AS d FROM g GROUP BY g),
gone AS (SELECT DISTINCT g.doc_id, g.i + j AS i FROM g JOIN first ON first.g = g.g AND first.d < g.doc_id, range(13) t(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
