"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

#: Every string of 200 bytes is counted; bytes under those that start twice go.
SUFFIXES = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
s AS (SELECT doc_id, i, md5_number(raw[i : i + 199]) AS h FROM d, unnest(range(1, octet_length(raw) - 198)) AS t(i) WHERE octet_length(raw) >= 200),
twice AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM s JOIN twice USING (h)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
spans AS (SELECT doc_id, span, min(i) AS low, max(i) + 200 AS high FROM n GROUP BY ALL),
gaps AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 1) AS before FROM spans),
kept AS (SELECT g.doc_id, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(hex(raw[before : low - 1]), '' ORDER BY low) || hex(any_value(raw)[max(high) :]) AS rest FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(rest), raw)) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: Host verdicts by the same prior: weight from the spread of the hosts' rates less binomial noise.
QUALITY = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, w[i : i + 7] AS g FROM d, unnest(range(1, len(w) - 6)) AS t(i) WHERE len(w) >= 8),
rep AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT win.doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN rep ON win.doc_id = rep.doc_id AND win.g = rep.g) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT source, rule, count(*) AS n, sum(fails) AS x FROM (SELECT source, unnest(['short', 'repetitive', 'symbols', 'same_lines']) AS rule,
  unnest([(n_words < 20)::INT, (100 * n_repeat_words > 30 * n_words)::INT, (n_symbols > n_words)::INT, (n_lines > 1 AND 2 * n_dup_lines > n_lines)::INT]) AS fails FROM m WHERE source IS NOT NULL) GROUP BY ALL),
p AS (SELECT rule, sum(x) / sum(n) AS mean, sum(x * x / n) / sum(n) - (sum(x) / sum(n)) ** 2 - (sum(x) / sum(n)) * (1 - sum(x) / sum(n)) * count(*) / sum(n) AS spread FROM f GROUP BY rule),
q AS (SELECT rule, mean, CASE WHEN spread > 1e-12 THEN least(greatest(mean * (1 - mean) / spread - 1, 1), 1e6) ELSE 1e6 END AS weight FROM p),
v AS (SELECT source, max((x + mean * weight) / (n + weight)) <= 0.5 AS ok FROM f JOIN q USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(ok, true) AS kept FROM m LEFT JOIN v USING (source)
"""

#: All pairs that share a shingle, and the groups that links make.
JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END) AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
reach AS (SELECT a AS doc_id, a AS r FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
c AS (SELECT doc_id, min(r) AS class_id FROM reach GROUP BY doc_id),
e AS (SELECT doc_id, list(g ORDER BY g) AS l FROM s GROUP BY doc_id),
q AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS set_id FROM e),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(set_id, doc_id) AS set_id, coalesce(n.n, 0) AS n_shingles
FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN n USING (doc_id)
"""
