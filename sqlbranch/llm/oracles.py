"""What some queries return, in DuckDB's SQL. The others merge, link, learn or sample in ways that SQL has no expression for; tests hold those against plain versions."""

from .quality import COMMON_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_WORDS
from .queries import NEAR

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, regexp_extract_all({_FOLD.format('t')}, '[^\x20\x09-\x0D]+') AS low,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM grams),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM counted WHERE n > 1) GROUP BY doc_id),
base AS (SELECT w.doc_id, lang, t, low, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
         FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
classes AS (SELECT doc_id, lang, n_words, unnest([
              length(regexp_replace(t, '[^a-z]', '', 'g')), length(regexp_replace(t, '[^A-Z]', '', 'g')), length(regexp_replace(t, '[^0-9]', '', 'g')),
              length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')), n_symbols,
              length(regexp_replace(t, '[^\x00-\x08\x0E-\x1F!"''()+,\-./:;=?@\[\\\]^_`{{}}~\x7F]', '', 'g')), length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))]) AS n,
              unnest(range(7)) AS k FROM failed),
ref_classes AS (SELECT lang, k, CAST(sum(n) AS DOUBLE) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM classes GROUP BY lang, k),
doc_classes AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY doc_id) AS p FROM classes WHERE n_words >= {MIN_WORDS}),
class_distance AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS x
                   FROM doc_classes JOIN ref_classes USING (lang, k) GROUP BY doc_id),
words AS (SELECT doc_id, lang, n_words, unnest(low) AS word FROM failed),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
top AS (SELECT lang, word, n FROM (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, encode(word)) AS r
        FROM words GROUP BY lang, word) WHERE r <= {COMMON_WORDS}),
ref AS (SELECT t.lang, t.word, CAST(t.n AS DOUBLE) / totals.n AS q FROM top t JOIN totals USING (lang)),
seen AS (SELECT doc_id, lang, word, CAST(count(*) AS DOUBLE) / any_value(n_words) AS p FROM words WHERE n_words >= {MIN_WORDS} AND (lang, word) IN (SELECT (lang, word) FROM top) GROUP BY doc_id, lang, word),
parts AS (SELECT doc_id, lang, word, p, 0.0::DOUBLE AS q FROM seen UNION ALL SELECT f.doc_id, r.lang, r.word, 0.0, r.q FROM failed f JOIN ref r USING (lang) WHERE f.n_words >= {MIN_WORDS}),
both_sides AS (SELECT doc_id, lang, word, sum(p) AS p, sum(q) AS q FROM parts GROUP BY doc_id, lang, word),
rest AS (SELECT * FROM both_sides UNION ALL SELECT doc_id, lang, NULL, greatest(0, 1 - sum(p)), greatest(0, 1 - sum(q)) FROM both_sides GROUP BY doc_id, lang),
word_distance AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS x FROM rest GROUP BY doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(c.x, 0) > {MAX_CLASS_DISTANCE} AND NOT coalesce(v.x, 0) > {MAX_WORD_DISTANCE} AS kept
FROM failed f LEFT JOIN class_distance c ON c.doc_id = f.doc_id LEFT JOIN word_distance v ON v.doc_id = f.doc_id
"""

_URLS = """
WITH s AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM s),
r AS (SELECT page_id, host, path, CASE
        WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN '.' || host LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN '.' || host LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_WORDS = r"regexp_extract_all(" + _FOLD.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, CAST(least(10, len(ws)) AS BIGINT) AS size, array_to_string(ws[i:i + 9], ' ') AS w
            FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
starts AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS w FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
found AS (SELECT s.doc_id, s.i, s.size, windows.item_id FROM starts s JOIN windows ON s.size = windows.size AND s.w = windows.w),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM found GROUP BY doc_id),
terms AS (SELECT w, size, unnest(list_distinct(string_split(w, ' '))) AS term, len(list_distinct(string_split(w, ' '))) AS n FROM (SELECT DISTINCT w, size FROM windows WHERE size > 1)),
places AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM d),
here AS (SELECT DISTINCT doc_id, word FROM places),
whole AS (SELECT doc_id, w, any_value(n) AS n FROM here JOIN terms ON term = word GROUP BY doc_id, w HAVING count(*) = any_value(n)),
spots AS (SELECT whole.doc_id, whole.w, whole.n, p, word FROM whole JOIN terms ON terms.w = whole.w JOIN places ON places.doc_id = whole.doc_id AND word = term),
close AS (SELECT DISTINCT a.doc_id, a.w FROM (SELECT a.doc_id, a.w, a.p, count(DISTINCT b.word) AS seen, any_value(a.n) AS n FROM spots a
          JOIN spots b ON b.doc_id = a.doc_id AND b.w = a.w AND b.p BETWEEN a.p AND a.p + {NEAR} GROUP BY a.doc_id, a.w, a.p) a WHERE seen = n),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM (SELECT doc_id, item_id FROM close JOIN windows ON windows.w = close.w UNION SELECT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated, CAST(coalesce(near.n, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id LEFT JOIN near ON near.doc_id = d.doc_id
"""

ORACLES = {"op1_quality": _QUALITY, "op6_url_rules": _URLS, "op7_decontamination": _CONTAMINATION}
