"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

_W = r"'[^\x20\x09-\x0D]+'"

_OP2 = r"""
WITH u AS (
 SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
 SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
 SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC, length(rp) DESC) AS k
 FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND k = 1
"""

_OP6 = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM t WHERE len(w) >= 35),
h AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM g),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT r, i + k AS p FROM d, range(35) AS o(k)),
e AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t),
k AS (
 SELECT e.r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY e.p) AS kept
 FROM e LEFT JOIN c ON c.r = e.r AND c.p = e.p WHERE c.p IS NULL GROUP BY e.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON k.r = t.r
"""

_OP7 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents),
b AS (
 SELECT doc_id, text, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_W})) AS lines, list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, {_W})) AS paras,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t),
h AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM g),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM h),
q AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS s FROM (SELECT doc_id, unnest(range(1, len(w))) AS i, w FROM t)),
tp AS (SELECT doc_id, max(n * (length(s) - 1)) AS top_pair FROM (SELECT doc_id, s, count(*) AS n FROM q GROUP BY doc_id, s) WHERE n > 1 GROUP BY doc_id),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
x AS (
 SELECT b.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed, len(lines) AS n_lines, n_upper, n_letters,
  len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|…)[\x20\x09-\x0D]*$'))) AS n_ellipses,
  len(paras) AS n_paras, len(paras) - len(list_distinct(paras)) AS n_dup_paras, coalesce(top_pair, 0) AS top_pair
 FROM b LEFT JOIN c ON c.doc_id = b.doc_id LEFT JOIN tp ON tp.doc_id = b.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
 CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 10 * n_upper > 4 * n_letters
  OR 2 * n_dup_lines > n_lines OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines OR 2 * n_dup_paras > n_paras OR 5 * top_pair > word_chars) AS kept
FROM x
"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_TERM}) AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_TERM})) AS term FROM benchmark),
t AS (
 SELECT doc, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM t, s GROUP BY term, n_docs),
m AS (SELECT doc, doc_id, 50 + (50 * CAST(len(w) AS BIGINT) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
x AS (
 SELECT item_id, doc_id, doc, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
 FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (doc) GROUP BY item_id, doc_id, doc)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 50
"""

_OP13 = r"""
WITH d AS (
 SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
s AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) AS o(k) WHERE len(w) >= k),
f AS (
 SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM s) GROUP BY lang, k, phrase
 HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT c.*, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS tail FROM c, range(1, 5) AS o(cut) WHERE cut < k),
y AS (
 SELECT x.lang, x.phrase, x.a, cut, g.f AS l, h.f AS r, n, (1000::HUGEINT * x.a * n) // (g.f::HUGEINT * h.f) AS score
 FROM x JOIN f g ON g.lang = x.lang AND g.phrase = head JOIN f h ON h.lang = x.lang AND h.phrase = tail JOIN t ON t.lang = x.lang),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM y) WHERE o = 1),
b AS (
 SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
 FROM (SELECT lang, w, a, k, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) AS o(m) WHERE m < k) GROUP BY 1, 2),
v AS (SELECT z.* FROM z LEFT JOIN b ON b.lang = z.lang AND b.phrase = z.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM v) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op2_urls": _OP2,
    "op6_substrings": _OP6,
    "op7_quality": _OP7,
    "op12_search": _OP12,
    "op13_phrases": _OP13,
}
