"""DuckDB SQL of the results of those corpus queries that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

_LOW = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
#: RFC 4648.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Sets of 4-word shingles, links of at least 80 percent, least reachable id.
OP1 = rf"""
WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words),
shingles AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
texts AS MATERIALIZED (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
parts AS MATERIALIZED (SELECT node, n, unnest(s) AS g FROM texts),
links AS MATERIALIZED (SELECT a.node AS x, b.node AS y FROM parts a JOIN parts b ON a.g = b.g AND a.node < b.node AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT node AS root, node AS pos FROM texts UNION SELECT reach.root, edges.y FROM reach JOIN edges ON edges.x = reach.pos),
least AS (SELECT root, min(pos) AS component_id FROM reach GROUP BY root)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM sets d LEFT JOIN texts t ON d.s = t.s LEFT JOIN least l ON l.root = t.node
"""

_WORDS3 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of 13 words of items, and where they stand in documents.
OP3 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORDS3}') AS w FROM documents),
b AS MATERIALIZED (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW}, '{_WORDS3}') AS w FROM benchmark),
items AS MATERIALIZED (SELECT item, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
windows AS MATERIALIZED (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS x FROM items, unnest(range(1, len(w) - m + 2)) AS t(i)),
lengths AS (SELECT DISTINCT m FROM windows),
places AS MATERIALIZED (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS x FROM d, lengths, unnest(range(1, len(w) - m + 2)) AS t(i)),
hits AS MATERIALIZED (SELECT doc_id, p.m, i, item FROM places p JOIN windows USING (m, x)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, m, i FROM hits), unnest(range(i, i + m)) AS t(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: Base-32 of SHA-1: each five hexadecimal digits are four letters.
OP4 = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
x AS (SELECT page_id, url, octet_length(encode(body)) AS n, sha1(body) AS h FROM p),
y AS (SELECT page_id, url, n, h, array_to_string(list_transform(range(0, 8), lambda k: list_reduce(list_transform(range(0, 4), lambda j: '{_BASE32}'[((('0x' || substring(h, k * 5 + 1, 5))::BIGINT >> (15 - 5 * j)) & 31) + 1]), lambda a, b: a || b)), '') AS digest FROM x),
z AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM y)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM z
"""

#: All windows of 200 bytes, of pieces of a text, for a place in a long string is found by counting from its start.
OP7 = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS MATERIALIZED (SELECT r, doc_id, x, length(x) // 2 AS n FROM d),
pieces AS (SELECT r, p, substring(x, 2 * p + 1, 2 * (500 + 199)) AS x FROM n, unnest(range(0, greatest(n - 199, 0), 500)) AS t(p)),
windows AS MATERIALIZED (SELECT r, p + i AS pos, md5_number(substring(x, 2 * i + 1, 400)) AS h FROM pieces, unnest(range(0, 500)) AS t(i) WHERE length(x) >= 2 * i + 400),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, pos FROM windows JOIN again USING (h)),
marked AS (SELECT r, pos, CASE WHEN pos <= lag(pos) OVER w + 200 THEN 0 ELSE 1 END AS new FROM hit WINDOW w AS (PARTITION BY r ORDER BY pos)),
runs AS (SELECT r, run, min(pos) AS s, max(pos) + 200 AS e FROM (SELECT r, pos, sum(new) OVER (PARTITION BY r ORDER BY pos) AS run FROM marked) GROUP BY r, run),
gaps AS (SELECT r, coalesce(lag(e) OVER w, 0) AS a, s AS b FROM runs WINDOW w AS (PARTITION BY r ORDER BY s)),
tails AS (SELECT r, max(e) AS a, count(*) AS n_spans, sum(e - s) AS n_removed FROM runs GROUP BY r),
kept AS (SELECT r, a, substring(x, 2 * a + 1, 2 * (b - a)) AS x FROM gaps JOIN n USING (r) UNION ALL SELECT r, a, substring(x, 2 * a + 1) FROM tails JOIN n USING (r)),
whole AS (SELECT r, string_agg(x, '' ORDER BY a) AS x FROM kept GROUP BY r)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(whole.x, n.x))) AS kept_sha256
FROM n LEFT JOIN tails USING (r) LEFT JOIN whole USING (r)
"""

_RUNS = r"[A-Za-z\u00C0-\u00FF]+".encode().decode("unicode_escape")
#: CRC-32 by its table of 256 values, byte by byte over hexadecimal digits; near words by the key that is left when a place is cut out.
OP11 = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(x ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b) AS x FROM range(256) AS r(b))),
runs AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '{_RUNS}')) AS w FROM documents),
seen AS MATERIALIZED (SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs GROUP BY ALL),
hashed AS MATERIALIZED (SELECT w, n, xor(4294967295, list_reduce(range(0, length(x) // 2), lambda s, i: xor(s >> 8, t[(xor(s, ('0x' || substring(x, 2 * i + 1, 2))::BIGINT) & 255) + 1]), 4294967295::BIGINT)) AS h FROM seen, crc),
spoilt AS (SELECT CASE WHEN h % 199 = 0 THEN substring(w, 1, h % length(w)) || substring(w, (h % length(w)) + 2) ELSE w END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS k FROM v, unnest(range(0, length(word))) AS r(i)),
pairs AS (SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN v b ON a.k = b.word UNION SELECT b.word, a.word, a.n FROM cuts a JOIN v b ON a.k = b.word),
near AS (SELECT word, count(*) AS n_near, max(n) AS best, arg_min(other, (-n, encode(other))) AS other FROM pairs GROUP BY word),
forms AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best >= 5 * n THEN other END AS form, CASE WHEN best >= 5 * n THEN best END AS form_n FROM v LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS pos FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.pos AND f.form IS NOT NULL),
ends AS (SELECT walk.word, pos AS root FROM walk JOIN forms f ON f.word = walk.pos AND f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""

_TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Every group's share of every kept term, and the differences of all pairs of a language.
OP12 = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW}, '{_TERMS}') AS w FROM documents),
each AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM each GROUP BY lang, term HAVING count(*) >= 3),
v AS MATERIALIZED (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kept GROUP BY lang),
cells AS MATERIALIZED (SELECT lang, source, term, sum(e.n)::BIGINT AS n FROM each e JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS MATERIALIZED (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN cells c USING (lang, source) GROUP BY g.lang, g.source),
shares AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS seen, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p, 1 + (1000000000 * (k.n + 1)) // (v.n + v.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE seen > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLES = {"op1_minhash": OP1, "op3_decontaminate": OP3, "op4_warc": OP4, "op7_suffix_index": OP7, "op11_spelling": OP11, "op12_divergence": OP12}
