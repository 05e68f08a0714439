"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import licenses

OP7 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND c.keeper <> k.doc_id AS lost
  FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP5 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
o AS (SELECT payload, max(page_id) AS owner FROM p GROUP BY payload),
r AS (SELECT p.*, o.owner, octet_length(p.payload) >= 1000 AND o.owner <> p.page_id AS again FROM p JOIN o USING (payload))
SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN owner END AS refers_to
FROM r
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, i - 1 AS start, '{label}' AS label FROM w, range(1, len(ws) + 1) r(i) WHERE "
    + " AND ".join(f"ws[i + {k}] = '{part}'" for k, part in enumerate(phrase.split()))
    for phrase, label in licenses.PHRASES.items())
_RULES = ", ".join(f"('{label}', {sorted(set(t.split()))!r})" for label, texts in sorted(licenses.TEMPLATES.items()) for t in texts)
OP8 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM documents),
places AS ({_PLACES}),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
         list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split({_LOW}, chr(10))), '{_WORD}')) AS ws FROM documents),
rules AS (SELECT * FROM (VALUES {_RULES}) r(label, template)),
shares AS (SELECT doc_id, label, len(list_intersect(ws, template)) / len(template) AS share FROM blocks, rules
           WHERE len(list_intersect(ws, template)) >= 0.8 * len(template) - 1e-9),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM shares GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM w, range(1, greatest(len(ws) - 3, 2)) r(i)
  WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws,
  row_number() OVER () AS no FROM documents),
w AS (SELECT no, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT no) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN t USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
      1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p
      FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS q
      FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL)
      JOIN (SELECT lang, sum(total)::HUGEINT AS total, max(v) AS v FROM g GROUP BY lang) USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value,
          NULL::BIGINT AS p, NULL::BIGINT AS q
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
                     FROM p x JOIN p y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL) f
          ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
heads AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value, p::BIGINT AS p, q::BIGINT AS q
          FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM heads))
SELECT lang, source, part, item, value, rank, p, q FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: crc32 by its 256 table entries, which follow from its polynomial; computed once per different word.
OP12 = r"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
  lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT no, w, count(*) AS n FROM (SELECT no, unnest(ws) AS w FROM d) GROUP BY ALL),
words AS (SELECT w FROM dw UNION SELECT w FROM b),
hexed AS (SELECT w, hex(encode(w)) AS x FROM words),
bucket AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x) + 1, 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
  lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, crc),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN bucket USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM b JOIN bucket USING (w) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
  / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
sums AS (SELECT no, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM dw JOIN bucket USING (w) JOIN gain USING (bucket) GROUP BY no),
x AS (SELECT no, doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0
  THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
  ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN sums USING (no)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
r AS (SELECT no, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight::BIGINT AS weight, score, CASE WHEN rank <= (10 * n) // 100 THEN rank END AS rank, n_features AS n_words
FROM z LEFT JOIN r USING (no)
"""

OP13 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS no, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST, no)
"""

ORACLES: dict[str, str] = {
    "op5_warc": OP5,
    "op7_line_dedup": OP7,
    "op8_license_scan": OP8,
    "op9_ngram_jaccard": OP9,
    "op11_source_divergence": OP11,
    "op12_importance_resampling": OP12,
    "op13_exact_dedup": OP13,
}
