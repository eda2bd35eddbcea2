"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

#: Pareto order sampling: sorted windows in place of the binned cut.
MIXING = r"""
WITH sizes AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || md5('mix-1:' || coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) AS i FROM by_source),
steps AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, i) AS k,
         coalesce(sum(source_size) OVER (ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY source_size / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
         sum(source_size) OVER () AS total FROM ranked),
level AS (
  SELECT (total * 1.5::DOUBLE - before * 2.0::DOUBLE) / above AS rate FROM steps
  WHERE (total * 1.5::DOUBLE - before * 2.0::DOUBLE) / above * w <= source_size * 2.0::DOUBLE ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size,
         least(source_size * 2.0::DOUBLE, coalesce((SELECT rate FROM level) * w, source_size * 2.0::DOUBLE)) AS target FROM steps),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM targets),
rows AS (
  SELECT s.doc_id, s.source, s.size, s.u, p.source_size, p.target, floor(p.ratio) AS whole, p.ratio - floor(p.ratio) AS part,
         p.target - floor(p.ratio) * p.source_size AS rest
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
valued AS (
  SELECT *, CASE WHEN part > 0 THEN u / (1 - u) / (part / (1 - part)) END AS q FROM rows),
ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM valued)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN part > 0 AND 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""

#: Every 50-byte string by position, the smallest document that it starts in, and the bytes it covers elsewhere.
#: Bytes are handled as pairs of hex digits, since strings are sliced by characters.
PREFIX_FREE = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS p FROM docs) q),
firsts AS (SELECT s, min(doc_id) AS first FROM starts GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, p FROM starts JOIN firsts USING (s) WHERE first < doc_id),
marked AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hits),
runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b
  FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked) q GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k
  FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

#: Every term of every item against every document that holds it.
RANKED = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
asked AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) q),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln(((2 * docs + 2)::DOUBLE) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term), whole),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""

#: Shared shingles of every two different sets, and the documents reachable over links.
SIMILAR_SETS = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM words),
classes AS (SELECT s, min(doc_id) AS u, len(s)::BIGINT AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT u, n, unnest(s) AS x FROM classes),
links AS (
  SELECT a.u AS u, b.u AS v FROM shingles a JOIN shingles b ON a.x = b.x AND a.u < b.u
  GROUP BY a.u, b.u, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT u, u AS v FROM classes UNION SELECT r.u, b.v FROM reach r JOIN ways b ON b.u = r.v),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN least l ON l.u = c.u
"""

#: crc32 by its table of 256 values; near words by the places that a letter is taken from.
SPELLING = r"""
WITH RECURSIVE
steps AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS l FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
own AS (SELECT run, count(*) AS c, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
                                 lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM own, crc),
written AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM written WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
less AS (SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS v FROM (SELECT word, unnest(range(length(word))) AS i FROM words) q),
near AS (
  SELECT DISTINCT word, other FROM (
    SELECT l.word, w.word AS other FROM less l JOIN words w ON w.word = l.v
    UNION ALL SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.v
    UNION ALL SELECT a.word, b.word FROM less a JOIN less b ON a.i = b.i AND a.v = b.v AND a.word <> b.word) q),
best AS (
  SELECT near.word, count(*)::BIGINT AS n_near, first(other ORDER BY n DESC, encode(other)) AS form, max(n) AS form_n
  FROM near JOIN words ON words.word = other GROUP BY near.word),
formed AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed g ON g.word = c.at WHERE g.form IS NULL
"""
