"""SQL whose rows equal those of the registered queries, written from the contracts and not from the operators."""

# A candidate's owner is its source, null being one owner, its repository the language within the source.
OP1 = r"""
WITH docs AS (
  SELECT doc_id, source, lang, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
kinds(rank, kind, pattern) AS (VALUES
  (0, 'assign', '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']? *[:=] *["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]{16,}'), (2, 'hex', '[0-9a-f]{24,}'), (3, 'owned', '[A-Za-z0-9+/_=-]{20,}')),
matched AS (
  SELECT r, rank, kind, pattern, regexp_extract_all(t, pattern) AS whole, string_split_regex(t, pattern) AS before
  FROM docs, kinds WHERE regexp_matches(t, pattern)),
pieces AS (
  SELECT r, rank, kind, unnest(whole) AS whole, unnest(before[1:len(whole)]) AS before, generate_subscripts(whole, 1) AS i FROM matched),
ends AS (
  SELECT *, CAST(sum(length(before) + length(whole)) OVER (PARTITION BY r, rank ORDER BY i) AS BIGINT) AS stop FROM pieces),
spans AS (
  SELECT r, rank, kind, stop - length(whole) AS start, stop,
         CASE WHEN rank = 0 THEN regexp_extract(whole, '^[A-Za-z_]+["'']? *[:=] *["'']?(.*)$', 1) ELSE whole END AS value
  FROM ends),
base AS (SELECT * FROM spans WHERE rank IN (1, 2) OR (rank = 0 AND length(value) >= 6)),
opaque AS (
  SELECT * FROM spans o
  WHERE rank = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = o.r AND b.start < o.stop AND o.start < b.stop)),
held AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
spread AS (
  SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners,
         count(DISTINCT coalesce(source, chr(0)) || chr(1) || concat_ws('/', source, lang)) AS repositories,
         len(list_distinct(string_split(value, ''))) >= 8
           AND NOT regexp_matches(value, '(?i)(example|sample|dummy|changeme|placeholder|your|xxxx|1234567)') AS random
  FROM held JOIN docs USING (r) GROUP BY value),
known AS (
  SELECT h.*, owners >= 3 OR repositories >= 4 AS copied, owners < 3 AND repositories < 4 AND random AS live
  FROM held h JOIN spread USING (value)),
counts AS (
  SELECT r, count(DISTINCT value) FILTER (live) AS n_live, count(DISTINCT value) FILTER (copied) AS n_copied,
         count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base_list,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3 OR live) AS span_list
  FROM known GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_list, '')) AS base_sha256, coalesce(span_list, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs LEFT JOIN counts USING (r)"""

# A run of words is known by the SHA-256 of its text.
OP2 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS words FROM documents),
placed AS (
  SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i, words AS ws FROM docs),
starts AS (
  SELECT r, i, w, CASE WHEN i + 34 <= len(ws) THEN sha256(array_to_string(ws[i:i + 34], ' ')) END AS run FROM placed),
judged AS (SELECT r, i, w, run IS NOT NULL AND count(*) OVER (PARTITION BY run) > 1 AS again FROM starts),
marked AS (
  SELECT r, i, w, max(CAST(again AS INTEGER)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone
  FROM judged),
texts AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN texts USING (r)"""

# Equal sets are one; all sets that share a shingle are compared; links are followed to a fixed point.
OP3 = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS words
  FROM documents),
shingled AS (
  SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS shingles FROM docs),
sets AS (SELECT list_sort(shingles) AS shingles, min(r) AS s FROM shingled WHERE len(shingles) > 0 GROUP BY list_sort(shingles)),
parts AS (SELECT s, len(shingles) AS n, hash(unnest(shingles)) AS h FROM sets),
pairs AS (
  SELECT a.s AS a, b.s AS b FROM parts a JOIN parts b ON a.h = b.h AND a.s < b.s AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.s, b.s, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reached(s, t) AS (SELECT s, s FROM sets UNION SELECT q.s, e.b FROM reached q JOIN edges e ON q.t = e.a),
members AS (SELECT k.s, d.doc_id FROM shingled d JOIN sets k ON list_sort(d.shingles) = k.shingles),
least_of AS (SELECT s, min(doc_id) AS doc_id FROM members GROUP BY s),
roots AS (SELECT q.s, min(l.doc_id) AS component_id FROM reached q JOIN least_of l ON l.s = q.t GROUP BY q.s)
SELECT d.doc_id, CAST(len(d.shingles) AS BIGINT) AS n_shingles, coalesce(o.component_id, d.doc_id) AS component_id,
       coalesce(d.doc_id = coalesce(o.component_id, d.doc_id), false) AS kept
FROM shingled d LEFT JOIN sets k ON list_sort(d.shingles) = k.shingles AND len(d.shingles) > 0 LEFT JOIN roots o ON o.s = k.s"""

# All documents and items that share a shingle.
OP5 = r"""
WITH texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, text FROM documents
  UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM benchmark),
cut AS (
  SELECT side, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^ \t-\r]+') AS words FROM texts),
shingled AS (
  SELECT side, r, id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM cut),
items AS (SELECT r, id, CAST(len(shingles) AS BIGINT) AS n_item, unnest(shingles) AS s FROM shingled WHERE side = 'i'),
docs AS (SELECT r, id, unnest(shingles) AS s FROM shingled WHERE side = 'd')
SELECT any_value(d.id) AS doc_id, any_value(i.id) AS item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM docs d JOIN items i USING (s) GROUP BY d.r, i.r, n_item HAVING 100 * count(*) >= 80 * n_item"""

# Distances in ten thousandths (sums of doubles differ in their last bits), -1 where there are none.
OP6 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT *, regexp_extract_all(t, '[^ \t-\r]+') AS words,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \t-\r]')) AS lines FROM docs),
sized AS (
  SELECT *, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS upper_n,
         length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digit_n,
         length(t) - length(regexp_replace(t, '[\p{P}\p{S}]', '', 'g')) AS mark_n
  FROM cut),
placed AS (SELECT r, lang, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM sized),
windows AS (SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM placed WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM windows WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, w, w2, w3) > 1),
repeats AS (SELECT r, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat_words
            FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
base AS (
  SELECT s.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM sized s LEFT JOIN repeats USING (r)),
word_counts AS (
  SELECT lang, w, count(*) AS n, sum(length(w)) AS chars FROM placed WHERE lang IS NOT NULL GROUP BY lang, w),
totals AS (SELECT lang, sum(n) AS n, sum(chars) AS chars FROM word_counts GROUP BY lang HAVING sum(n) >= 10000),
common AS (
  SELECT lang, w, n / total AS q FROM (
    SELECT c.lang, c.w, c.n, t.n AS total, row_number() OVER (PARTITION BY c.lang ORDER BY c.n DESC, c.w) AS k
    FROM word_counts c JOIN totals t USING (lang) WHERE length(c.w) <= 5) WHERE k <= 30),
classes AS (
  SELECT lang, [(max(t.chars) - sum(upper_n) - sum(digit_n) - sum(mark_n)) / max(t.chars), sum(upper_n) / max(t.chars),
                sum(digit_n) / max(t.chars), sum(mark_n) / max(t.chars)] AS q
  FROM sized JOIN totals t USING (lang) GROUP BY lang),
long AS (SELECT * FROM base WHERE n_words >= 50),
refs AS (SELECT l.r, l.n_words, c.lang AS ref FROM long l JOIN classes c ON l.lang = c.lang
         UNION ALL
         SELECT l.r, l.n_words, c.lang FROM long l, classes c
         WHERE l.lang IS NULL OR l.lang NOT IN (SELECT lang FROM classes)),
own AS (SELECT r, w, count(*) AS n FROM placed WHERE w IN (SELECT w FROM common) GROUP BY r, w),
pairs AS (
  SELECT f.r, f.ref, coalesce(o.n, 0) / f.n_words AS p, c.q
  FROM refs f JOIN common c ON c.lang = f.ref LEFT JOIN own o ON o.r = f.r AND o.w = c.w),
all_pairs AS (
  SELECT r, ref, 'w' AS side, p, q FROM pairs
  UNION ALL SELECT r, ref, 'w', 1 - sum(p), 1 - sum(q) FROM pairs GROUP BY r, ref
  UNION ALL
  SELECT f.r, f.ref, 'c', unnest([l.word_chars - upper_n - digit_n - mark_n, upper_n, digit_n, mark_n]) / l.word_chars, unnest(c.q)
  FROM refs f JOIN long l ON l.r = f.r JOIN classes c ON c.lang = f.ref),
distances AS (
  SELECT r, ref, side, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
                                       + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS d
  FROM all_pairs GROUP BY r, ref, side),
both_sides AS (SELECT r, ref, max(d) FILTER (side = 'c') AS dc, max(d) FILTER (side = 'w') AS dw FROM distances GROUP BY r, ref),
nearest AS (SELECT * FROM both_sides QUALIFY row_number() OVER (PARTITION BY r ORDER BY dc + dw, dc, dw) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(dc > 0.3 OR dw > 0.45, false) AS kept,
       coalesce(CAST(round(dc * 10000) AS BIGINT), -1) AS char_distance, coalesce(CAST(round(dw * 10000) AS BIGINT), -1) AS word_distance
FROM base LEFT JOIN nearest USING (r)"""

# CRC-32 bit by bit: the character codes of the decimal id, each followed by eight shifts (-1).
OP13 = r"""
WITH RECURSIVE
docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text,
         list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
           lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
  FROM documents),
hashed AS (
  SELECT r, doc_id, source, sha256(head || body) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN
           sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))
           ELSE sha256(head || body) END AS altered
  FROM (SELECT *, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
                  || coalesce(octet_length(encode(source)) || ':' || source, '-')
                  || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
                  || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
               coalesce(octet_length(encode(text)) || ':' || text, '-') AS body FROM docs)),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS n
  FROM hashed),
nodes(level, source, idx, n, h) AS (
  SELECT 0, source, idx, n, leaf FROM leaves
  UNION ALL
  SELECT level + 1, source, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1
  GROUP BY level, source, idx // 16, n),
subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
crown(level, idx, n, h) AS (
  SELECT 0, idx, n, h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM crown WHERE n > 1 GROUP BY level, idx // 16, n),
steps AS (
  SELECT l.r, a.level, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM leaves l
  JOIN nodes a ON a.source IS NOT DISTINCT FROM l.source AND a.n > 1 AND a.idx = l.idx // CAST(16 ** a.level AS BIGINT)
  JOIN nodes b ON b.source IS NOT DISTINCT FROM a.source AND b.level = a.level AND b.idx // 16 = a.idx // 16
  GROUP BY l.r, a.level, a.idx
  UNION ALL
  SELECT l.r, 100 + a.level, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), ''),
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '')
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
  JOIN crown a ON a.n > 1 AND a.idx = s.idx // CAST(16 ** a.level AS BIGINT)
  JOIN crown b ON b.level = a.level AND b.idx // 16 = a.idx // 16
  GROUP BY l.r, a.level, a.idx),
paths AS (
  SELECT r, string_agg(before || after, '' ORDER BY level) AS proof,
         list({'before': before, 'after': after} ORDER BY level) AS path FROM steps GROUP BY r),
folds(r, i, path, h) AS (
  SELECT l.r, 1, p.path, l.altered FROM leaves l LEFT JOIN paths p ON p.r = l.r
  UNION ALL
  SELECT r, i + 1, path, sha256(path[i].before || h || path[i].after) FROM folds WHERE i <= len(path)),
found AS (
  SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM crown WHERE n = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.h AS folded_root
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN paths p ON p.r = l.r
  JOIN folds f ON f.r = l.r AND f.i = coalesce(len(p.path), 0) + 1)
SELECT *, folded_root = root AS verified FROM found"""
