"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH whole AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM whole),
g AS (SELECT doc_id, pos, string_split_regex(trim(regexp_replace(line, '[\x09-\x0D]', ' ', 'g')), ' +') AS e,
        string_split_regex(trim(regexp_replace(CASE WHEN regexp_matches(line, '[0-9]')
        THEN regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g') ELSE line END,
        '[\x09-\x0D]', ' ', 'g')), ' +') AS g FROM l),
t AS (SELECT doc_id, pos, fits, CASE WHEN fits THEN g ELSE e END AS t FROM (SELECT *, len(list_filter(g, lambda x: x <> '<*>')) >= 3
        AND 2 * len(list_filter(g, lambda x: x <> '<*>')) >= len(g) AS fits FROM g)),
p AS (SELECT doc_id, pos, len(t) AS n, array_to_string(t, ' ') AS line, fits, len(t) || ' ' || array_to_string(t[1:4], ' ') AS leaf,
        list_transform(range(8), lambda i: array_to_string(t[(len(t) * i) // 8 + 1:(len(t) * (i + 1)) // 8], ' ')) AS s
      FROM t WHERE NOT (len(t) = 1 AND t[1] = '')),
d AS (SELECT line, any_value(n) AS n, any_value(fits) AS fits, any_value(leaf) AS leaf, any_value(s) AS s, count(DISTINCT doc_id) AS docs,
        min({'doc': doc_id, 'pos': pos}) AS first, min(doc_id) AS lo, max(doc_id) AS hi FROM p GROUP BY line),
inside AS (SELECT * FROM d WHERE n >= 8 AND fits AND leaf IN (SELECT leaf FROM d WHERE n >= 8 AND fits GROUP BY leaf HAVING count(*) > 1)),
st AS (SELECT leaf, docs, first, unnest(range(8)) AS i, unnest(s) AS s FROM inside),
sums AS (SELECT leaf, i, s, sum(docs) AS docs, min(first) AS first FROM st GROUP BY ALL),
common AS (SELECT leaf, i, arg_min(s, {'d': -docs, 'f': first}) AS c FROM sums GROUP BY leaf, i),
consensus AS (SELECT leaf, list(c ORDER BY i) AS c FROM common GROUP BY leaf),
member AS (SELECT line, leaf AS template FROM inside JOIN consensus USING (leaf)
           WHERE len(list_filter(range(8), lambda i: s[i + 1] <> c[i + 1])) <= 2),
placed AS (SELECT d.*, template FROM d LEFT JOIN member USING (line)),
big AS (SELECT template, min(first) AS first FROM placed WHERE template IS NOT NULL GROUP BY template
        HAVING sum(docs) >= 2 AND min(lo) <> max(hi)),
found AS (SELECT line, first FROM placed WHERE template IS NULL AND n >= 3 AND docs >= CASE WHEN n >= 8 THEN 2 ELSE 10 END
          UNION ALL SELECT line, big.first FROM placed JOIN big USING (template)),
cut AS (SELECT doc_id, pos FROM p JOIN found USING (line) WHERE NOT (doc_id = first.doc AND pos = first.pos)),
done AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE cut.pos IS NULL) AS text,
           count(cut.pos) AS lines_cut, count(*) - count(cut.pos) AS lines_kept
         FROM l LEFT JOIN cut ON l.doc_id = cut.doc_id AND l.pos = cut.pos GROUP BY l.doc_id)
SELECT w.doc_id, CASE WHEN w.text IS NULL THEN NULL ELSE coalesce(done.text, '') END AS text,
  CAST(coalesce(lines_cut, 0) AS INTEGER) AS lines_cut, CAST(coalesce(lines_kept, 0) AS INTEGER) AS lines_kept
FROM whole w LEFT JOIN done ON w.doc_id = done.doc_id
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

# The sixteen numbers are the CRC-32 of half a byte.
RESAMPLING = r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 't', item_id, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
      || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM w),
n AS (SELECT side, r, f, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM n)),
b AS (SELECT f, xor(4294967295, list_reduce(
        list_transform(range(len(h)), lambda i: strpos('0123456789ABCDEF', h[i + 2 - 2 * (i % 2)]) - 1),
        lambda c, x: xor(c >> 4, CAST([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
          3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108] AS BIGINT[])[(xor(c, x) & 15) + 1]),
        4294967295)) % 10000 AS b FROM h),
p AS (SELECT side, r, b, sum(n) AS n FROM n JOIN b USING (f) GROUP BY ALL),
c AS (SELECT b, coalesce(sum(n) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0) AS t FROM p GROUP BY b),
a AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t FROM c),
g AS (SELECT b, CAST(floor(1000 * ln((CAST(c.t AS DOUBLE) + 1) * (a.s + 10000) / ((CAST(c.s AS DOUBLE) + 1) * (a.t + 10000)))) AS BIGINT) AS g FROM c, a),
d AS (SELECT r, sum(n) AS n, sum(n * g) AS weight FROM p JOIN g USING (b) WHERE side = 'd' GROUP BY r),
v AS (SELECT id AS doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || left(sha256('42:' || coalesce(CAST(id AS VARCHAR), '')), 8)
          AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
      FROM w LEFT JOIN d USING (r) WHERE side = 'd'),
k AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k FROM v)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND k <= (SELECT 5 * count(*) // 100 FROM v WHERE words >= 20) THEN k END AS rank FROM k
"""

RANKED_SEARCH = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
a AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(a.n AS DOUBLE) + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS weight
      FROM t, a WHERE term IN (SELECT term FROM i) GROUP BY term, a.n),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * a.n) // a.l AS m FROM d, a WHERE doc_id IS NOT NULL AND len(w) > 0),
s AS (SELECT item_id, m.r, any_value(m.doc_id) AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM i JOIN w USING (term) JOIN t USING (term) JOIN m ON t.r = m.r GROUP BY item_id, m.r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""

SQL: dict[str, str] = {"op1_line_dedup": LINE_DEDUP, "op4_topk": TOP_K, "op12_resampling": RESAMPLING,
                       "op13_ranked_search": RANKED_SEARCH}
