"""SQL (DuckDB) for the queries of this folder that SQL can express."""

_EITHER = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_ASSIGN = "(" + "|".join(map(_EITHER, ("password", "passwd", "secret", "token", "api_?key"))) + ")"

ORACLE = {
    "op1_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op10_url_filters": r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
       WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/'
       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/' END AS rule,
  CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND (path LIKE '/es/%' OR path LIKE '/en/1%') THEN 'block'
       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'block' ELSE 'allow' END AS verdict
FROM p
""",
    "op5_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, len(k) AS size, array_to_string(k, ' ') AS win
  FROM (SELECT item_id, w[s:s + 9] AS k FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0))
), sizes AS (SELECT DISTINCT size FROM iw
), dw AS (
  SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS win
  FROM (SELECT d.*, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)
), hits AS (SELECT doc_id, s, size, item_id FROM dw JOIN iw USING (size, win)
), per AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op12_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list(m ORDER BY turn NULLS FIRST, r, substr(x, 1, 32), m) AS ms, list(length(x) ORDER BY turn NULLS FIRST, r, substr(x, 1, 32), m) AS ls,
         list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
           lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda v, k: xor(v >> 1, (v & 1) * 3988292384), xor(a, b)), 4294967295::BIGINT) AS crc
  FROM t GROUP BY c
), h AS (SELECT *, xor(crc, 4294967295::BIGINT) % 6 AS h FROM own
), built AS (
  SELECT h.c, list_concat(coalesce(b.ms, []), [])[1:h.h] || h.ms[h.h + 1:] AS ms, list_concat(coalesce(b.ls, []), [])[1:h.h] || h.ls[h.h + 1:] AS ls
  FROM h LEFT JOIN own b ON b.c = h.c - h.c % 100
), p AS (SELECT c, ms, ls, unnest(range(0, len(ms) + 1)) AS d FROM built
), n AS (
  SELECT d, array_to_string(ms[1:d], ' ') AS k, CASE WHEN d > 1 THEN array_to_string(ms[1:d - 1], ' ') ELSE '' END AS up, min(c) AS c, count(*) AS n, coalesce(max(ls[d]), 0) AS chars,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(ms) = d), '') AS ends
  FROM p GROUP BY ALL
), s AS (SELECT n.*, (SELECT count(*) FROM n q WHERE q.d = n.d + 1 AND q.up = n.k) AS kids FROM n
), u AS (
  SELECT a.d, a.k, count(*) FILTER (b.kids = 0) AS leaves, sum((b.n - 1) * b.chars) AS saved
  FROM s a JOIN s b ON b.d >= a.d AND (a.d = 0 OR a.k = b.k OR starts_with(b.k, a.k || ' ')) GROUP BY ALL
)
SELECT s.c::BIGINT AS conv_id, s.d::BIGINT AS depth, q.c::BIGINT AS parent_conv_id, s.n::BIGINT AS n_convs, s.kids::BIGINT AS n_children,
       u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(s.ends) AS ends_sha256
FROM s JOIN u ON u.d = s.d AND u.k = s.k LEFT JOIN s q ON s.d > 0 AND q.d = s.d - 1 AND q.k = s.up
""",
    "op9_secret_scan": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), rules(nth, kind, pattern, least) AS (VALUES
  (0, 'assign', '{_ASSIGN}["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8),
  (1, 'access', '(A)(KIA[A-Z0-9]+)', 15),
  (2, 'hex', '([0-9a-f])([0-9a-f]+)', 31)
), m AS (
  SELECT r, t, nth, kind, least, regexp_extract_all(t, pattern, 0) AS m, regexp_extract_all(t, pattern, 2) AS g,
         string_split_regex(t, pattern) AS gaps FROM d, rules
), s AS (
  SELECT r, nth, kind, length(m[i]) AS size, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m) WHERE length(g[i]) >= least
), f AS (
  SELECT r, count(*) FILTER (nth = 0) AS a, count(*) FILTER (nth = 1) AS k, count(*) FILTER (nth = 2) AS h,
         string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, nth) AS spans
  FROM s GROUP BY r
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (r)
""",
    "op6_near_duplicates": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), c(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.reached)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(reached) AS component_id, d.doc_id = min(reached) AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
""",
}
