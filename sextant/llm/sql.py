"""DuckDB SQL with the same rows as the queries of `sextant.llm.queries`."""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"[^\x20\x09-\x0D]+"

OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, hash(unnest(s)) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS x, a AS y FROM u UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM n LEFT JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) ON x = doc_id
"""

OP8 = rf"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORDS}'), []) AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM v),
c AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM k JOIN c USING (k)),
r AS (SELECT doc_id, list(j) AS j FROM h GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(j), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN j IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(j, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + 9], ' ') AS k
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT l FROM p),
v AS (SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS i, w FROM d, l WHERE len(w) >= l),
m AS (SELECT doc_id, item_id, i, p.l FROM (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS k FROM v) x JOIN p ON p.k = x.k AND p.l = x.l),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP1 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
sc AS (SELECT vec_id, list_transform(x, lambda y: y / list_max(list_transform(x, lambda z: abs(z)))) AS x FROM v
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
ok AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS n FROM sc),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS x, a AS y FROM u UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y),
m AS (SELECT x, min(y) AS m FROM r GROUP BY x),
d AS (SELECT a, count(*) AS n FROM u GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(m.m, v.vec_id) AS component_id, v.vec_id = coalesce(m.m, v.vec_id) AS kept
FROM v LEFT JOIN m ON m.x = v.vec_id LEFT JOIN d ON d.a = v.vec_id
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size, md5('4:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source),
w AS (SELECT source, size, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight, size * 3.0::DOUBLE AS most FROM s),
b AS (SELECT *, most / weight AS per, sum(size) OVER () AS total, sum(weight) OVER () AS weights,
        coalesce(sum(most) OVER o, 0) AS most_before, coalesce(sum(weight) OVER o, 0) AS weight_before
      FROM w WINDOW o AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - most_before) / (weights - weight_before) AS level FROM b),
f AS (SELECT arg_min(level, (per, source IS NULL, source)) AS level FROM v WHERE per >= level),
t AS (SELECT source, size, CASE WHEN (SELECT level FROM f) IS NULL THEN most ELSE least(most, (SELECT level FROM f) * weight) END AS target, total FROM v),
q AS (SELECT source, target / (2 * k + 1) AS q, k, floor(total / 32.0 + 0.5) AS seats
      FROM (SELECT *, unnest(range(0, (target / 32)::BIGINT + 50)) AS k FROM t WHERE target > 0)),
n AS (SELECT source, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY q DESC, source IS NULL, source, k) AS r FROM q) WHERE r <= seats GROUP BY source),
p AS (SELECT t.source, t.size, t.target, least(coalesce(quota, 0), 3 * ceil(t.size / 32.0))::BIGINT AS quota, ceil(t.size / 32.0)::BIGINT AS n_blocks
      FROM t LEFT JOIN n ON n.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, list_transform(range(1, 13), lambda r: md5('4:' || r || ':' || coalesce(source, '') || CASE WHEN source IS NULL THEN ':' ELSE '' END)) AS md FROM p WHERE n_blocks > 0),
e AS (SELECT source, n_blocks, quota // n_blocks AS rounds, quota % n_blocks AS extra, list_transform(md, lambda x: ('0x' || x[1:12])::BIGINT % n_blocks) AS k, list_transform(md, lambda x: ('0x' || x[13:19])::BIGINT + 1) AS a,
        list_transform(md, lambda x: ('0x' || x[20:26])::BIGINT) AS c, list_transform(md, lambda x: ('0x' || x[27:32])::BIGINT) AS b FROM m),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d),
j AS (SELECT o.doc_id, o.size, o.pos, e.rounds, e.extra, e.k, e.a, e.b, e.c, e.n_blocks AS n, CASE WHEN o.size > 0 THEN range(o.pos // 32, (o.pos + o.size - 1) // 32 + 1) ELSE [] END AS js, o.source
      FROM o LEFT JOIN e ON e.source IS NOT DISTINCT FROM o.source)
SELECT j.doc_id, j.size, p.size AS source_size, p.target,
  (coalesce(rounds, 0) * j.size + coalesce(list_sum(list_transform(list_filter(js, lambda y: list_reduce(range(1, 13), lambda x, r:
      CASE WHEN (greatest(x, (k[r] - x + n) % n) % 2147483647 * a[r] + greatest(x, (k[r] - x + n) % n) // 2147483647 * c[r] + b[r]) % 2147483647 % 2 = 1 THEN (k[r] - x + n) % n ELSE x END, y) < extra),
    lambda y: least((y + 1) * 32, pos + j.size) - greatest(y * 32, pos))), 0))::BIGINT AS taken
FROM j JOIN p ON p.source IS NOT DISTINCT FROM j.source
"""

OP7 = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p),
u AS (SELECT *, regexp_matches(coalesce(url, ''), '^([A-Za-z][A-Za-z0-9_+.\-]*:)?//') AS full_ FROM g),
v AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(CASE WHEN full_ THEN regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9_+.\-]*:)?//([^/?#]*)', 1) ELSE '' END, '^.*@', '')), '^www\.', ''), ':(80|443)?$', '') AS host,
  CASE WHEN full_ THEN regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9_+.\-]*:)?//[^/?#]*([^#]*)', 1) ELSE split_part(coalesce(url, ''), '#', 1) END AS rest FROM u),
k AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || lower(CASE WHEN rest = '' THEN '/' ELSE rest END) AS url_key, strftime(make_timestamp((946684800 + page_id) * 1000000), '%Y%m%d%H%M%S') AS captured FROM v)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url_key, captured,
  row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS nth, row_number() OVER (PARTITION BY url_key ORDER BY captured, page_id) - 1 AS place
FROM k
"""

OP3 = rf"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS at_ FROM documents),
t AS (SELECT doc_id, at_, list_transform(regexp_extract_all(line, '{WORDS}'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM l),
f AS MATERIALIZED (SELECT doc_id, at_, t, concat_ws(' ', len(t)::VARCHAR, array_to_string(t[1:3], ' ')) AS leaf FROM t WHERE len(t) > 0),
r AS (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT doc_id) >= 3),
n AS MATERIALIZED (SELECT leaf, t, count(DISTINCT doc_id) AS n FROM f JOIN r USING (leaf) GROUP BY leaf, t),
z AS (SELECT leaf, t, n, NULL::VARCHAR[] AS tmpl, 0 AS step FROM n
  UNION ALL SELECT leaf, t, n, CASE WHEN len(list_filter(range(1, len(t) + 1), lambda i: t[i] = head[i])) >= len(t) * 0.7 THEN head END, step + 1
  FROM (SELECT leaf, t, n, step, arg_max(t, (n, array_to_string(t, ' '))) OVER (PARTITION BY leaf) AS head, sum(n) OVER (PARTITION BY leaf) AS left_ FROM z WHERE tmpl IS NULL) WHERE left_ >= 3),
x AS (SELECT f.doc_id, f.at_, z.leaf, z.tmpl FROM f JOIN z ON z.leaf = f.leaf AND f.t = z.t WHERE z.tmpl IS NOT NULL),
c AS (SELECT leaf, tmpl FROM x GROUP BY leaf, tmpl HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT doc_id, list(at_) AS gone FROM x JOIN c ON c.leaf = x.leaf AND c.tmpl = x.tmpl GROUP BY doc_id),
d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ls ELSE list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]) END, chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

SQL = {"op1_embedding_dedup": OP1, "op3_line_dedup": OP3, "op4_source_mixing": OP4, "op7_warc": OP7, "op6_minhash_dedup": OP6, "op8_substring_dedup": OP8, "op10_decontamination": OP10}
