"""DuckDB SQL with the same rows as `sextant.plans.queries`."""

from __future__ import annotations

from sextant.functions.text import STOP_WORDS, stemmed
from sextant.operators import search
from sextant.plans.queries import SEARCHED, WEAK

BLOB = "sha1('blob ' || octet_length(encode(text)) || chr(0) || text)"


def _stem(w: str) -> str:
    return rf"""CASE WHEN NOT regexp_matches({w}, '^[\x00-\x7F]{{2,}}s$') OR regexp_matches({w}, '(us|ss)$') THEN {w}
      WHEN regexp_matches({w}, '[^ae]ies$') THEN regexp_replace({w}, 'ies$', 'y') WHEN regexp_matches({w}, '[iaoe]es$') THEN {w} ELSE regexp_replace({w}, 's$', '') END"""


def _words(source: str, column: str, keep: str) -> str:
    """(keep, word) of each word of `column` of `source`."""
    return rf"""(
  SELECT {keep}, unnest(list_transform(list_concat(p, CASE WHEN len(p) > 1 THEN [array_to_string(p, '')] ELSE [] END), lambda w: {_stem('w')})) AS word FROM (
    SELECT {keep}, list_filter(string_split(lower(regexp_replace(regexp_replace(i, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1_\2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1_\2', 'g')), '_'), lambda x: x <> '') AS p
    FROM (SELECT {keep}, unnest(regexp_extract_all({column}, '[\p{{L}}\p{{N}}_]+')) AS i FROM {source})))"""


def _bm25(query: str) -> str:
    asked = ", ".join(f"'{w}'" for w in search.query_words(query))
    return f"""w AS (SELECT doc_id, word, 1.0 AS weight FROM {_words('documents', 'text', 'doc_id')} UNION ALL SELECT doc_id, word, 5.0 FROM {_words('documents', 'source', 'doc_id')}),
l AS (SELECT d.doc_id, count(w.word) AS len FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id GROUP BY d.doc_id),
c AS (SELECT doc_id, word, sum(weight) AS c FROM w WHERE word IN ({asked}) GROUP BY doc_id, word),
n AS (SELECT count(*) AS n, greatest(avg(len), 1.0) AS mean FROM l),
i AS (SELECT word, ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM c GROUP BY word),
s AS (SELECT c.doc_id, sum(idf * c * 2.2 / (c + 1.2 * (1 - 0.75 + 0.75 * len / (SELECT mean FROM n)))) AS score FROM c JOIN i ON i.word = c.word JOIN l ON l.doc_id = c.doc_id GROUP BY c.doc_id)"""


SPANS = "(SELECT o_orderkey AS id, o_orderkey // 256 AS file, o_orderkey % 256 AS start, o_orderkey % 256 + floor(o_totalprice % 40)::BIGINT AS end_ FROM orders)"
EDGES = "(SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


def _pagerank(jump: str, steps: int = 6) -> str:
    out = f"""WITH e AS MATERIALIZED (SELECT c_nationkey AS src, (o_orderkey % 25)::INT AS dst, CASE WHEN count(*) > 1 THEN sqrt(count(*)) ELSE 1.0 END AS w FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_nationkey <> o_orderkey % 25 GROUP BY ALL),
p AS MATERIALIZED (SELECT src, dst, w / greatest(sum(w) OVER (PARTITION BY src), 1.0) AS part FROM e),
s0 AS MATERIALIZED (SELECT n_nationkey AS id, {jump} AS jump, {jump} AS share FROM nation)"""
    for k in range(1, steps + 1):
        out += f""",
i{k} AS MATERIALIZED (SELECT s.id, s.jump, coalesce(sum(0.85 * p.part * b.share), 0) AS got FROM s{k - 1} s LEFT JOIN p ON p.dst = s.id LEFT JOIN s{k - 1} b ON b.id = p.src GROUP BY s.id, s.jump),
s{k} AS MATERIALIZED (SELECT id, jump, got + (1 - (SELECT sum(got) FROM i{k})) * jump AS share FROM i{k})"""
    return out + f" SELECT id, round(share, 6) AS share FROM s{steps}"


STOPS = ", ".join(f"'{w}'" for w in sorted({stemmed(w) for w in STOP_WORDS}))

SQL: dict[str, str] = {
    "bm25_search": f"WITH {_bm25(SEARCHED)} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20",
    "content_dedup": f"SELECT {BLOB} AS blob, min(doc_id) AS first_doc, count(*) AS holders FROM documents GROUP BY 1",
    "incremental_check": f"""WITH r AS (SELECT doc_id, {BLOB} AS blob FROM documents), o AS (SELECT * FROM r WHERE doc_id % 10 <> 0),
      n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN sha1(blob) ELSE blob END AS blob FROM r WHERE doc_id % 10 <> 1)
      SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'gone' WHEN o.blob <> n.blob THEN 'changed' ELSE 'same' END AS status FROM o FULL JOIN n ON o.doc_id = n.doc_id""",
    "worktree_digest": f"SELECT lang, sha1(string_agg(doc_id::VARCHAR || chr(0) || {BLOB} || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY lang",
    "tokenize_words": f"SELECT word, count(*) AS n FROM {_words('documents', 'text', 'doc_id')} GROUP BY word",
    "search_gate": f"""WITH a AS (WITH {_bm25(SEARCHED)} SELECT '{SEARCHED}' AS query, count(*) AS holding, true AS answered FROM s),
      b AS (WITH {_bm25(WEAK)}, best AS (SELECT doc_id FROM s ORDER BY score DESC, doc_id LIMIT 1), held AS (SELECT word FROM c WHERE doc_id = (SELECT doc_id FROM best)),
      g AS (SELECT coalesce(sum(idf), 0) AS got, count(*) AS k FROM i WHERE word IN (SELECT word FROM held)), f AS (SELECT sum(idf) AS known FROM i)
      SELECT '{WEAK}' AS query, (SELECT count(*) FROM s) AS holding, (SELECT k >= 2 OR got >= least(ln(1 + ((SELECT n FROM n) - 0.5) / 1.5), (SELECT known FROM f) + (2 - (SELECT count(*) FROM i)) * ln(1 + ((SELECT n FROM n) + 0.5) / 0.5)) - 1e-9 FROM g) AS answered)
      SELECT * FROM a UNION ALL SELECT * FROM b""",
    "stop_word_share": f"SELECT lang, count(*) AS words, sum((word IN ({STOPS}))::BIGINT)::BIGINT AS stops FROM {_words('documents', 'text', 'lang')} GROUP BY lang",
    "language_of": """SELECT CASE ext WHEN 'rs' THEN 'rust' WHEN 'nix' THEN 'nix' WHEN 'sh' THEN 'bash' WHEN 'py' THEN 'python' WHEN 'h' THEN 'c' WHEN 'md' THEN 'markdown' END AS language, count(*) AS files
      FROM (SELECT ['rs', 'nix', 'sh', 'py', 'h', 'md', 'txt', 'C'][(p_partkey % 8 + 1)::INT] AS ext FROM part) GROUP BY 1""",
    "nearest_names": """SELECT p_partkey, p_name, CASE WHEN contains(lower(p_name), 'forest gren') OR contains('forest gren', lower(p_name)) THEN 0 ELSE levenshtein(lower(p_name), 'forest gren') END::INT AS distance
      FROM part ORDER BY distance, length(p_name), p_partkey LIMIT 8""",
    "heading_slugs": r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6]>(.*?)</h[1-6]>', 1)) AS heading, unnest(range(0, len(regexp_extract_all(html, '<h[1-6]>(.*?)</h[1-6]>', 1))))::INT AS "at" FROM pages),
      b AS (SELECT page_id, "at", replace(regexp_replace(lower(heading), '[^\p{L}\p{M}\p{Nd}\p{Pc}\- ]', '', 'g'), ' ', '-') AS base FROM h),
      n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id, "at") - 1 AS nth FROM b) SELECT page_id, "at", CASE WHEN nth = 0 THEN base ELSE base || '-' || nth END AS anchor FROM n""",
    "first_sentence": r"""WITH l AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)), '^\n+', '') AS t FROM documents),
      p AS (SELECT doc_id, replace(regexp_replace(string_split(t, chr(10) || chr(10))[1], '\n$', ''), chr(10), ' ') AS t FROM l),
      s AS (SELECT doc_id, CASE WHEN regexp_extract(t, '^(.*?\S\.) ', 1) = '' THEN t ELSE regexp_extract(t, '^(.*?\S\.) ', 1) END AS s FROM p)
      SELECT doc_id, CASE WHEN s = '' THEN NULL WHEN length(s) > 200 THEN s[1:200] || '…' ELSE s END AS sentence FROM s""",
    "link_edges": r"""SELECT page_id, regexp_replace(h, '^([^#?]*)\?[^#]*', '\1') AS target, count(*) AS n FROM (SELECT page_id, trim(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS h FROM pages)
      WHERE NOT regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT starts_with(h, '//') AND h NOT IN ('', '#') GROUP BY ALL""",
    "resolve_tiers": """WITH s AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey), c AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
      h AS (SELECT c_custkey, 1 AS tier, s_suppkey FROM c JOIN s ON s_nationkey = c_nationkey UNION ALL SELECT c_custkey, 2, s_suppkey FROM c JOIN s USING (n_regionkey)),
      f AS (SELECT *, min(tier) OVER (PARTITION BY c_custkey) AS best FROM h), g AS (SELECT c_custkey, any_value(tier) AS tier, list(DISTINCT s_suppkey ORDER BY s_suppkey) AS t FROM f WHERE tier = best GROUP BY c_custkey)
      SELECT c.c_custkey, CASE WHEN t IS NULL THEN 'external' WHEN len(t) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN len(t) = 1 THEN CASE tier WHEN 1 THEN 'module' ELSE 'unique' END ELSE '' END AS rule,
        coalesce(len(t), 0)::BIGINT AS n, coalesce(array_to_string(t, ','), '') AS targets FROM c LEFT JOIN g USING (c_custkey)""",
    "nearest_scope": r"""WITH p AS (SELECT page_id, regexp_extract(url, '//([^?#]*)', 1) AS path FROM pages),
      f AS (SELECT page_id, array_to_string(string_split(path, '/')[1:k], '/') AS root FROM (SELECT *, unnest(range(1, greatest(len(string_split(path, '/')), 2))) AS k FROM p)),
      r AS (SELECT root FROM f WHERE root <> '' GROUP BY root HAVING count(*) > 2)
      SELECT page_id, coalesce(max_by(root, length(root)), '') AS root FROM p LEFT JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY page_id""",
    "point_in_interval": f"""WITH h AS (SELECT event_id, arg_max(id, (start, -end_, -id)) AS id FROM (SELECT event_id, event_id // 64 AS file, event_id * 7 % 256 AS line FROM events) e JOIN {SPANS} s ON s.file = e.file AND start <= line AND line <= end_ GROUP BY event_id)
      SELECT e.event_id, coalesce(h.id, -1) AS span FROM events e LEFT JOIN h ON h.event_id = e.event_id""",
    "hunk_overlap": f"""SELECT id, sum(least(at_ + n - 1, end_) - greatest(at_, start) + 1)::BIGINT AS lines, count(*) AS hunks FROM (SELECT l_orderkey // 256 AS file, l_orderkey * 3 % 256 AS at_, floor(l_quantity % 9)::BIGINT AS n FROM lineitem) h
      JOIN {SPANS} s ON s.file = h.file AND n > 0 AND at_ <= end_ AND start <= at_ + n - 1 GROUP BY id""",
    "callers_group": """SELECT target, caller, string_agg(how || ' ' || line, '; ' ORDER BY how, line) AS uses FROM (SELECT DISTINCT l_partkey AS target, l_suppkey AS caller, lower(l_returnflag) AS how, l_orderkey % 100 AS line FROM lineitem) GROUP BY ALL""",
    "callees_group": """SELECT l_suppkey AS caller, count(DISTINCT l_partkey) AS targets, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_partkey END) AS sure, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS possible FROM lineitem GROUP BY 1""",
    "impact_levels": f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM {EDGES}), r AS (SELECT 1::BIGINT AS id, 0 AS level UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.id WHERE r.level < 3) SELECT id, min(level)::INT AS level FROM r GROUP BY id""",
    "include_closure": """WITH RECURSIVE e AS (SELECT n_nationkey AS src, n_nationkey // 2 AS dst FROM nation UNION SELECT n_nationkey, n_nationkey - 5 FROM nation WHERE n_nationkey >= 5),
      r AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst WHERE r.src <> e.dst) SELECT src, dst FROM r""",
    "graph_weights": """SELECT src, dst, round(sum(w), 6) AS w FROM (SELECT c_nationkey AS src, (o_orderkey % 25)::INT AS dst, CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus = 'O' AND NOT starts_with(o_orderpriority, '1') THEN (0.1::DOUBLE) / 4 ELSE 0.0 END::DOUBLE AS w
      FROM orders JOIN customer ON o_custkey = c_custkey) WHERE src <> dst AND w > 0 GROUP BY src, dst""",
    "pagerank_uniform": _pagerank("1.0::DOUBLE / 25"),
    "pagerank_focus": _pagerank("CASE WHEN n_nationkey IN (3, 7) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"),
    "map_by_file": """WITH p AS (SELECT *, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier), b AS (SELECT *, min(place) OVER (PARTITION BY s_nationkey) AS best FROM p)
      SELECT s_nationkey, s_suppkey, row_number() OVER (ORDER BY best, place) AS nth FROM b""",
    "budget_cut": """WITH r AS (SELECT lang, doc_id AS ord, octet_length(encode(source))::BIGINT AS size, (doc_id % 5) * 100000 - least(n_chars, 99999) AS rank FROM documents),
      c AS (SELECT *, sum(size + 1) OVER (PARTITION BY lang ORDER BY rank DESC, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM r) SELECT lang, ord, rank, cum FROM c WHERE cum <= 240""",
    "outline_nesting": """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), s AS (SELECT conv_id, min(turn) * 10 AS a, max(turn) * 10 + 9 AS b, 0::BIGINT AS id FROM t GROUP BY conv_id
      UNION ALL SELECT conv_id, turn * 10 + 1, turn * 10 + 8, turn + 1000 FROM t UNION ALL SELECT conv_id, turn * 10 + 3, turn * 10 + 5, turn + 100000 FROM t)
      SELECT x.conv_id, x.id, count(y.id) AS depth FROM s x LEFT JOIN s y ON y.conv_id = x.conv_id AND y.id <> x.id AND y.a <= x.a AND x.b <= y.b GROUP BY x.conv_id, x.id""",
    "section_extent": """WITH t AS (SELECT conv_id, turn, min(CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END) AS level FROM conversations GROUP BY ALL)
      SELECT a.conv_id, a.turn, coalesce(min(b.turn) - 1, (SELECT max(turn) FROM t c WHERE c.conv_id = a.conv_id)) AS until FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.turn > a.turn AND b.level <= a.level GROUP BY a.conv_id, a.turn""",
    "duplicate_numbering": "SELECT p_partkey, p_type || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part)",
    "trailer_join": "SELECT event_id AS rev FROM events WHERE event_type = 'click' AND (json_extract_string(props, '$.k') = '17' OR event_id % 50 = 17)",
    "touched_rollup": """WITH s AS (SELECT user_id AS path, event_type AS qualified, sum(floor(value)::BIGINT)::BIGINT AS added, sum(event_id % 7)::BIGINT AS removed, count(*) AS commits, min(event_id) AS first FROM events GROUP BY ALL)
      SELECT *, row_number() OVER (ORDER BY added + removed DESC, first, path, qualified) AS nth FROM s""",
    "rename_follow": """WITH RECURSIVE r AS (SELECT p_partkey AS start, p_partkey AS k, -1::BIGINT AS from_ FROM part UNION ALL SELECT start, k // 2, 1099511627776 - k FROM r WHERE k > 1)
      SELECT 'f' || start AS start, 'f' || k AS path, from_ AS "from", CASE WHEN k > 1 THEN 1099511627776 - k ELSE -1 END AS until FROM r""",
    "condition_3vl": """WITH x AS (SELECT d.doc_id, quality = 1 AS a, CASE WHEN d.doc_id % 3 <> 0 THEN toxic = 1 END AS b FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
      SELECT doc_id, coalesce(CASE WHEN a AND b THEN 'true' WHEN NOT (a AND b) THEN 'false' END, 'unknown') AS "both", coalesce(CASE WHEN a OR b THEN 'true' WHEN NOT (a OR b) THEN 'false' END, 'unknown') AS either,
        coalesce(CASE WHEN NOT a THEN 'true' WHEN a THEN 'false' END, 'unknown') AS not_a FROM x""",
}
