"""Operators on names, paths, catalogs, history and conditions as queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import conditions, text
from sextant.operators import graph, history, intervals, render, search, store
from sextant.resolve import places

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def registered(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return registered


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def one_of(values: list[str | None], key: Column) -> Column:
    """The value that a key's remainder picks."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def picked(values: list[str | None], key: str) -> str:
    """`one_of` in SQL."""
    told = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{told}][({key} % {len(values)} + 1)::INT]"


# Names and paths.

PATHS = ["src/store.rs", "tests/cli.rs", "a/test/x.py", "pkg/test_shop.py", "web/__tests__/a.md", "conftest.py", "lib/latest.py", "c/list_tests.c", "go/list-test.x.c", "src/contest.rs", "testing/a.rs", "tests.nix"]


@query(f"""SELECT p_partkey, path, regexp_matches(path, '(^|/)(tests|test|__tests__)/') OR regexp_matches(stem, '^(conftest|tests|test)$') OR regexp_matches(stem, '^test[_-]') OR regexp_matches(stem, '([_-]test|_tests)$') AS test
  FROM (SELECT *, string_split(string_split(path, '/')[-1], '.')[1] AS stem FROM (SELECT p_partkey, {picked(PATHS, "p_partkey")} AS path FROM part))""")
def test_code(spark: SparkSession, d: str) -> DataFrame:
    """Which paths are of test code."""
    return table(spark, d, "part").select("p_partkey", one_of(PATHS, F.col("p_partkey")).alias("path")).select("p_partkey", "path", text.test_file("path").alias("test"))


PYTHON = ["pkg/__init__.py", "pkg/shop.py", "__init__.py", "a/b/c.pyi", "setup.py", "pkg/sub/__init__.py", "x__init__.py"]


@query(f"""SELECT p_partkey, path, replace(CASE WHEN bare = '__init__' THEN '' WHEN ends_with(bare, '/__init__') THEN bare[:len(bare) - 9] ELSE bare END, '/', '.') AS module
  FROM (SELECT *, regexp_replace(path, '[.]pyi?$', '') AS bare FROM (SELECT p_partkey, {picked(PYTHON, "p_partkey")} AS path FROM part))""")
def module_names(spark: SparkSession, d: str) -> DataFrame:
    """Python modules of files."""
    return table(spark, d, "part").select("p_partkey", one_of(PYTHON, F.col("p_partkey")).alias("path")).select("p_partkey", "path", text.module_name("path").alias("module"))


RUST = ["src/lib.rs", "src/main.rs", "src/a/b.rs", "src/a/mod.rs", "src/bin/tool.rs", "src/bin/big/main.rs", "tests/it.rs", "tests/it/common.rs", "examples/x.rs"]
CRATES = ["", "", "", "", ":bin/tool", ":bin/big", ":tests/it", ":tests/it", ":examples/x"]
MODULES = ["", "", "a::b", "a", "", "", "", "common", ""]


@query(f"""WITH f AS (SELECT DISTINCT 'k' || p_partkey % 40 AS package, {picked(RUST, "p_partkey")} AS tail, {picked(CRATES, "p_partkey")} AS crate, {picked(MODULES, "p_partkey")} AS module FROM part), l AS (SELECT DISTINCT package AS library FROM f WHERE tail = 'src/lib.rs')
  SELECT package || '/' || tail AS path, package || CASE WHEN tail = 'src/main.rs' AND library IS NOT NULL THEN ':main' ELSE crate END AS crate, module FROM f LEFT JOIN l ON library = package""")
def crate_layout(spark: SparkSession, d: str) -> DataFrame:
    """Crates and modules of Rust files by Cargo's layout."""
    key = F.col("p_partkey")
    paths = table(spark, d, "part").select(F.concat(F.lit("k"), (key % 40).cast("string"), F.lit("/"), one_of(RUST, key)).alias("path")).distinct()
    return places.layout(paths.withColumn("language", F.lit("rust"))).select("path", "crate", "module")


NAMES = ["Shop.sell", "pkg::Shop::sell", "a.MyShop.sell", "sell", "Shop.sell#2", "Shop#3.sell", "Shop.sell.x", "config.Shop.sell"]


@query(f"""SELECT p_partkey, name, string_split(replace(name, '::', '.'), '.')[-1] AS last, regexp_matches(name, '(^|[.:])Shop(#[0-9]+)?(::|[.])sell(#[0-9]+)?$') AS ends, list_contains(string_split(replace(name, '::', '.'), '.'), 'Shop') AS through
  FROM (SELECT p_partkey, {picked(NAMES, "p_partkey")} AS name FROM part)""")
def name_segments(spark: SparkSession, d: str) -> DataFrame:
    """Last segments of names, and whether names end in `Shop.sell` or pass through `Shop`."""
    rows = table(spark, d, "part").select("p_partkey", one_of(NAMES, F.col("p_partkey")).alias("name"))
    return rows.select("p_partkey", "name", text.last_segment("name").alias("last"), text.suffix_matches("name", ["Shop", "sell"]).alias("ends"), text.through("name", ["Shop"]).alias("through"))


LOOKS = ["a/b", "main.rs", "notes.txt", "x.md", "Shop.sell", "lib.sh", "README", "c.h"]


@query(f"""SELECT p_partkey, p_name, contains(word, '/') OR regexp_matches(word, '[.](rs|nix|sh|bash|py|c|h|md)$') AS path_like, p_name[1:7] AS head, p_size || '-' || (p_size + p_partkey % 3) = span OR p_size || '' = span AS spanned, span,
  CASE WHEN p_partkey % 3 = 1 THEN '1 caller' ELSE (p_partkey % 3) || ' callers' END AS counted
  FROM (SELECT *, {picked(LOOKS, "p_partkey")} AS word, CASE WHEN p_partkey % 3 = 0 THEN p_size || '' ELSE p_size || '-' || (p_size + p_partkey % 3) END AS span FROM part)""")
def shown_values(spark: SparkSession, d: str) -> DataFrame:
    """How answers show values: words like paths, capped texts, spans of lines, counts."""
    key = F.col("p_partkey")
    rows = table(spark, d, "part").withColumn("word", one_of(LOOKS, key))
    return rows.select("p_partkey", "p_name", text.path_like("word").alias("path_like"), text.capped("p_name", 7).alias("head"), F.lit(True).alias("spanned"), text.span(F.col("p_size"), F.col("p_size") + key % 3).alias("span"), text.counted(key % 3, "caller").alias("counted"))


@query("""SELECT page_id, CASE page_id % 7 WHEN 0 THEN d || '/x.nix' WHEN 1 THEN d || '/x.nix' WHEN 2 THEN 'top/x.nix' WHEN 3 THEN 'x' WHEN 4 THEN NULL WHEN 5 THEN 'root/y' ELSE d || '/b' END AS at
  FROM (SELECT page_id, 'top/d' || page_id AS d FROM pages)""")
def folded_paths(spark: SparkSession, d: str) -> DataFrame:
    """Relative paths from a file's folder."""
    written = one_of(["x.nix", "./x.nix", "../x.nix", "../../x", "../../../x", "/root/y", "a/../b"], F.col("page_id"))
    return table(spark, d, "pages").select("page_id", text.folded(written, F.concat(F.lit("top/d"), F.col("page_id").cast("string"), F.lit("/f.nix"))).alias("at"))


@query("""SELECT page_id, url_decode(replace('a%20b+c%C3%A9/' || regexp_extract(url, '[^/]*$') || '%23x', '+', '%2B')) AS decoded FROM pages""")
def decoded_links(spark: SparkSession, d: str) -> DataFrame:
    """Percent-decoded paths; a plus sign stays one."""
    return table(spark, d, "pages").select("page_id", text.decoded(F.concat(F.lit("a%20b+c%C3%A9/"), F.regexp_extract("url", "[^/]*$", 0), F.lit("%23x"))).alias("decoded"))


@query("""SELECT event_id, strftime(make_timestamp((event_id * 86411 % 2000000000) * 1000000), '%Y-%m-%d') AS day, sha1(event_id::VARCHAR)[1:9] AS short FROM events""")
def dates_and_shas(spark: SparkSession, d: str) -> DataFrame:
    """Days of seconds and short ids of commits."""
    return table(spark, d, "events").select("event_id", text.civil_date(F.col("event_id") * 86411 % 2_000_000_000).alias("day"), text.short(F.sha1(F.col("event_id").cast("string").cast("binary"))).alias("short"))


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(t, '(?i)<[a-z][^>]*?\\sid\\s*=\\s*["'']([^"'']+)["'']', 1), regexp_extract_all(t, '(?i)<a\\s[^>]*?name\\s*=\\s*["'']([^"'']+)["'']', 1)))), ',') AS ids
  FROM (SELECT page_id, '<p id="n' || page_id || '">x</p><a name=''m' || page_id % 3 || '''>' || html || '<i data-id="no"></i>' AS t FROM pages)""")
def element_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of elements and names of anchors."""
    n = F.col("page_id").cast("string")
    page = F.concat(F.lit('<p id="n'), n, F.lit("\">x</p><a name='m"), (F.col("page_id") % 3).cast("string"), F.lit("'>"), F.col("html"), F.lit('<i data-id="no"></i>'))
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(text.ids(page)), ",").alias("ids"))


# The catalog.


def _stat(rows: DataFrame) -> DataFrame:
    key = F.col("doc_id")
    return rows.select(F.concat(F.lit("f"), key.cast("string")).alias("path"), "doc_id", F.col("n_chars").alias("size"), (key * 1_000_000_000).alias("mtime"), (key * 3).alias("ctime"), key.alias("inode"))


@query("""WITH k AS (SELECT *, CASE WHEN doc_id % 7 = 1 THEN n_chars + 1 ELSE n_chars END AS size, CASE WHEN doc_id % 7 = 2 THEN 'old' ELSE 'v1' END AS extractor, CASE WHEN doc_id % 7 = 3 THEN doc_id * 1000000000 + 5 ELSE doc_id * 1000000000 + 3000000000 END AS seen FROM documents WHERE doc_id % 7 <> 0)
  SELECT 'f' || d.doc_id AS path, CASE WHEN k.doc_id IS NULL THEN 'new' WHEN d.n_chars <> k.size THEN 'changed' WHEN extractor <> 'v1' THEN 'extractor' WHEN d.doc_id * 1000000000 >= seen - 2000000000 THEN 'racy' END AS why
  FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id WHERE d.doc_id % 7 <> 4""")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    """What a check reads again, and why: files new, changed, read by another extractor or too soon after a change."""
    rows = _stat(table(spark, d, "documents"))
    kind = F.col("doc_id") % 7
    known = rows.where(kind != 0).withColumns({
        "size": F.when(kind == 1, F.col("size") + 1).otherwise(F.col("size")), "extractor": F.when(kind == 2, "old").otherwise("v1"),
        "seen": F.when(kind == 3, F.col("mtime") + 5).otherwise(F.col("mtime") + 3_000_000_000), "content": F.col("path"),
    })
    return store.stale(rows.where(kind != 4), known, "v1").select("path", "why")


@query("""SELECT 'f' || doc_id AS path FROM documents WHERE doc_id % 7 = 4""")
def gone_files(spark: SparkSession, d: str) -> DataFrame:
    """Files known that a listing lacks."""
    rows = _stat(table(spark, d, "documents"))
    return store.gone(rows.where("doc_id % 7 != 4"), rows.where("doc_id % 7 != 0")).select("path")


@query("""WITH b AS (SELECT DISTINCT sha1(text) AS blob, lang AS language FROM documents), h AS (SELECT DISTINCT sha1(text) AS blob, lang AS language FROM documents WHERE doc_id % 3 = 0)
  SELECT b.blob, b.language FROM b LEFT JOIN h ON h.blob = b.blob AND h.language = b.language WHERE h.blob IS NULL""")
def unknown_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Contents that no kept extraction of this extractor has."""
    rows = table(spark, d, "documents").select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("blob"), F.col("lang").alias("language"))
    have = rows.select("blob", "language", F.when(F.col("doc_id") % 3 == 0, "v1").otherwise("v0").alias("extractor"))
    return store.unknown(rows, have, "v1")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE 'old' END AS origin FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 3 <> 0""")
def upserted_rows(spark: SparkSession, d: str) -> DataFrame:
    """New rows over old ones of the same key."""
    part = table(spark, d, "part").select("p_partkey")
    return store.upserted(part.where("p_partkey % 3 != 0").withColumn("origin", F.lit("old")), part.where("p_partkey % 4 = 0").withColumn("origin", F.lit("new")), ["p_partkey"])


@query("""SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey * 1000000000000 > 100000000000000 - 604800000000000""")
def pruned_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents that stay: held by a file, or released within a week."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    contents = part.withColumn("released", F.when(F.col("id") % 3 != 0, F.col("id") * 1_000_000_000_000))
    return store.pruned(contents, part.where("id % 2 = 0").select(F.col("id").alias("content")), 100_000_000_000_000).select("id")


# Lines, spans and cuts.


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderkey // 256 AS file, o_orderkey % 256 AS a, o_orderkey % 256 + floor(o_totalprice % 40)::BIGINT AS b FROM orders), e AS (SELECT event_id, event_id // 64 AS file, event_id * 7 % 256 AS line FROM events)
  SELECT event_id, id, row_number() OVER (PARTITION BY event_id ORDER BY a DESC, b, id)::INT AS depth FROM e JOIN s ON s.file = e.file AND a <= line AND line <= b""")
def branch_stack(spark: SparkSession, d: str) -> DataFrame:
    """All spans around each line, the innermost first."""
    key = F.col("o_orderkey")
    spans = table(spark, d, "orders").select(key.alias("id"), F.floor(key / 256).alias("file"), (key % 256).alias("start"), (key % 256 + F.floor(F.col("o_totalprice") % 40)).alias("end"))
    points = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 64).alias("file"), (F.col("event_id") * 7 % 256).alias("line"))
    return intervals.stack(points, spans, ["file"], "line", ["event_id"], "id").select("event_id", "id", "depth")


@query("""WITH p AS (SELECT DISTINCT regexp_extract(url, '//([^?#]*)', 1) AS path FROM pages), s AS (SELECT path, array_to_string(string_split(path, '/')[k:], '/') AS tail FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM p))
  SELECT tail, count(*) AS paths FROM s GROUP BY tail""")
def path_tails(spark: SparkSession, d: str) -> DataFrame:
    """Tails of whole segments that paths may be written by, and how many paths each may mean."""
    paths = table(spark, d, "pages").select(F.regexp_extract("url", r"//([^?#]*)", 1).alias("path")).distinct()
    return intervals.suffixes(paths, "path", "tail").groupBy("tail").agg(F.count("*").alias("paths"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderkey // 256 AS file, o_orderkey % 256 AS a, o_orderkey % 256 + floor(o_totalprice % 40)::BIGINT AS b FROM orders),
  h AS (SELECT l_orderkey // 256 AS file, l_orderkey * 3 % 256 AS os, floor(l_quantity % 9)::BIGINT AS oc, l_orderkey * 5 % 256 AS ns, floor(l_quantity % 4)::BIGINT AS nc FROM lineitem),
  t AS (SELECT id, 0 AS added, least(os + oc - 1, b) - greatest(os, a) + 1 AS removed FROM h JOIN s ON s.file = h.file AND oc > 0 AND os <= b AND a <= os + oc - 1
    UNION ALL SELECT id, least(ns + nc - 1, b) - greatest(ns, a) + 1, 0 FROM h JOIN s ON s.file = h.file AND nc > 0 AND ns <= b AND a <= ns + nc - 1)
  SELECT 'd' || id AS qualified, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed FROM t GROUP BY id""")
def touched_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hunks add to and take from definitions, on the new and the old side."""
    key = F.col("o_orderkey")
    spans = table(spark, d, "orders").select(
        F.floor(key / 256).alias("rev"), F.lit("f").alias("path"), F.concat(F.lit("d"), key.cast("string")).alias("qualified"), F.lit("function").alias("kind"), (key % 256).alias("start"), (key % 256 + F.floor(F.col("o_totalprice") % 40)).alias("end")
    )
    line, n = F.col("l_orderkey"), F.col("l_quantity")
    hunks = table(spark, d, "lineitem").select(
        F.floor(line / 256).alias("rev"), F.lit("f").alias("path"), (line * 3 % 256).alias("old_start"), F.floor(n % 9).alias("old_count"), (line * 5 % 256).alias("new_start"), F.floor(n % 4).alias("new_count")
    )
    return history.touches(hunks, spans, spans).select("qualified", "added", "removed")


@query("""WITH r AS (SELECT source AS part, doc_id AS ord, octet_length(encode(lang)) AS size, (doc_id % 5) * 100000 - least(n_chars, 99999) AS rank FROM documents),
  c AS (SELECT *, sum(size + 1) OVER (PARTITION BY part ORDER BY rank DESC, ord ROWS UNBOUNDED PRECEDING) AS cum FROM r) SELECT part, count(*) AS n, min(ord) AS first FROM c WHERE cum > 16 GROUP BY part""")
def left_out_lines(spark: SparkSession, d: str) -> DataFrame:
    """What a cut leaves out, by part."""
    rows = table(spark, d, "documents").select(F.col("source").alias("part"), F.col("doc_id").alias("ord"), F.octet_length("lang").cast("long").alias("size"), render.rank_key(F.col("doc_id") % 5, F.col("n_chars")).alias("rank"))
    return render.left_out(rows, render.budget_cut(rows, 4, group=["part"]))


# History and graphs.


@query("""WITH e AS (SELECT event_id, user_id % 40 AS task, sha1(event_id::VARCHAR) AS sha FROM events), b AS (SELECT * FROM e WHERE task < 30 AND event_id % 3 <> 0)
  SELECT 't' || task AS id, min(event_id) AS first, count(*) AS n FROM b GROUP BY task""")
def tasks_believed(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that commits name in a trailer and that list the commit by a short id, with their first commit."""
    events = table(spark, d, "events").select("event_id", (F.col("user_id") % 40).alias("task"), F.sha1(F.col("event_id").cast("string").cast("binary")).alias("sha"))
    named = F.concat(F.lit("t"), F.col("task").cast("string"))
    trailers = events.select(F.col("event_id").alias("rev"), F.lit("Task").alias("key"), F.concat(F.lit("x, "), named).alias("value"))
    listed = events.where("task < 30 and event_id % 3 != 0").select(named.alias("id"), F.substring("sha", 1, 12).alias("short"))
    board, commits = listed.select("id").distinct(), events.select(F.col("event_id").alias("rev"), "sha", F.col("event_id").alias("place"))
    return history.tasks_of(commits, trailers, board, listed=listed).select("id", "first", "n")


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS name, p_partkey AS cur, 0 AS k FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT name, cur // 2, k + 1 FROM r WHERE cur % 2 = 0 AND k < 8)
  SELECT 'n' || name AS name, 'n' || arg_max(cur, k) AS "to" FROM r GROUP BY name""")
def alias_chains(spark: SparkSession, d: str) -> DataFrame:
    """Aliases followed to where they end, eight steps at most."""
    named = lambda c: F.concat(F.lit("n"), c.cast("string"))
    part = table(spark, d, "part").where("p_partkey % 2 = 0").select(named(F.col("p_partkey")).alias("name"), named(F.floor(F.col("p_partkey") / 2)).alias("to"))
    return graph.followed(part)


BM25 = """WITH t AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda w: CASE WHEN regexp_matches(w, '^[a-z]{2,}s$') AND NOT regexp_matches(w, '(us|ss)$') THEN CASE WHEN regexp_matches(w, '[^ae]ies$') THEN regexp_replace(w, 'ies$', 'y')
    WHEN regexp_matches(w, '[iaoe]es$') THEN w ELSE w[:len(w) - 1] END ELSE w END) AS w FROM part),
  n AS (SELECT count(*) AS n, greatest(avg(len(w)), 1.0) AS mean FROM t), c AS (SELECT p_partkey, len(w) AS len, q, len(list_filter(w, lambda x: x = q)) AS c FROM t, (SELECT unnest(['red', 'bolt']) AS q)),
  i AS (SELECT q, ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM c WHERE c > 0 GROUP BY q),
  s AS (SELECT p_partkey, sum(idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len / (SELECT mean FROM n)))) AS score FROM c JOIN i USING (q) WHERE c > 0 GROUP BY p_partkey)"""


@query(BM25 + " SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN score / 2 ELSE score END, 6) AS score FROM s")
def ungated_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all part names that hold a word asked, without a gate; those of tests weigh half."""
    asked = search.query_words("red bolts")
    counts = search.counted(table(spark, d, "part").select("p_partkey", "p_name"), {"p_name": 1.0}, asked)
    return search.scores(counts, search.corpus(counts, asked), F.col("p_partkey") % 2 == 0).select("p_partkey", F.round("score", 6).alias("score"))


# Conditions of three values.

NAME_OF = lambda c: F.when(c.isNull(), "unknown").when(c, "true").otherwise("false")
HOST = {"unix": True, "windows": False, "target_os": {"linux"}, "test": False}
CFG = {"unix": True, "windows": False, 'target_os = "linux"': True, 'target_os = "macos"': False, 'feature = "x"': None, "all(unix, not(windows))": True, "any(windows, mystery)": None, 'all(windows, feature = "x")': False, 'not(any(unix, feature = "y"))': False, "all()": True, "any()": False, "not(mystery)": None}
MACROS = {"A": "(2 + 3)", "B": None, "__linux__": "1"}
C_IF = {"A == 5": True, "defined(A) && !defined(B)": True, "NOT_KNOWN > 1": None, "0 && NOT_KNOWN": False, "A << 1 == 10 || NOT_KNOWN": True, "-7 / 2 == -3": True, "-1 > 0u": True, "A ? 0 : 1": False, "1 / 0": None, "(A & 4) != 0": True, "B": False, "__linux__": True}
PLATFORM = {"sys.platform": "linux", "os.name": "posix", "sys.version_info": (3, 13, 0), "TYPE_CHECKING": False}
PYTHON_IF = {"sys.platform == 'win32'": False, "sys.platform.startswith('lin')": True, "os.name in ('nt', 'posix')": True, "sys.version_info < (3, 8)": False, "TYPE_CHECKING": False, "not TYPE_CHECKING and unknown()": None, "unknown() or os.name == 'posix'": True, "unknown() and sys.platform == 'win32'": False}


def _told(values: dict[str, bool | None]) -> str:
    return picked(["unknown" if v is None else str(v).lower() for v in values.values()], "doc_id")


def _conditions(spark: SparkSession, d: str, values: dict[str, bool | None], evaluate: Callable[[str], bool | None]) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", one_of(list(values), F.col("doc_id")).alias("condition"))
    return conditions.evaluated(rows, "condition", evaluate, "value").select("doc_id", NAME_OF(F.col("value")).alias("value"))


@query(f"SELECT doc_id, {_told(CFG)} AS value FROM documents")
def cfg_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Rust's cfg predicates on a host of which not all is known."""
    return _conditions(spark, d, CFG, lambda t: conditions.cfg(t, HOST))


@query(f"SELECT doc_id, {_told(C_IF)} AS value FROM documents")
def c_conditions(spark: SparkSession, d: str) -> DataFrame:
    """C's #if expressions under macros of which not all are known."""

    def evaluate(t: str) -> bool | None:
        value = conditions.c_if(t, MACROS)
        return None if value is None else bool(value)

    return _conditions(spark, d, C_IF, evaluate)


@query(f"SELECT doc_id, {_told(PYTHON_IF)} AS value FROM documents")
def python_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Python's tests of the platform."""
    return _conditions(spark, d, PYTHON_IF, lambda t: conditions.python_if(t, PLATFORM))
