"""The engine's operators as queries over the driver's tables, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions import text
from sextant.operators import graph, history, intervals, ranking, render, search, store, tiers
from sextant.session import settled

SEARCHED = "the public license version"
WEAK = "zyxgate license"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Contents by git blob id: first document and number of holders."""
    rows = table(spark, d, "documents").select("doc_id", text.blob_id("text").alias("blob"))
    return store.held_by(rows, F.col("blob"), F.col("doc_id")).select("blob", F.col("first").alias("first_doc"), "holders")


def incremental_check(spark: SparkSession, d: str) -> DataFrame:
    """Statuses of documents between a listing and a later one with some added, gone and changed."""
    rows = table(spark, d, "documents").select("doc_id", text.blob_id("text").alias("blob"))
    old = rows.where("doc_id % 10 != 0")
    new = rows.where("doc_id % 10 != 1").withColumn("blob", F.when(F.col("doc_id") % 10 == 2, F.sha1(F.encode("blob", "UTF-8"))).otherwise(F.col("blob")))
    return store.compared(old, new, "doc_id", "blob")


def worktree_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", "doc_id", text.blob_id("text").alias("blob"))
    return store.digest(rows, ["lang"], "doc_id", "blob")


def tokenize_words(spark: SparkSession, d: str) -> DataFrame:
    """Search words of all documents; equal identifiers are counted before they are cut into words."""
    found = table(spark, d, "documents").select(F.explode(text.identifiers("text")).alias("identifier")).groupBy("identifier").agg(F.count("*").alias("k"))
    return found.select(F.explode(text.words("identifier")).alias("word"), "k").groupBy("word").agg(F.sum("k").alias("n"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source")


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """Top twenty documents for a question; the source is the named field."""
    found = search.search(_documents(spark, d), SEARCHED, {"source": search.NAMED, "text": 1.0}, ["doc_id"])
    return found.ranked.select("doc_id", F.round("score", 6).alias("score"))


def search_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether a strong and a weak question are answered, and how many documents hold a word of each."""
    out = []
    for query in (SEARCHED, WEAK):
        asked = search.query_words(query)
        counts = settled(search.counted(_documents(spark, d), {"source": search.NAMED, "text": 1.0}, asked).select("doc_id", "len", "counts"))
        about = search.corpus(counts, asked)
        ranked = search.scores(counts, about)
        best = ranked.orderBy(F.desc("score"), "doc_id").select("held").take(1)
        passed = search.gate(asked, about, best[0].held)[0] if best else False
        out.append((query, ranked.count(), passed))
    return spark.createDataFrame(out, "query string, holding long, answered boolean")


def stop_word_share(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("lang", F.explode(text.identifiers("text")).alias("identifier")).groupBy("lang", "identifier").agg(F.count("*").alias("k"))
    words = found.select("lang", F.explode(text.words("identifier")).alias("word"), "k")
    return words.groupBy("lang").agg(F.sum("k").alias("words"), F.sum(F.when(text.is_stop("word"), F.col("k")).otherwise(0)).alias("stops"))


def language_of(spark: SparkSession, d: str) -> DataFrame:
    """Languages of file names made of part numbers, by extension."""
    ext = F.element_at(F.array(*[F.lit(e) for e in ("rs", "nix", "sh", "py", "h", "md", "txt", "C")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    files = table(spark, d, "part").select("p_partkey", F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit("."), ext).alias("path"))
    return files.withColumn("language", text.language_of("path")).groupBy("language").agg(F.count("*").alias("files"))


def nearest_names(spark: SparkSession, d: str) -> DataFrame:
    """The eight part names nearest to a word none has: one that holds it, or is held by it, is at no distance."""
    wanted = "forest gren"
    name = F.col("p_name")
    near = F.when(F.lower(name).contains(wanted) | F.lit(wanted).contains(F.lower(name)), F.lit(0)).otherwise(F.levenshtein(F.lower(name), F.lit(wanted)))
    return table(spark, d, "part").select("p_partkey", name, near.alias("distance")).orderBy("distance", F.length("p_name"), "p_partkey").limit(8)


def heading_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of all headings of the pages, those of one slug numbered by page and place."""
    found = F.regexp_extract_all("html", F.lit("<h[1-6]>(.*?)</h[1-6]>"), F.lit(1))
    slugs = table(spark, d, "pages").select("page_id", F.posexplode(found).alias("at", "heading")).withColumn("base", text.slug("heading"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("page_id", "at")) - 1
    return slugs.select("page_id", "at", text.numbered_slug("base", nth).alias("anchor"))


def first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.first_sentence("text").alias("sentence"))


def link_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links of the pages that lead into their own site, and how often."""
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.withColumn("target", text.relative_link("href")).where("target is not null").groupBy("page_id", "target").agg(F.count("*").alias("n"))


def resolve_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Each customer tied to the suppliers of its nation, else to those of its region, else to none: one, several or external."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("nk"), "n_regionkey")
    suppliers = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("nk")).select("s_suppkey", "s_nationkey", "n_regionkey")
    customers = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("nk")).select("c_custkey", "c_nationkey", "n_regionkey")
    # Uses are resolved once for each distinct scope and dealt back to the sites.
    scopes = customers.select("c_nationkey", "n_regionkey").distinct()
    by_nation = scopes.join(suppliers.drop("n_regionkey"), F.col("c_nationkey") == F.col("s_nationkey")).select("c_nationkey", "s_suppkey")
    by_region = scopes.join(suppliers, "n_regionkey").select("c_nationkey", "s_suppkey")
    found = tiers.first_tier(scopes, [("module", by_nation), ("unique", by_region)], ["c_nationkey"], "s_suppkey")
    targets = F.array_join(F.transform("targets", lambda t: t.cast("string")), ",")
    # Lists are written out once a scope, not once a site.
    told = settled(found.select("c_nationkey", "status", F.coalesce("rule", F.lit("")).alias("rule"), F.size("targets").cast("long").alias("n"), targets.alias("targets")))
    return tiers.dealt(customers.select("c_custkey", "c_nationkey"), told, ["c_nationkey"], F.octet_length("targets")).drop("c_nationkey")


def nearest_scope(spark: SparkSession, d: str) -> DataFrame:
    """Each page under the longest of the folders that hold three pages or more, at any depth."""
    paths = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"//([^?#]*)", 1).alias("path"))
    cut = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(cut) - 1, F.lit(1))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))
    roots = paths.select(F.explode(folders).alias("root")).groupBy("root").agg(F.count("*").alias("n")).where("n > 2 and root != ''").select("root")
    return intervals.nearest_prefix(paths, roots, "path", "root").select("page_id", F.coalesce("root", F.lit("")).alias("root"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of three depths in each order's range of numbers, as definitions in a file."""
    key = F.col("o_orderkey")
    base = table(spark, d, "orders").select(key.alias("id"), (F.floor(key / 256)).alias("file"), (key % 256).alias("start"), F.floor(F.col("o_totalprice") % 40).cast("long").alias("length"))
    return base.select("id", "file", "start", (F.col("start") + F.col("length")).alias("end"))


def point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    """The innermost span around each event."""
    points = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 64).alias("file"), (F.col("event_id") * 7 % 256).alias("line"))
    return intervals.innermost(points, _spans(spark, d), ["file"], "line", ["event_id"], "id").select("event_id", F.coalesce("id", F.lit(-1)).alias("span"))


def hunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hunks share with the spans of their file, by span; hunks of no lines share none."""
    lines = table(spark, d, "lineitem")
    hunks = lines.select(F.floor(F.col("l_orderkey") / 256).alias("file"), (F.col("l_orderkey") * 3 % 256).alias("at"), F.floor(F.col("l_quantity") % 9).cast("long").alias("n"))
    shared = intervals.overlapping(hunks, _spans(spark, d), ["file"], "at", "n")
    return shared.groupBy("id").agg(F.sum("lines").alias("lines"), F.count("*").alias("hunks"))


def _uses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("caller"), F.lower("l_returnflag").alias("how"), (F.col("l_orderkey") % 100).alias("line"))


def callers_group(spark: SparkSession, d: str) -> DataFrame:
    """Uses of each target by caller, distinct and in order."""
    uses = F.array_sort(F.collect_set(F.struct("how", "line")))
    grouped = _uses(spark, d).groupBy("target", "caller").agg(uses.alias("uses"))
    return grouped.select("target", "caller", F.array_join(F.transform("uses", lambda u: F.concat_ws(" ", u["how"], u["line"].cast("string"))), "; ").alias("uses"))


def callees_group(spark: SparkSession, d: str) -> DataFrame:
    """Targets of each caller, and how many of its uses are sure or only possible."""
    rows = _uses(spark, d).withColumn("sure", F.col("how") != "r")
    return rows.groupBy("caller").agg(F.count_distinct("target").alias("targets"), F.count_distinct(F.when(F.col("sure"), F.col("target"))).alias("sure"), F.count_distinct(F.when(~F.col("sure"), F.col("target"))).alias("possible"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Part to part edges: parts of one order, in order of their lines."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    on = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return lines.join(on, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst")


def impact_levels(spark: SparkSession, d: str) -> DataFrame:
    """Parts that three levels of callers reach from part 1, at their first level."""
    start = table(spark, d, "part").where("p_partkey = 1").select(F.col("p_partkey").alias("id"))
    return graph.levels(_edges(spark, d).distinct(), start, 3)


def include_closure(spark: SparkSession, d: str) -> DataFrame:
    """All that a file includes, by way of others too."""
    nation = table(spark, d, "nation")
    edges = nation.select(F.col("n_nationkey").alias("src"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("dst")).union(nation.select("n_nationkey", (F.col("n_nationkey") - 5).alias("dst")).where("dst >= 0"))
    return graph.closure(edges)


def graph_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weighted edges between nations: sure ones weigh 1, ambiguous ones share a tenth, others nothing."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    sites = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("src"), (F.col("o_orderkey") % 25).cast("int").alias("dst"), "o_orderstatus", "o_orderpriority")
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "ambiguous").otherwise("external")
    w = graph.use_weight(status, F.lit(4), F.col("o_orderpriority").startswith("1"))
    return graph.combined(sites.select("src", "dst", w.alias("w"))).select("src", "dst", F.round("w", 6).alias("w"))


def _small_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    edges = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("src"), (F.col("o_orderkey") % 25).cast("int").alias("dst")).agg(F.count("*").cast("double").alias("w"))
    return nodes, edges


def pagerank_uniform(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(*_small_graph(spark, d), steps=6, tolerance=0).select("id", F.round("share", 6).alias("share"))


def pagerank_focus(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _small_graph(spark, d)
    focus = nodes.where("id in (3, 7)").select("id", F.lit(0.5).alias("weight"))
    return graph.pagerank(nodes, edges, focus, steps=6, tolerance=0).select("id", F.round("share", 6).alias("share"))


def map_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers grouped by nation, the nation of the best first, each nation's from the best."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    ranked = ranking.placed(rows, [F.desc("s_acctbal"), "s_suppkey"])
    best = ranked.groupBy("s_nationkey").agg(F.min("place").alias("best"))
    return ranking.placed(ranked.join(best, "s_nationkey"), ["best", "place"], "nth").select("s_nationkey", "s_suppkey", "nth")


def budget_cut(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each language's answer that fit a budget, by tier and then by order."""
    rows = table(spark, d, "documents").select("lang", F.col("doc_id").alias("ord"), F.octet_length("source").cast("long").alias("size"), render.rank_key(F.col("doc_id") % 5, F.col("n_chars")).alias("rank"))
    return render.budget_cut(rows, 60, group=["lang"]).select("lang", "ord", "rank", "cum")


def outline_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Depth of nested ranges: a conversation around its pairs of turns around its turns."""
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn")).distinct()
    whole = turns.groupBy("conv_id").agg((F.min("turn") * 10).alias("start"), (F.max("turn") * 10 + 9).alias("end"), F.lit(0).cast("long").alias("id"))
    each = turns.select("conv_id", (F.col("turn") * 10 + 1).alias("start"), (F.col("turn") * 10 + 8).alias("end"), (F.col("turn") + 1000).alias("id"))
    part = turns.select("conv_id", (F.col("turn") * 10 + 3).alias("start"), (F.col("turn") * 10 + 5).alias("end"), (F.col("turn") + 100_000).alias("id"))
    return intervals.depths(whole.unionByName(each).unionByName(part), ["conv_id"], "id").select("conv_id", "id", "depth")


def section_extent(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's section: to the turn before the next of its role's level or a higher one."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), level.alias("level")).groupBy("conv_id", "turn").agg(F.min("level").alias("level"))
    ends = turns.withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    return intervals.extents(ends, ["conv_id"], "turn", "level", "last").select("conv_id", "turn", "until")


def duplicate_numbering(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return intervals.numbered(rows, ["p_brand"], ["p_partkey"], "p_type").select("p_partkey", F.col("p_type").alias("name"))


def trailer_join(spark: SparkSession, d: str) -> DataFrame:
    """Events that name a task in a list of trailers."""
    k = F.get_json_object("props", "$.k")
    trailers = table(spark, d, "events").select(F.col("event_id").alias("rev"), F.initcap("event_type").alias("key"), F.concat_ws(", ", k, (F.col("event_id") % 50).cast("string"), F.lit("x")).alias("value"))
    return history.of_task(trailers, "click", "17")


def touched_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("path"), F.col("event_type").alias("qualified"), F.floor(F.col("value")).cast("long").alias("added"), (F.col("event_id") % 7).alias("removed"))
    return history.rolled_up(rows, ["path", "qualified"], "event_id").select("path", "qualified", "added", "removed", "commits", "first", F.col("nth").cast("long").alias("nth"))


def rename_follow(spark: SparkSession, d: str) -> DataFrame:
    """Names of all files through their renames: part k was once part k div 2, down to part 1."""
    part = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"))
    named = lambda k: F.concat(F.lit("f"), k.cast("string"))
    changes = part.where("k > 1").select((F.lit(1 << 40) - F.col("k")).alias("place"), named(F.col("k")).alias("path"), named(F.floor(F.col("k") / 2)).alias("renamed"))
    paths = part.select(named(F.col("k")).alias("path"))
    return history.followed(changes, paths).select("start", "path", "from", F.coalesce("until", F.lit(-1)).alias("until"))


def condition_3vl(spark: SparkSession, d: str) -> DataFrame:
    """Conjunction, disjunction and negation of conditions that may be unknown."""
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    a, b = F.col("quality") == 1, F.when(F.col("doc_id") % 3 != 0, F.col("toxic") == 1)
    name = lambda c: F.when(c.isNull(), "unknown").when(c, "true").otherwise("false")
    return docs.select("doc_id", name(a & b).alias("both"), name(a | b).alias("either"), name(~a).alias("not_a"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bm25_search, content_dedup, incremental_check, worktree_digest, tokenize_words, search_gate, stop_word_share, language_of, nearest_names, heading_slugs, first_sentence,
        link_edges, resolve_tiers, nearest_scope, point_in_interval, hunk_overlap, callers_group, callees_group, impact_levels, include_closure, graph_weights, pagerank_uniform,
        pagerank_focus, map_by_file, budget_cut, outline_nesting, section_extent, duplicate_numbering, trailer_join, touched_rollup, rename_follow, condition_3vl,
    )
}
