"""Crates and modules of Rust files: what Cargo's layout says, and what `mod` items load from each crate's root.

A place is (path, crate, module), the module's names joined by `::` and empty at the root. A file
that several crates load has a place in each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.session import settled

PLACE = ["path", "crate", "module"]


def _at(part: int) -> Column:
    """Package folder (1), the first folder that Cargo gives a meaning (2) and the path below it (3)."""
    return F.regexp_extract("path", r"^(?:(.*?)/)?(src|tests|examples|benches)/(.+)$", part)


def _modules(parts: Column) -> Column:
    names = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"\.rs$", ""), "^(mod|main)$", ""))
    return F.array_join(F.filter(names, lambda s: s != ""), "::")


def layout(files: DataFrame) -> DataFrame:
    """Each Rust file where Cargo's layout puts it, and whether it is the root of a crate."""
    rows = files.where("language = 'rust'").select("path", _at(1).alias("package"), _at(2).alias("top"), _at(3).alias("inside")).withColumn("parts", F.split("inside", "/"))
    libs = rows.where("top = 'src' and inside = 'lib.rs'").select("package", F.lit(True).alias("library")).distinct()
    named = lambda kind, n: F.concat("package", F.lit(f":{kind}"), F.regexp_replace(F.element_at("parts", n), r"\.rs$", ""))
    whole = _modules(F.col("parts"))
    binary = (F.col("top") == "src") & F.col("inside").startswith("bin/")
    second = (F.col("top") == "src") & (F.col("inside") == "main.rs") & F.col("library")
    crate = F.when(F.col("top") == "", F.col("path")).when(binary, named("bin/", 2)).when(second, F.concat("package", F.lit(":main"))).when(F.col("top") == "src", F.col("package"))
    module = F.when(F.col("top") == "", "").when(binary, _modules(F.slice("parts", 3, 1 << 20))).when(second | (whole == "lib"), "").when(F.col("top") == "src", whole)
    other = F.concat("package", F.lit(":"), "top", F.lit("/"), F.regexp_replace(F.element_at("parts", 1), r"\.rs$", ""))
    root = F.when(F.col("top") == "src", F.col("inside").rlike(r"^(lib|main)\.rs$|^bin/[^/]+(/main\.rs)?$")).otherwise(F.col("inside").rlike(r"^[^/]+(/main\.rs)?$"))
    out = rows.join(libs, "package", "left").withColumn("library", F.coalesce("library", F.lit(False)))
    return out.select("path", F.coalesce(crate, other).alias("crate"), F.coalesce(module, _modules(F.slice("parts", 2, 1 << 20))).alias("module"), (root & (F.col("top") != "")).alias("root"))


def loads(at: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, loaded, below): the files that `mod x;` items of a file load, and the names they have below its module."""
    modules = symbols.where("language = 'rust' and kind = 'module'").withColumn("qualified", F.regexp_replace("qualified", r"#\d+|\br#", ""))
    items = modules.where("declared").select("path", F.col("qualified").alias("below"), F.regexp_replace("qualified", "(^|::)[^:]*$", "").alias("inline"))
    # An item in a function is in no module.
    inline = modules.where("not declared").select("path", F.col("qualified").alias("inline")).distinct()
    items = items.where("inline = ''").unionByName(items.join(inline, ["path", "inline"], "left_semi").select("path", "below", "inline"))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    own = F.col("root") | F.col("path").rlike(r"(^|/)mod\.rs$")
    base = F.concat(folder, F.when(own, "").otherwise(F.concat(F.regexp_extract("path", r"([^/]*)\.rs$", 1), F.lit("/"))), F.regexp_replace("below", "::", "/"))
    wanted = items.distinct().join(at.select("path", "root"), "path").select("path", "below", F.posexplode(F.array(F.concat(base, F.lit(".rs")), F.concat(base, F.lit("/mod.rs")))).alias("nth", "loaded"))
    found = wanted.join(at.select(F.col("path").alias("loaded")), "loaded")
    return found.groupBy("path", "below").agg(F.min_by("loaded", "nth").alias("loaded"))


def _walked(start: DataFrame, known: DataFrame, items: DataFrame) -> DataFrame:
    """`known` and the places reached from `start`; a file loaded again inside itself is a cycle, and stays out."""
    front = settled(start.select(*PLACE))
    known = known.unionByName(front)
    while front.take(1):
        down = front.join(items, "path").select(F.col("loaded").alias("path"), "crate", F.concat_ws("::", F.when(F.col("module") != "", F.col("module")), "below").alias("module")).distinct()
        held = known.select("path", "crate", F.col("module").alias("before"))
        again = down.join(held, ["path", "crate"]).where("before = '' or module = before or startswith(module, before || '::')").select(*PLACE)
        front = settled(down.join(again, PLACE, "left_anti"))
        known = known.unionByName(front)
    return known


def placed(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The places of all Rust files: from the roots of crates, then from files that nothing loads; what is left lies where the layout puts it."""
    at = settled(layout(files))
    items = settled(loads(at, symbols))
    known = _walked(at.where("root"), at.limit(0).select(*PLACE), items)
    alone = at.join(known, "path", "left_anti").join(items.select(F.col("loaded").alias("path")), "path", "left_anti")
    known = _walked(alone, known, items)
    return settled(known.unionByName(at.join(known, "path", "left_anti").select(*PLACE)).distinct())


def absolute(written: Column, module: Column) -> Column:
    """A path that begins with crate, self or super, from its crate's root; null for another, and for one that leaves the root."""
    closed = F.concat(written, F.lit("::"))
    ups = F.floor(F.length(F.regexp_extract(closed, r"^(?:self::)?((?:super::)*)", 1)) / 7).cast("int")
    names = F.filter(F.split(module, "::"), lambda s: s != "")
    rest = F.filter(F.split(F.regexp_replace(closed, r"^crate::|^(?:self::)?(?:super::)*", ""), "::"), lambda s: s != "")
    above = F.when(ups <= F.size(names), F.array_join(F.concat(F.slice(names, 1, F.size(names) - ups), rest), "::"))
    return F.when(closed.startswith("crate::"), F.array_join(rest, "::")).when(closed.rlike("^(self|super)::"), above)
