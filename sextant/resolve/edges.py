"""Resolution: uses tied to the definitions they reach, by tiers of joins for each language.

A site is (path, table, ord). Each language gives its tiers as rows of a site and a target
(path, ord), null for a hit outside the worktree; `tiers.first_tier` keeps those of the first
tier with a hit. Languages are resolved among their own files, Markdown sees all.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import text
from sextant.operators import graph, tiers
from sextant.operators.intervals import suffixes
from sextant.resolve import libraries as library_names
from sextant.resolve import places
from sextant.session import settled

SITE = ["path", "tab", "ord"]
Tiers = list[tuple[str, DataFrame]]
TYPES = ("struct", "enum", "union", "trait", "class", "type_alias")
#: Definitions that no use reaches by name alone.
UNNAMED = ("file", "impl", "anchor", "argument", "section")


def target(path: Column | str, ord_: Column | str) -> Column:
    return F.struct(text.col(path).alias("path"), text.col(ord_).alias("ord"))


def sites(calls: DataFrame, refs: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls, references and imports (each with path of the file as `path`, and language) as sites."""
    null = F.lit(None).cast("string")
    one = calls.select("language", "path", F.lit("call").alias("tab"), "ord", "name", F.col("written"), "kind", "line", F.col("caller").alias("from"), "receiver", "local", "typed", null.alias("via"), F.concat(F.lit("call "), "kind").alias("use"))
    two = refs.select("language", "path", F.lit("ref").alias("tab"), "ord", "name", "written", "kind", "line", F.col("user").alias("from"), null.alias("receiver"), "local", "typed", null.alias("via"), F.when(F.col("kind") == "mention", "mention").when(F.col("kind") == "set", "setting").otherwise(F.concat(F.lit("reference "), "kind")).alias("use"))
    # Bases of classes are told by references as well.
    three = imports.where("via is null or via != 'base'").select(
        "language", "path", F.lit("import").alias("tab"), "ord", text.last_segment("written").alias("name"), "written", F.when(F.col("glob"), "glob").otherwise("import").alias("kind"), "line", F.col("importer").alias("from"),
        null.alias("receiver"), F.col("alias").alias("local"), null.alias("typed"), "via", F.when(F.col("language") == "markdown", "link").otherwise("import").alias("use"),
    )
    return one.unionByName(two).unionByName(three)


def _hit(rows: DataFrame, path: str = "d_path", ord_: str = "d_ord") -> DataFrame:
    return rows.select(*SITE, F.when(F.col(ord_).isNotNull(), target(path, ord_)).alias("target"))


def _defs(symbols: DataFrame, language: str | None) -> DataFrame:
    some = symbols if language is None else symbols.where(F.col("language") == language)
    return some.select(F.col("path").alias("d_path"), F.col("ord").alias("d_ord"), F.col("name").alias("d_name"), F.col("qualified").alias("d_qualified"), F.col("kind").alias("d_kind"), F.col("internal").alias("d_internal"))


def _unique(uses: DataFrame, defs: DataFrame, barred: list[str] = ()) -> DataFrame:
    """Sites with the definitions of their name; several stay several. Names barred are left out."""
    return _hit(uses.where(~F.col("name").isin(*barred) if barred else F.lit(True)).join(defs, F.col("name") == F.col("d_name")))


# Python


def python_modules(files: DataFrame) -> DataFrame:
    """Each Python file under every dotted name that it may be imported by, from the root and from each folder below (`base`)."""
    named = files.where("language = 'python'").withColumn("module", text.module_name("path")).withColumn("cut", F.split("module", r"\."))
    at = named.select("path", "cut", F.explode(F.sequence(F.lit(1), F.size("cut"))).alias("k"))
    base = F.array_join(F.slice("cut", 1, F.col("k") - 1), "/")
    return at.select(F.array_join(F.slice("cut", F.col("k"), F.size("cut")), ".").alias("module"), base.alias("base"), F.col("path").alias("m_path")).where("module != ''")


def _python_absolute(imports: DataFrame) -> DataFrame:
    """Imports with `absolute`: the dotted path, leading dots made the package's name."""
    dots = F.length(F.regexp_extract("written", r"^(\.*)", 1))
    folder = F.split("path", "/")
    package = F.array_join(F.slice(folder, 1, F.greatest(F.size(folder) - dots, F.lit(0))), ".")
    rest = F.regexp_replace("written", r"^\.+", "")
    return imports.withColumn("absolute", F.when(dots > 0, F.concat_ws(".", F.when(package != "", package), F.when(rest != "", rest))).otherwise(F.col("written")))


def python_imported(imports: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Imports (SITE) and what their path leads to: the longest prefix that is a module nearest to the
    importing file, and the definition named by the rest, d_ord null where the module has none."""
    absolute = _python_absolute(imports)
    cut = F.split("absolute", r"\.")
    tried = absolute.select("*", F.explode(F.sequence(F.lit(1), F.size(cut))).alias("k")).withColumns({"module": F.array_join(F.slice(F.split("absolute", r"\."), 1, F.col("k")), "."), "rest": F.array_join(F.slice(F.split("absolute", r"\."), F.col("k") + 1, 1000), ".")})
    found = tried.join(python_modules(files), "module").where((F.col("base").isin("", "src")) | F.col("path").startswith(F.concat(F.col("base"), F.lit("/"))))
    best = found.groupBy(*SITE).agg(F.max(F.struct("k", F.length("base").alias("near"), "m_path", "rest")).alias("b")).select(*SITE, F.col("b.m_path").alias("m_path"), F.col("b.rest").alias("rest"))
    defs = _defs(symbols, "python")
    return best.join(defs, (F.col("m_path") == F.col("d_path")) & (F.col("rest") == F.col("d_qualified")), "left").select(*SITE, "m_path", "rest", F.col("m_path").alias("d_path"), "d_ord", "d_qualified", "d_kind")


def python_ancestors(symbols: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, class) with each class above it (a_path, a_class) and its place in the order in which members are looked up."""
    classes = symbols.where("language = 'python' and kind = 'class'").select(F.col("path").alias("a_path"), F.col("qualified").alias("a_class"))
    bases = imports.where("language = 'python' and via = 'base'").select("path", "ord", F.lit("import").alias("tab"), F.col("importer").alias("class"), "written")
    own = bases.join(classes, (F.col("path") == F.col("a_path")) & (F.col("written") == F.col("a_class"))).select("path", "class", "a_path", "a_class", "ord")
    named = imports.where("language = 'python' and alias is not null").select("path", F.lit("import").alias("tab"), "ord", "written", "alias")
    led = python_imported(named, files, symbols).join(named.select("path", "tab", "ord", "alias"), SITE)
    through = bases.drop("tab").withColumn("head", F.substring_index("written", ".", 1)).join(led.select("path", F.col("alias").alias("head"), "m_path", "d_qualified"), ["path", "head"])
    tail = F.regexp_replace("written", r"^[^.]*\.?", "")
    wanted = F.when(F.col("d_qualified").isNull(), tail).when(tail == "", F.col("d_qualified")).otherwise(F.concat_ws(".", "d_qualified", tail))
    far = through.withColumn("wanted", wanted).join(classes, (F.col("m_path") == F.col("a_path")) & (F.col("wanted") == F.col("a_class"))).select("path", "class", "a_path", "a_class", "ord")
    step = settled(own.unionByName(far).groupBy("path", "class", "a_path", "a_class").agg(F.min("ord").alias("ord")))
    # Classes above, however deep: pairs new in a round are extended in the next.
    known = front = step.select("path", "class", "a_path", "a_class")
    on = step.select(F.col("path").alias("a_path"), F.col("class").alias("a_class"), F.col("a_path").alias("n_path"), F.col("a_class").alias("n_class"))
    while front.take(1):
        further = front.join(on, ["a_path", "a_class"]).select("path", "class", F.col("n_path").alias("a_path"), F.col("n_class").alias("a_class")).distinct()
        front = settled(further.join(known, ["path", "class", "a_path", "a_class"], "left_anti"))
        known = settled(known.unionByName(front))
    # Of each class, the bases in order of it and of all above it, which its linear order is made of.
    key = lambda p, c: F.concat_ws("\t", p, c)
    bases = step.groupBy(key("path", "class").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", key("a_path", "a_class").alias("b")))), lambda x: x["b"]).alias("bases"))
    reach = known.select(key("path", "class").alias("class_key"), key("a_path", "a_class").alias("c")).unionByName(step.select(key("path", "class").alias("class_key"), key("path", "class").alias("c")).distinct())
    held = reach.join(bases, "c").groupBy("class_key").agg(F.collect_list(F.struct("c", "bases")).alias("held"))

    def orders(batches):
        for part in batches:
            found = [(k, *a.split("\t"), n) for k, rows in zip(part["class_key"], part["held"], strict=True) for n, a in enumerate(graph.linearized({r["c"]: list(r["bases"]) for r in rows}, k)) if n]
            frame = pd.DataFrame(found, columns=["class_key", "a_path", "a_class", "far"])
            yield frame.assign(path=frame.class_key.str.split("\t").str[0], **{"class": frame.class_key.str.split("\t").str[1]})[["path", "class", "a_path", "a_class", "far"]]

    return held.mapInPandas(orders, "path string, class string, a_path string, a_class string, far int")


def python(uses: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame, library: list[str] = ()) -> Tiers:
    own = uses.where("language = 'python'")
    code = own.where("tab != 'import'")
    defs = _defs(symbols, "python")
    named = defs.where(~F.col("d_kind").isin(*UNNAMED))
    scope = code.where("local is not null and (receiver is null or receiver = local) and written is null").join(defs, (F.col("path") == F.col("d_path")) & (F.col("local") == F.col("d_qualified")), "left")
    dotted_local = code.where("local is not null and written is not null").withColumn("full", F.concat_ws(".", "local", F.regexp_replace("written", r"^[^.]*\.", "")))
    scope = _hit(scope).unionByName(_hit(dotted_local.join(defs, (F.col("path") == F.col("d_path")) & (F.col("full") == F.col("d_qualified")))))
    # Receivers: a class named by `typed`, and the classes above it, nearest first.
    typed = code.where("typed is not null and (size(split(written, '[.]')) <= 2 or written is null)").withColumns({"super": F.col("typed").startswith("super="), "class": F.regexp_replace("typed", "^(super)?=", "")})
    classes = symbols.where("language = 'python' and kind = 'class'").select(F.col("path").alias("c_path"), F.col("qualified").alias("c_class"))
    here = typed.join(classes, (F.col("path") == F.col("c_path")) & (F.col("class") == F.col("c_class"))).select(*SITE, "name", "super", "c_path", "c_class")
    binds = imports.where("language = 'python' and alias is not null and via != 'base'").select("path", F.lit("import").alias("tab"), "ord", "written", "alias")
    led = python_imported(binds, files, symbols).join(binds.select("path", "tab", "ord", "alias"), SITE)
    by_import = typed.select(*SITE, "name", "super", "class").join(led.where("d_kind = 'class'").select("path", F.col("alias").alias("class"), F.col("d_path").alias("c_path"), F.col("d_qualified").alias("c_class")), ["path", "class"]).select(*SITE, "name", "super", "c_path", "c_class")
    above = settled(python_ancestors(symbols, imports, files))
    start = here.unionByName(by_import)
    reached = start.where("not super").select(*SITE, "name", "c_path", "c_class", F.lit(0).alias("far")).unionByName(
        start.join(above, (F.col("c_path") == above.path) & (F.col("c_class") == above["class"])).select(*[start[c] for c in SITE], "name", F.col("a_path").alias("c_path"), F.col("a_class").alias("c_class"), "far")
    )
    member = reached.withColumn("full", F.concat_ws(".", "c_class", "name")).join(defs, (F.col("c_path") == F.col("d_path")) & (F.col("full") == F.col("d_qualified")))
    nearest = member.groupBy(*SITE).agg(F.min("far").alias("far"))
    receiver = _hit(member.join(nearest, [*SITE, "far"]))
    # Names that an import of the file binds; those that lead outside stop the search.
    head = F.substring_index(F.coalesce("written", "name"), ".", 1)
    tail = F.regexp_replace(F.coalesce("written", "name"), r"^[^.]*\.?", "")
    every = binds.join(led.select(*SITE, "m_path", "d_qualified"), SITE, "left").select("path", F.col("alias").alias("head"), "m_path", "d_qualified")
    bound = code.where("local is null").withColumns({"head": head, "tail": tail}).join(every, ["path", "head"])
    full = F.when(F.col("d_qualified").isNull(), F.col("tail")).when(F.col("tail") == "", F.col("d_qualified")).otherwise(F.concat_ws(".", "d_qualified", "tail"))
    bound = bound.withColumn("full", F.when(F.col("m_path").isNotNull(), full)).drop("d_qualified")
    imported = _hit(bound.join(defs, (F.col("m_path") == F.col("d_path")) & (F.col("full") == F.col("d_qualified")), "left"))
    stars = imports.where("language = 'python' and glob").select("path", F.lit("import").alias("tab"), "ord", "written")
    star = python_imported(stars, files, symbols).select(F.col("path").alias("s_path"), F.col("m_path"))
    glob = _hit(code.where("local is null and written is null").join(star, F.col("path") == F.col("s_path")).join(defs.where(~F.col("d_qualified").contains(".")), (F.col("m_path") == F.col("d_path")) & (F.col("name") == F.col("d_qualified"))))
    methods = code.where("tab = 'call' and kind = 'method' and local is null")
    unique = _unique(methods, named.where("d_kind = 'method'"), list(library))
    sites_ = own.where("tab = 'import'")
    to = python_imported(sites_.select(*SITE, "written"), files, symbols)
    file_of = symbols.where("kind = 'file'").select(F.col("path").alias("m_path"), F.col("ord").alias("f_ord"))
    named_import = to.join(file_of, "m_path", "left").select(*SITE, target("m_path", F.coalesce("d_ord", "f_ord")).alias("target"))
    receiver = settled(receiver)
    overrides = settled(python_overrides(here, code, symbols, above, receiver))
    return [("scope", scope), ("receiver", receiver), ("import", imported.unionByName(named_import)), ("glob", glob), ("unique", unique), ("override", overrides)]


def python_overrides(typed: DataFrame, code: DataFrame, symbols: DataFrame, above: DataFrame, receiver: DataFrame) -> DataFrame:
    """Members that a use through `self` reaches in subclasses of the class it stands in: of each
    subclass, at any depth, whose instances run the method of the use, the first member of the name in
    its order, unless the class itself reads that one. `typed` has a use's class (c_path, c_class)."""
    written = code.where(r"written rlike '^self\\.[^.]+$' and typed is not null").select(*SITE, "from")
    uses = typed.where("not super").join(written, SITE).withColumn("method", F.when(F.expr("startswith(`from`, c_class || '.')"), F.expr("split(substr(`from`, length(c_class) + 2), '[.]')[0]")))
    asked = uses.select("c_path", "c_class", "name", "method").distinct()
    # Each subclass with its order: itself, then the classes above it.
    classes = symbols.where("language = 'python' and kind = 'class'").select("path", F.col("qualified").alias("class"))
    order = above.select("path", "class", "a_path", "a_class", "far").unionByName(classes.select("path", "class", F.col("path").alias("a_path"), F.col("class").alias("a_class"), F.lit(0).alias("far")))
    below = asked.join(above.select(F.col("a_path").alias("c_path"), F.col("a_class").alias("c_class"), "path", "class", F.col("far").alias("depth")), ["c_path", "c_class"])
    key = ["c_path", "c_class", "method", "path", "class"]
    members = _defs(symbols, "python").where(~F.col("d_kind").isin(*UNNAMED)).select(F.col("d_path").alias("a_path"), F.col("d_qualified").alias("member"), "d_ord")
    along = below.join(order, ["path", "class"])
    # A method of a class before it that does not call on to `super()` keeps the class's own from running.
    on = code.where("startswith(typed, 'super=')").select(F.col("path").alias("a_path"), F.col("from").alias("member"), F.col("name").alias("method")).distinct()
    before = along.where("method is not null and far < depth").select(*key, "a_path", "a_class").distinct().withColumn("member", F.concat_ws(".", "a_class", "method"))
    hidden = before.join(members, ["a_path", "member"]).join(on, ["a_path", "member", "method"], "left_anti").select(*key).distinct()
    read = along.withColumn("member", F.concat_ws(".", "a_class", "name")).join(members, ["a_path", "member"])
    first = read.groupBy(*key, "name").agg(F.min_by(F.struct("a_path", "d_ord"), F.struct("far", "d_ord")).alias("d")).join(hidden, key, "left_anti")
    found = first.select("c_path", "c_class", "name", "method", target("d.a_path", "d.d_ord").alias("target")).distinct()
    same = [uses[c].eqNullSafe(found[c]) for c in ("c_path", "c_class", "name", "method")]
    hits = uses.join(found, same[0] & same[1] & same[2] & same[3]).select(*SITE, "target")
    return hits.join(receiver, [*SITE, "target"], "left_anti")


# Rust


def rust(uses: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame, library: list[str] = (), crates: dict[str, str] | None = None) -> Tiers:
    own = uses.where("language = 'rust' and tab != 'import'")
    defs = _defs(symbols, "rust").where(~F.col("d_kind").isin(*UNNAMED))
    outer = F.regexp_replace(F.coalesce("from", F.lit("")), r"(^|::)[^:]*$", "")
    plain = own.where("kind != 'method' and written is null").withColumn("outer", outer)
    nested = _hit(plain.join(defs, (F.col("path") == F.col("d_path")) & (F.concat_ws("::", "from", "name") == F.col("d_qualified"))))
    module = plain.join(defs, (F.col("path") == F.col("d_path")) & (F.col("name") == F.col("d_name"))).where(F.col("d_qualified").isin(F.col("name")) | (F.concat_ws("::", F.when(F.col("outer") != "", F.col("outer")), "name") == F.col("d_qualified")))
    # Imports by the last two names of their path: a type's or module's item. A hit without a
    # definition leads outside and stops the search.
    named = imports.where("language = 'rust' and not glob").select(F.col("path").alias("i_path"), "alias", F.col("written").alias("i_written"))
    bound = plain.join(named, (F.col("path") == F.col("i_path")) & (F.col("name") == F.col("alias")))
    inside = F.col("i_written").rlike("^(crate|self|super)::")
    imported = _hit(bound.withColumn("last", text.last_segment("i_written")).join(defs, (F.col("last") == F.col("d_name")) & ~F.col("d_qualified").contains("::") & inside, "left"))
    starred = imports.where("language = 'rust' and glob").select(F.col("path").alias("g_path"), text.last_segment("written").alias("g_last"))
    stem = F.regexp_extract("d_path", r"([^/]+?)(?:/mod)?\.rs$", 1)
    glob = _hit(plain.join(starred, F.col("path") == F.col("g_path")).join(defs.withColumn("stem", stem), (F.col("name") == F.col("d_name")) & ((F.col("g_last") == F.col("stem")) | ((F.col("g_last") == "super") & (F.col("path") == F.col("d_path"))))))
    paths = own.where("written is not null and kind != 'method'")
    pair = F.concat_ws("::", F.element_at(F.split("written", "::"), -2), F.element_at(F.split("written", "::"), -1))
    by_self = F.when(F.element_at(F.split("written", "::"), -2) == "Self", F.concat_ws("::", F.element_at(F.split(outer, "::"), -1), "name")).otherwise(pair)
    tail = F.concat_ws("::", F.element_at(F.split("d_qualified", "::"), -2), F.element_at(F.split("d_qualified", "::"), -1))
    pathed = paths.withColumn("pair", by_self).where(F.size(F.split("written", "::")) > 1)
    members = defs.where(F.col("d_qualified").contains("::")).withColumn("tail", tail)
    path = _hit(pathed.join(members, F.col("pair") == F.col("tail")))
    in_module = _hit(pathed.withColumn("module", F.element_at(F.split("written", "::"), -2)).join(defs.where(~F.col("d_qualified").contains("::")).withColumn("stem", stem), (F.col("name") == F.col("d_name")) & (F.col("module") == F.col("stem"))))
    methods = own.where("kind = 'method'")
    on_self = methods.where("receiver = 'self'").withColumn("type", F.element_at(F.split(outer, "::"), -1)).where("type != ''")
    receiver = _hit(on_self.withColumn("pair", F.concat_ws("::", "type", "name")).join(members.where("d_kind = 'method'"), F.col("pair") == F.col("tail"), "left"))
    unique = _unique(methods, defs.where("d_kind = 'method'"), list(library)).unionByName(_unique(plain.where("kind in ('free', 'macro', 'type')"), defs.where(~F.col("d_kind").isin("method", "variant"))))
    by_path, by_import, by_glob, by_use = rust_places(uses, own, defs, files, symbols, imports, crates or {})
    every = uses.where("language = 'rust' and tab = 'import' and kind = 'import'").where(F.col("written").rlike("^(crate|self|super)::"))
    to = _hit(every.join(defs.where(~F.col("d_qualified").contains("::")), F.col("name") == F.col("d_name")))
    return [("nested", nested), ("module", _hit(module)), ("import", by_import.unionByName(by_use)), ("import", imported.unionByName(to)), ("glob", by_glob), ("glob", glob), ("path", by_path), ("path", path.unionByName(in_module)), ("receiver", receiver), ("unique", unique)]


def rust_places(uses: DataFrame, own: DataFrame, defs: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame, crates: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Hits of paths, of names that an import binds, of names under a glob, and of imports themselves, told by
    the whole path from a crate's root. Paths that begin with no crate, self or super go by the import that
    binds their first name, by the library of that name (`crates` has the packages' folders), or by the
    module they stand in."""
    at = places.placed(files, symbols)
    join = lambda *parts: F.concat_ws("::", *[F.when(p != "", p) for p in parts])
    whole = defs.join(at.withColumnRenamed("path", "d_path"), "d_path").select(F.col("crate").alias("to_crate"), join(F.col("module"), F.regexp_replace("d_qualified", r"#\d+", "")).alias("full"), "d_path", "d_ord")
    named = files.sparkSession.createDataFrame(sorted(crates.items()), "head string, library string")
    # Inline modules around a use are part of where it stands.
    inline = symbols.where("language = 'rust' and kind = 'module' and not declared").select("path", F.col("qualified").alias("around"))
    holders = uses.where("language = 'rust' and `from` is not null").select("path", "from").distinct()
    inner = holders.join(inline, "path").where("`from` = around or startswith(`from`, around || '::')").groupBy("path", "from").agg(F.max_by("around", F.length("around")).alias("around"))

    def standing(rows: DataFrame) -> DataFrame:
        """Rows with their crate, and where `written` leads as (to_crate, full) for each way to read it."""
        out = rows.join(inner, ["path", "from"], "left").join(at, "path").withColumn("here", join(F.col("module"), F.coalesce("around", F.lit(""))))
        out = out.withColumns({"full": places.absolute(F.col("written"), F.col("here")), "head": F.substring_index("written", "::", 1)}).drop("module", "around")
        beside = out.withColumns({"to_crate": F.col("crate"), "full": F.coalesce("full", join(F.col("here"), F.col("written")))})
        far = out.where("full is null").join(named, "head").withColumns({"to_crate": F.col("library"), "full": F.expr("substr(written, length(head) + 3)")}).drop("library")
        return beside.unionByName(far)

    def led(rows: DataFrame) -> DataFrame:
        return _hit(rows.where("full is not null").join(whole, ["to_crate", "full"]))

    bound = standing(imports.where("language = 'rust'").select("path", F.col("importer").alias("from"), "written", "alias", "glob"))
    names = bound.where("not glob").select("path", "crate", F.coalesce("alias", text.last_segment("written")).alias("head"), "to_crate", F.col("full").alias("to")).distinct()
    globs = bound.where("glob").select("path", "crate", "to_crate", F.col("full").alias("to")).distinct()
    columns = [*SITE, "to_crate", "full"]
    paths = standing(own.where("written is not null and kind != 'method'").select(*SITE, "from", "name", "written"))
    relative = paths.where("head not in ('crate', 'self', 'super')").select(*SITE, "crate", "head", "written").distinct()
    through = relative.join(names, ["path", "crate", "head"]).withColumn("full", join(F.col("to"), F.expr("substr(written, length(head) + 3)")))
    by_path = led(paths.select(*columns).unionByName(through.select(*columns)))
    plain = own.where("written is null and kind != 'method'").select(*SITE, "name").join(at.select("path", "crate"), "path")
    by_import = led(plain.withColumnRenamed("name", "head").join(names, ["path", "crate", "head"]).withColumn("full", F.col("to")))
    by_glob = led(plain.join(globs, ["path", "crate"]).withColumn("full", join(F.col("to"), F.col("name"))))
    by_use = led(standing(uses.where("language = 'rust' and tab = 'import' and kind = 'import'").select(*SITE, "from", "written")))
    return by_path, by_import, by_glob, by_use


# C


def included(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) of includes that name a file of the worktree: beside the file, else by the path's tail."""
    inc = imports.where("language = 'c'").select(F.col("path").alias("src"), "written")
    beside = inc.withColumn("dst", text.folded("written", "src")).join(files.select(F.col("path").alias("dst")), "dst").select("src", "written", "dst")
    tails = suffixes(files.where("language = 'c'").select(F.col("path").alias("dst")), "dst", "written")
    other = inc.join(beside.select("src", "written"), ["src", "written"], "left_anti").join(tails, "written").select("src", "written", "dst")
    return beside.unionByName(other).select("src", "dst").distinct()


def c(uses: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame) -> Tiers:
    own = uses.where("language = 'c' and tab != 'import'")
    rank = F.when(F.col("d_kind") == "declaration", 1).otherwise(0)
    defs = _defs(symbols, "c").where(~F.col("d_kind").isin(*UNNAMED)).withColumn("rank", rank)
    wanted = F.when(F.col("tab") == "call", F.col("d_kind").isin("function", "declaration", "macro", "variable")).when(F.col("kind") == "type", F.col("d_kind").isin(*TYPES)).otherwise(F.lit(True))

    def best(rows: DataFrame) -> DataFrame:
        least = rows.groupBy(*SITE).agg(F.min("rank").alias("rank"))
        return _hit(rows.join(least, [*SITE, "rank"]))

    direct = own.where("kind != 'method'")
    named = direct.join(defs, F.col("name") == F.col("d_name")).where(wanted)
    reach = graph.closure(included(imports, files))
    forward = reach.select(F.col("src").alias("path"), F.col("dst").alias("d_path"))
    backward = reach.select(F.col("dst").alias("path"), F.col("src").alias("d_path"))
    whole = named.where((F.col("rank") == 0) & ~F.col("d_internal"))
    scope = best(named.where((F.col("path") == F.col("d_path")) & (F.col("rank") == 0)))
    # A prototype stands for the definition behind it, where there is one.
    seen = named.join(forward, ["path", "d_path"])
    behind = seen.where("rank = 1").select(*SITE).distinct().join(whole, SITE)
    near = best(seen.where("rank = 0").unionByName(behind.select(*seen.columns)))
    includers = best(named.join(backward, ["path", "d_path"]).where("rank = 0"))
    anywhere = best(whole)
    own_proto = best(named.where((F.col("path") == F.col("d_path")) & (F.col("rank") == 1)).unionByName(named.join(forward, ["path", "d_path"]).where("rank = 1").select(*named.columns)))
    # Functions assigned to a field are what calls through the field may reach.
    stored = own.where("kind = 'set' and written is not null").select(F.col("written").alias("field"), F.col("name").alias("function"))
    fields = own.where("kind = 'method'").join(stored.distinct(), F.col("name") == F.col("field")).join(defs.where("d_kind = 'function'"), F.col("function") == F.col("d_name"))
    guards = uses.where("language = 'c' and tab = 'import'")
    file_of = symbols.where("kind = 'file'").select(F.col("path").alias("dst"), F.col("ord").alias("f_ord"))
    inc = imports.where("language = 'c'").select(F.col("path").alias("src"), "ord", "written")
    to = guards.join(inc.join(included(imports, files), "src").where(F.col("dst") == text.folded("written", "src")).unionByName(inc.join(included(imports, files), "src").where(F.col("dst").endswith(F.col("written")))).distinct().join(file_of, "dst").select(F.col("src").alias("path"), "ord", "dst", "f_ord"), ["path", "ord"])
    links = to.select(*SITE, target("dst", "f_ord").alias("target"))
    return [("scope", scope), ("include", near.unionByName(links)), ("include", includers), ("unique", anywhere), ("include", own_proto), ("field", _hit(fields))]


# Bash


def sourced(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) of scripts sourced: the path beside the script or from the root, else by its tail after a variable."""
    src = imports.where("language = 'bash'").select(F.col("path").alias("src"), "ord", F.regexp_replace("written", r"^\$\{?\w+\}?/|^\$\([^)]*\)/", "").alias("tail"))
    one = src.withColumn("dst", text.folded("tail", "src"))
    known = files.select(F.col("path").alias("dst"))
    beside = one.join(known, "dst").select("src", "ord", "dst")
    other = src.join(beside.select("src", "ord"), ["src", "ord"], "left_anti").join(suffixes(known, "dst", "tail"), "tail").select("src", "ord", "dst")
    return beside.unionByName(other)


def bash(uses: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame) -> Tiers:
    own = uses.where("language = 'bash' and tab != 'import'")
    defs = _defs(symbols, "bash").where(~F.col("d_kind").isin(*UNNAMED))
    wanted = F.when(F.col("tab") == "call", F.col("d_kind") == "function").otherwise(F.col("d_kind").isin("variable", "environment"))
    plain = own.where("written is null")
    named = plain.join(defs, F.col("name") == F.col("d_name")).where(wanted)
    local = F.col("d_qualified") == F.concat_ws("::", "from", "name")
    scope = _hit(named.where((F.col("path") == F.col("d_path")) & local)).unionByName(_hit(named.where((F.col("path") == F.col("d_path")) & ~F.col("d_internal")).join(named.where((F.col("path") == F.col("d_path")) & local).select(*SITE).distinct(), SITE, "left_anti")))
    links = sourced(imports, files)
    down = graph.closure(links.select("src", "dst"))
    up = down.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    beside = up.join(down.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
    loaded = down.unionByName(up).unionByName(beside).where("src != dst").distinct().select(F.col("src").alias("path"), F.col("dst").alias("d_path"))
    source = _hit(named.where(~F.col("d_internal")).join(loaded, ["path", "d_path"]))
    unique = _hit(named.where((F.col("d_kind") == "function")))
    environment = _hit(named.where("d_kind = 'environment'"))
    globbed = own.where("written is not null and tab = 'call'").withColumn("pattern", F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("written", r"[.+()\[\]{}^$|?\\]", r"\\$0"), r"\*", ".*"), F.lit("$")))
    # A computed name may be any function its pattern fits; they meet by the text before the first star.
    heads = defs.where("d_kind = 'function'").withColumn("head", F.explode(F.transform(F.sequence(F.lit(0), F.length("d_name")), lambda n: F.substring("d_name", F.lit(1), n))))
    computed = _hit(globbed.withColumn("head", F.substring_index("written", "*", 1)).join(heads, "head").where(F.expr("d_name rlike pattern")))
    # A variable a function does not bind may be a caller's.
    callers = _hit(plain.where("tab = 'ref'").join(uses.where("language = 'bash' and tab = 'call'").select(F.col("name").alias("from"), F.col("from").alias("above")), "from").withColumn("full", F.concat_ws("::", "above", "name")).join(defs, F.col("full") == F.col("d_qualified")))
    file_of = symbols.where("kind = 'file'").select(F.col("path").alias("dst"), F.col("ord").alias("f_ord"))
    to = uses.where("language = 'bash' and tab = 'import'").join(links.withColumnRenamed("src", "path"), ["path", "ord"]).join(file_of, "dst").select(*SITE, target("dst", "f_ord").alias("target"))
    return [("scope", scope), ("source", source), ("unique", unique), ("environment", environment), ("caller", callers), ("computed", computed), ("file", to)]


# Nix


def nix(uses: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame) -> Tiers:
    own = uses.where("language = 'nix' and tab != 'import'")
    defs = _defs(symbols, "nix").where(~F.col("d_kind").isin(*UNNAMED))
    scope = _hit(own.where("written is null").join(defs, (F.col("path") == F.col("d_path")) & (F.col("name") == F.col("d_qualified"))))
    # Option paths: the longest declared path that the use's path begins with, by explosion of prefixes.
    written = own.where("written like 'config.%'").withColumn("full", F.regexp_replace("written", r"^config\.", ""))
    cut = F.split("full", r"\.")
    tried = written.select(*SITE, F.explode(F.transform(F.sequence(F.lit(1), F.size(cut)), lambda k: F.array_join(F.slice(F.split("full", r"\."), 1, k), "."))).alias("d_qualified"))
    options = tried.join(defs.where("d_kind = 'option'"), "d_qualified")
    longest = options.groupBy(*SITE).agg(F.max(F.length("d_qualified")).alias("n"))
    option = _hit(options.join(longest, SITE).where(F.length("d_qualified") == F.col("n")))
    inputs = own.where("written like 'inputs.%'").withColumn("full", F.concat_ws(".", F.lit("inputs"), F.element_at(F.split("written", r"\."), 2)))
    input_ = _hit(inputs.join(defs.where("d_kind = 'input'"), F.col("full") == F.col("d_qualified")))
    # Heads of paths that lead outside.
    outside = ("pkgs", "lib", "builtins", "final", "prev", "self", "super", "options")
    last = own.where("written is not null").where(~F.substring_index("written", ".", 1).isin(*outside))
    only = defs.groupBy("d_name").agg(F.count("*").alias("n")).where("n = 1").select("d_name")
    unique = _unique(last, defs.join(only, "d_name", "left_semi"))
    links = imports.where("language = 'nix'").select("path", "ord", text.folded("written", "path").alias("to"))
    known = symbols.where("language = 'nix' and kind = 'file'").select(F.col("path").alias("dst"), F.col("ord").alias("f_ord"))
    either = links.unionByName(links.withColumn("to", F.concat("to", F.lit("/default.nix"))))
    to = either.join(known, F.col("to") == F.col("dst"))
    file_ = to.select("path", F.lit("import").alias("tab"), "ord", target("dst", "f_ord").alias("target"))
    return [("scope", scope), ("option", option), ("input", input_), ("unique", unique), ("file", file_)]


def nix_settings(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bindings that set a declared option, as sites resolved to it: (path, tab `set`, ord of the binding, target)."""
    defs = _defs(symbols, "nix")
    binds = symbols.where("language = 'nix' and kind in ('attribute', 'function') and not path like '%flake.nix'").select("path", F.lit("set").alias("tab"), "ord", F.regexp_replace("qualified", r"^config\.|#\d+$", "").alias("full"))
    return _hit(binds.join(defs.where("d_kind = 'option'"), F.col("full") == F.col("d_qualified")))


# Markdown


def markdown(uses: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame) -> Tiers:
    own = uses.where("language = 'markdown'")
    known = symbols.where("kind = 'file'").select(F.col("path").alias("d_path"), F.col("ord").alias("d_ord"))
    links = own.where("tab = 'import'").withColumns({"to": F.substring_index("written", "#", 1), "fragment": F.when(F.col("written").contains("#"), F.substring_index("written", "#", -1))})
    links = links.withColumn("at", F.when(F.col("to") == "", F.col("path")).otherwise(text.folded(text.decoded("to"), "path")))
    anchors = symbols.where("language = 'markdown' and kind in ('section', 'anchor')").select(F.col("path").alias("d_path"), F.col("ord").alias("d_ord"), "qualified")
    lines = symbols.where("language != 'markdown' and kind not in ('file', 'anchor')").select(F.col("path").alias("d_path"), F.col("ord").alias("d_ord"), "start", "end")
    line = F.regexp_extract("fragment", r"^L(\d+)", 1)
    coded = links.where(F.col("fragment").rlike(r"^L\d+")).withColumn("at_line", line.cast("int")).join(lines, (F.col("at") == F.col("d_path")) & (F.col("at_line") >= F.col("start")) & (F.col("at_line") <= F.col("end")))
    inner = coded.groupBy(*SITE).agg(F.max_by(F.struct("d_path", "d_ord"), F.struct("start", -F.col("end"))).alias("d")).select(*SITE, F.col("d.d_path").alias("d_path"), F.col("d.d_ord").alias("d_ord"))
    anchor = _hit(links.where("fragment is not null").join(anchors, (F.col("at") == F.col("d_path")) & (F.lower("fragment") == F.col("qualified")))).unionByName(_hit(inner))
    file_ = _hit(links.where("fragment is null").join(known, F.col("at") == F.col("d_path")))
    paths = own.where("tab = 'ref' and kind = 'path'")
    near = _hit(paths.withColumn("at", text.folded("written", "path")).join(known, F.col("at") == F.col("d_path")))
    root = _hit(paths.join(known, F.col("written") == F.col("d_path")))
    tails = suffixes(known, "d_path", "tail")
    tail = _hit(paths.withColumn("bare", F.regexp_replace("written", r"^(\./)+", "")).join(tails, F.col("bare") == F.col("tail")))
    names = own.where("kind = 'mention'")
    every = symbols.where(~F.col("kind").isin(*UNNAMED) & ~text.test_file("path") & (F.col("kind") != "declaration") & (F.col("language") != "markdown"))
    every = every.select(F.col("path").alias("d_path"), F.col("ord").alias("d_ord"), F.col("name").alias("d_name"), F.col("qualified").alias("d_qualified"))
    dots = F.regexp_replace("written", "::", ".")
    full = F.regexp_replace(F.regexp_replace("d_qualified", r"#\d+$", ""), "::", ".")
    unique = _hit(names.join(every, F.col("name") == F.col("d_name")).where((full == dots) | full.endswith(F.concat(F.lit("."), dots))))
    return [("anchor", anchor), ("file", file_), ("file", near), ("file", root), ("file", tail), ("unique", unique)]


def resolved(files: DataFrame, symbols: DataFrame, calls: DataFrame, refs: DataFrame, imports: DataFrame, libraries: dict[str, list[str]] | None = None, crates: dict[str, str] | None = None) -> DataFrame:
    """All sites with status, rule and targets (path, ord). Tables hold the facts of each file (path, language)."""
    uses = sites(calls, refs, imports)
    have = {r.language for r in files.select("language").distinct().collect()}
    libraries = library_names.METHODS | (libraries or {})
    every: DataFrame | None = None
    makers = {"python": lambda: python(uses, files, symbols, imports, libraries.get("python", [])), "rust": lambda: rust(uses, files, symbols, imports, libraries.get("rust", []), crates), "c": lambda: c(uses, files, symbols, imports), "bash": lambda: bash(uses, files, symbols, imports), "nix": lambda: nix(uses, files, symbols, imports), "markdown": lambda: markdown(uses, files, symbols, imports)}
    for language, make in makers.items():
        if language in have:
            own, made = uses.where(F.col("language") == language), make()
            rows = tiers.first_tier(own, [t for t in made if t[0] != "override"], SITE, "target")
            for rule, hits in made:
                if rule == "override":
                    # Each is an edge of its own, beside what the use reaches itself if that is anything.
                    rows = rows.join(hits.withColumn("status", F.lit("external")), [*SITE, "status"], "left_anti").unionByName(own.join(hits, SITE).select("*", F.lit("resolved").alias("status"), F.lit(rule).alias("rule"), F.array("target").alias("targets")).drop("target"))
            every = rows if every is None else every.unionByName(rows)
    return every if every is not None else uses.limit(0).withColumns({"status": F.lit("external"), "rule": F.lit(None).cast("string"), "targets": F.array().cast("array<struct<path:string,ord:int>>")})
