"""The nine questions over a worktree's facts.

Facts are kept as Parquet by content: a check extracts only blobs the store does not hold, and
appends them. Questions deal the facts of contents to the files that hold them, resolve, and
answer with lines of a rank that the budget cuts.
"""

from __future__ import annotations

import os
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant import schemas
from sextant.extract import VERSION, extract
from sextant.functions import text
from sextant.operators import graph, history, intervals, ranking, render, search, store
from sextant.resolve import cargo, live
from sextant.resolve import edges as resolve
from sextant.session import settled, shipped
from sextant.sources import git

HIDDEN = ("anchor", "impl")
HOLDERS = ("function", "method", "class", "module", "struct", "trait", "section", "attribute", "option", "macro", "const", "static", "variable", "enum")


class Refused(Exception):
    """A question that cannot be answered; says what came nearest."""


@dataclass
class Answer:
    """Lines of an answer, and what was cut."""

    query: str
    root: str
    lines: list[dict] = field(default_factory=list)
    budget: int = 2000

    def add(self, text_: str, rank: int, part: str, heads: int = 0) -> None:
        self.lines.append({"text": text_, "rank": rank, "part": part, "heads": heads})

    def render(self) -> str:
        return "\n".join(render.rendered(self.lines, f"{self.query} in {self.root}", self.budget)[0])

    def json(self) -> dict:
        lines, cut = render.rendered(self.lines, f"{self.query} in {self.root}", self.budget)
        return {"query": self.query, "root": self.root, "results": lines[1:] if not cut else lines[1:-1], "cut": cut}


class Engine:
    def __init__(self, spark: SparkSession, folder: str, kept: str):
        shipped(spark)
        self.spark, self.root, self.kept = spark, git.toplevel(folder), kept.rstrip("/")

    # Tables.

    def _read(self, name: str, schema=None) -> DataFrame | None:
        path = f"{self.kept}/{name}"
        return self.spark.read.parquet(path) if store.exists(self.spark, path) else None

    def check(self) -> dict[str, int]:
        """Read what changed since the last check: counters listed, hashed, extracted, gone."""
        now = time.time_ns()
        listed = git.listing(self.spark, self.root)
        files, facts = self._read("files"), self._read("facts")
        known = files if files is not None else self.spark.createDataFrame([], "path string, size long, mtime long, ctime long, inode long, content string, language string, extractor string, seen long")
        stale = store.stale(listed, known, VERSION).cache()
        fresh = [r.path for r in stale.where("why is not null").select("path").collect()]
        lost = store.gone(listed, known).count()
        if not fresh and not lost:
            return store.counters(stale, 0, 0)
        read = git.contents(self.spark, self.root, fresh).where("language is not null").cache()
        have = facts.select("blob", "language").withColumn("extractor", F.lit(VERSION)) if facts is not None else self.spark.createDataFrame([], "blob string, language string, extractor string")
        new = store.unknown(read, have, VERSION)
        todo = read.dropDuplicates(["blob", "language"]).join(new, ["blob", "language"])
        made = git.extracted(todo, extract).cache()
        n = made.count()
        if n:
            made.write.mode("append").partitionBy("language").parquet(f"{self.kept}/facts")
        stat = stale.where("why is not null").drop("content", "why").join(read.select("path", F.col("blob").alias("content"), "language"), "path", "left")
        rows = stat.withColumns({"extractor": F.lit(VERSION), "seen": F.lit(now)})
        held = known.join(listed.select("path"), "path", "left_semi")
        columns = ["path", "size", "mtime", "ctime", "inode", "content", "language", "extractor", "seen"]
        out = settled(store.upserted(held.select(*columns), rows.select(*columns), ["path"]))
        out.write.mode("overwrite").parquet(f"{self.kept}/files")
        counters = store.counters(stale, n, lost)
        for df in (stale, read, made):
            df.unpersist()
        return counters

    def files(self) -> DataFrame:
        rows = self._read("files")
        if rows is None:
            self.check()
            rows = self._read("files")
        return rows.where("language is not null").select("path", "language", F.col("content").alias("blob"))

    def _dealt(self, part: str) -> DataFrame:
        """A table of facts dealt to the files that hold their contents."""
        facts = self._read("facts").select("blob", "language", F.explode(part).alias("f"))
        rows = self.files().join(facts, ["blob", "language"])
        own = [f.name for f in schemas.EXTRACTION[part].dataType.elementType.fields]
        return rows.select("language", "path", *[F.col(f"f.{c}").alias("written" if c == "path" else c) for c in own])

    def symbols(self) -> DataFrame:
        return self._dealt("symbols")

    def edges(self) -> DataFrame:
        """All uses with what they reach, kept under the worktree's digest."""
        return store.kept_view(self.spark, self.kept, "edges", f"{VERSION}-{self.digest()}", self._resolved)

    def _resolved(self) -> DataFrame:
        parts = {p: self._dealt(p) for p in ("symbols", "calls", "refs", "imports", "branches")}
        manifests = cargo.read(self.root, [r.path for r in self._manifests().select("path").collect()])
        on = cargo.features(manifests, live.RUST)
        roots = {r.path for r in self.files().where("language = 'rust'").select("path").collect()} if any(m.get(k) for m in manifests.values() for k in cargo.ROOTS) else set()
        # Tiers read these tables many times each, so they are dealt to files once.
        symbols = settled(live.live(parts["symbols"], parts["branches"], on, cargo.skipped(manifests, on, roots)))
        return resolve.resolved(self.files(), symbols, *(settled(parts[p]) for p in ("calls", "refs", "imports")), crates=cargo.libraries(manifests))

    def _manifests(self) -> DataFrame:
        self.files()
        return self._read("files").where(F.col("path").rlike(r"(^|/)Cargo\.toml$")).select("path", F.col("content").alias("blob"))

    def digest(self) -> str:
        """Digest of the files that answers depend on: those of a language, and manifests."""
        row = store.digest(self.files().select("path", "blob").unionByName(self._manifests()).withColumn("all", F.lit(1)), ["all"], "path", "blob").first()
        return row.digest if row else ""

    def graph(self) -> DataFrame:
        """Weighted edges between definitions, kept under the worktree's digest. Ids are `path\\tord`."""

        def make() -> DataFrame:
            owned = self.owned(self.edges().where("size(targets) > 0 and tab != 'import'"))
            status, n = F.col("status"), F.size("targets")
            w = graph.use_weight(status, n, F.col("use").startswith("call method") & (status == "ambiguous") & (n > 8))
            rows = owned.select(F.concat_ws("\t", "path", "o_ord").alias("src"), F.explode("targets").alias("t"), w.alias("w"))
            return graph.combined(rows.select("src", F.concat_ws("\t", "t.path", "t.ord").alias("dst"), "w"))

        return store.kept_view(self.spark, self.kept, "graph", f"{VERSION}-{self.digest()}", make)

    def owned(self, edges: DataFrame) -> DataFrame:
        """Edges with o_ord, the definition that holds the use: the one `from` names, else the innermost around the line, else the file."""
        symbols = self.symbols()
        named = symbols.select(F.col("path").alias("n_path"), F.col("qualified").alias("n_qualified"), F.col("ord").alias("n_ord"))
        rows = edges.join(named, (F.col("path") == F.col("n_path")) & (F.col("from") == F.col("n_qualified")), "left").drop("n_path", "n_qualified")
        spans = symbols.where(~F.col("kind").isin("file", "anchor", "impl", "argument")).select("path", "start", "end", F.col("ord").alias("i_ord"))
        points = rows.where("n_ord is null").select("path", "line").distinct()
        inner = intervals.innermost(points, spans, ["path"], "line", ["path", "line"], "i_ord").select("path", "line", "i_ord")
        top = symbols.where("kind = 'file'").select("path", F.col("ord").alias("f_ord"))
        return rows.join(inner, ["path", "line"], "left").join(top, "path", "left").withColumn("o_ord", F.coalesce("n_ord", "i_ord", "f_ord")).drop("n_ord", "i_ord", "f_ord")

    # Names.

    def find(self, name: str) -> list:
        """Definitions a name means: a file, `file:line`, `file#anchor`, `file:name`, or the tail of a full name."""
        symbols = self.symbols()
        file_, mark, rest = name.partition("#")
        m = re.fullmatch(r"([^:]+):(\d+)", name)
        if m:
            at = symbols.where((F.col("path") == m[1]) & (F.col("start") <= int(m[2])) & (F.col("end") >= int(m[2])) & (F.col("kind") != "anchor"))
            return at.orderBy(F.desc("start"), "end", "ord").limit(1).collect()
        own = symbols.where((F.col("path") == name) | F.col("path").endswith("/" + name)).where("kind = 'file'").orderBy("path").collect()
        if own:
            return own
        if mark and re.search(r"\.(md|markdown)$", file_):
            return symbols.where((F.col("path") == file_) & (F.col("qualified") == rest)).collect()
        where = F.lit(True)
        m = re.fullmatch(r"([^:]+):([^:].*)", name)
        if m:
            where, name = (F.col("path") == m[1]) | F.col("path").endswith("/" + m[1]), m[2]
        segments = [s for s in re.split(r"::|\.", name) if s]
        # The whole name of a module-level definition begins with its file's module.
        whole = F.concat_ws(".", text.module_name(F.regexp_replace("path", r"\.\w+$", "")), F.regexp_replace("qualified", "::", "."))
        hits = symbols.where(where & ~F.col("kind").isin("file", "anchor")).where(text.suffix_matches(whole, segments) | ((F.col("kind") == "section") & (F.lower("name") == name.lower())))
        code = F.when(F.col("kind").isin("section"), 1).otherwise(0)
        found = hits.withColumn("code", code).orderBy("code", F.when(F.col("kind") == "declaration", 1).otherwise(0), F.size(F.split("qualified", r"::|\.")), "path", "start", "ord").collect()
        return [r for r in found if r.code == found[0].code]

    def targets(self, name: str) -> list:
        found = self.find(name)
        if not found:
            near = ", ".join(r.qualified for r in self.nearest(name))
            raise Refused(f"no definition of {name}" + (f"; the nearest: {near}" if near else ""))
        return found

    def nearest(self, name: str, most: int = 8) -> list:
        wanted = re.split(r"::|\.", name)[-1].lower()
        low = F.lower("name")
        far = F.when(low.contains(wanted) | F.lit(wanted).contains(low), 0).otherwise(F.levenshtein(low, F.lit(wanted)))
        rows = self.symbols().where((F.col("name") != "") & ~F.col("kind").isin(*HIDDEN)).withColumn("far", far).where(F.col("far") <= max(1, len(wanted) // 3))
        return rows.orderBy("far", F.length("qualified"), "path", "start").limit(most).collect()

    def _lines(self, path: str) -> list[str]:
        with open(os.path.join(self.root, path), errors="replace") as f:
            return f.read().split("\n")

    def signature(self, row, lines: list[str] | None = None) -> str:
        """The definition's head, up to its body, joined to one line of 200 characters at most."""
        if row.kind in ("file", "section"):
            return ""
        lines = (self._lines(row.path) if lines is None else lines)[row.start - 1 : min(row.end, row.start + 7)]
        out = []
        for line in lines:
            bare = re.sub(r"\s*(//|#(?!\[|include|define|if|else|endif)).*$", "", line) if row.language != "nix" else line.split("#")[0]
            cut = bare.find("{") if row.language in ("rust", "c") else -1
            out.append((bare[:cut] if cut >= 0 else bare).strip())
            if cut >= 0 or (row.language == "python" and bare.rstrip().endswith(":")) or bare.rstrip().endswith(";") or row.language in ("nix", "bash"):
                break
        return " ".join(filter(None, out))[:200].strip()

    @staticmethod
    def place(row) -> str:
        span = f"{row.start}" if row.start == row.end else f"{row.start}-{row.end}"
        return f"{row.path}:{span} {row.kind} {row.qualified or row.path}"

    # Questions.

    def def_(self, name: str, budget: int = 2000) -> Answer:
        """Where a name is defined, its first sentence and signature."""
        found, out = self.targets(name), Answer(f"def {name}", self.root, budget=budget)
        docs = {(r.path, r.ord): r.s for r in self.spark.createDataFrame([(r.path, r.ord, r.doc) for r in found], "path string, ord int, doc string").select("path", "ord", text.first_sentence("doc").alias("s")).collect()}
        for n, r in enumerate(sorted(found, key=lambda r: (r.kind == "declaration", r.path, r.start, r.ord))):
            tier = 1 if r.kind == "declaration" else 5
            rows = [self.place(r), *([f"  /// {docs[(r.path, r.ord)]}"] if docs[(r.path, r.ord)] else []), *([f"  {s}"] if (s := self.signature(r)) else [])]
            for line in rows:
                out.add(line, tier * 100_000 - n, "definitions")
            if r.kind in ("struct", "enum", "union"):
                for i in self.symbols().where((F.col("kind") == "impl") & (F.col("typed") == r.name) & (F.col("language") == "rust")).orderBy("path", "start").collect():
                    out.add(f"  {self.place(i)}", 200_000 - n, "impl blocks")
        return out

    def _found_frame(self, found: list) -> DataFrame:
        return self.spark.createDataFrame([(r.path, r.ord) for r in found], "t_path string, t_ord int")

    def uses_of(self, found: list) -> DataFrame:
        """Edges that may reach one of the definitions, with the target met."""
        edges = self.edges().select("*", F.explode("targets").alias("t"))
        return edges.join(F.broadcast(self._found_frame(found)), (F.col("t.path") == F.col("t_path")) & (F.col("t.ord") == F.col("t_ord")))

    def callers(self, name: str, budget: int = 2000) -> Answer:
        """What uses a definition, by the definitions that hold the uses."""
        found, out = self.targets(name), Answer(f"callers {name}", self.root, budget=budget)
        rows = self.owned(self.uses_of(found).drop("t"))
        label = F.when(F.col("use").startswith("call"), "call").when(F.col("use") == "import", "use").when(F.col("use") == "link", "link").when(F.col("use") == "mention", "mention").when(F.col("use") == "setting", "set").otherwise("ref")
        grouped = rows.groupBy("t_path", "t_ord", "path", "o_ord", F.size("targets").alias("n")).agg(F.array_sort(F.collect_set(F.struct(label.alias("how"), "line"))).alias("uses"))
        symbols = self.symbols().select("path", F.col("ord").alias("o_ord"), "qualified", "kind", "start", "end")
        held = grouped.join(symbols, ["path", "o_ord"]).orderBy("path", "start", "o_ord").collect()
        for r in found:
            own = [h for h in held if (h.t_path, h.t_ord) == (r.path, r.ord)]
            sure, possible = [h for h in own if h.n == 1], [h for h in own if h.n > 1]
            out.add(f"{self.place(r)}: {len(sure)} caller{'s' * (len(sure) != 1)}, {len(possible)} possible", 500_000, "definitions", heads=len(own))
            for k, (h, mark) in enumerate([*((h, "") for h in sure), *((h, "possible: ") for h in possible)]):
                uses: dict[str, list[str]] = {}
                for u in h.uses:
                    uses.setdefault(u.how, []).append(str(u.line))
                said = "; ".join(f"{how} {', '.join(lines)}" for how, lines in uses.items())
                out.add(f"  {mark}{h.path} {h.qualified or 'top'}: {said}" + (f" (one of {h.n})" if mark else ""), (200_000 if mark else 400_000) - k, "possible callers" if mark else "callers")
        return out

    def callees(self, name: str, budget: int = 2000) -> Answer:
        """What a definition uses: sure, possible, and names that lead outside."""
        found, out = self.targets(name), Answer(f"callees {name}", self.root, budget=budget)
        keys = F.broadcast(self._found_frame(found))
        rows = self.owned(self.edges().where("tab != 'import'"))
        if not any(r.kind == "file" for r in found):
            rows = rows.join(keys, (F.col("path") == F.col("t_path")) & (F.col("o_ord") == F.col("t_ord")), "left_semi")
        else:
            rows = rows.join(keys, F.col("path") == F.col("t_path"), "left_semi")
        rows = settled(rows)
        symbols = self.symbols().select(F.col("path").alias("s_path"), F.col("ord").alias("s_ord"), "qualified", F.col("kind").alias("s_kind"), "start", "end")
        sure = rows.where("status = 'resolved'").select("line", F.col("targets")[0].alias("t")).join(symbols, (F.col("t.path") == F.col("s_path")) & (F.col("t.ord") == F.col("s_ord"))).groupBy("s_path", "qualified", "s_kind", "start", "end").agg(F.sort_array(F.collect_set("line")).alias("lines")).orderBy("s_path", "start").collect()
        possible = rows.where("status = 'ambiguous'").groupBy("name").agg(F.max(F.size("targets")).alias("n"), F.sort_array(F.collect_set("line")).alias("lines")).orderBy("name").collect()
        outside = [r.name for r in rows.where("status = 'external' and tab = 'call'").select(F.when(F.col("kind") == "method", F.concat(F.lit("."), "name")).when(F.col("kind") == "macro", F.concat("name", F.lit("!"))).otherwise(F.coalesce("written", "name")).alias("name")).distinct().orderBy("name").collect()]
        for r in found:
            out.add(f"{self.place(r)}: {len(sure)} callee{'s' * (len(sure) != 1)}", 500_000, "definitions")
        for k, s in enumerate(sure):
            out.add(f"  {s.s_path}:{s.start} {s.s_kind} {s.qualified or s.s_path}: {', '.join(map(str, s.lines))}", 400_000 - k, "callees")
        for k, p in enumerate(possible):
            out.add(f"  possible: {p.name} (one of {p.n}): {', '.join(map(str, p.lines))}", 200_000 - k, "possible callees")
        if outside:
            out.add("  outside: " + ", ".join(outside), 100_000, "outside")
        return out

    def outline(self, path: str, budget: int = 2000) -> Answer:
        """What a file holds, nested: variants and members under what holds them."""
        found = [r for r in self.find(path) if r.kind == "file"]
        if not found:
            raise Refused(f"no file {path}")
        path, out = found[0].path, Answer(f"outline {path}", self.root, budget=budget)
        rows = [r for r in self.symbols().where((F.col("path") == path) & ~F.col("kind").isin("file", "anchor", "argument")).orderBy("start", F.desc("end"), "ord").collect()]
        out.add(f"{path}: {found[0].end} lines, {len(rows)} symbols", 500_000, "file")
        stack: list = []
        by_name = {r.qualified: 0 for r in rows}
        for k, r in enumerate(rows):
            while stack and not (stack[-1].end >= r.end and stack[-1].start <= r.start):
                stack.pop()
            depth = len(stack)
            if not stack and "." in r.qualified and r.qualified.rpartition(".")[0] in by_name:
                depth = by_name[r.qualified.rpartition(".")[0]] + 1
            by_name[r.qualified] = depth
            stack.append(r)
            span = f"{r.start}" if r.start == r.end else f"{r.start}-{r.end}"
            out.add(f"{'  ' * (depth + 1)}{span} {r.kind} {r.name}", {0: 3, 1: 2}.get(depth, 1) * 100_000 - k, "symbols")
        return out

    def impact(self, name: str, depth: int = 3, budget: int = 2000) -> Answer:
        """Callers of callers, level by level; ambiguous uses are counted, not followed."""
        found, out = self.targets(name), Answer(f"impact {name} --depth {depth}", self.root, budget=budget)
        key = lambda p, o: F.concat_ws("\t", p, o)
        every = self.edges().where("tab != 'import'")
        rows = self.owned(every.where("status = 'resolved'"))
        sure = rows.select(key("path", "o_ord").alias("dst"), key(F.col("targets")[0]["path"], F.col("targets")[0]["ord"]).alias("src"))
        tops = self.symbols().where("kind = 'file'").select("path", F.col("ord").alias("f_ord"))
        members = self.symbols().where("kind != 'file'").join(tops, "path").select(key("path", "ord").alias("src"), key("path", "f_ord").alias("file"))
        steps = settled(sure.distinct())
        start = self.spark.createDataFrame([(f"{r.path}\t{r.ord}",) for r in found], "id string")
        reached = graph.levels(steps, start, 1)
        if depth > 1:
            # A caller that is reached brings its file's definition to the next level.
            by_file = members.join(steps.withColumnRenamed("src", "file"), "file").select("dst", "src")
            further = graph.levels(steps.unionByName(by_file).distinct(), reached.where("level = 1").select("id"), min(depth, graph.DEEPEST) - 1)
            reached = reached.unionByName(further.select("id", (F.col("level") + 1).alias("level"))).groupBy("id").agg(F.min("level").alias("level"))
        shown = self.symbols().withColumn("id", key("path", "ord")).join(reached.where("level > 0"), "id").orderBy("level", "path", "start").collect()
        # Uses that may reach what is reached, or what is asked for, are counted where they would be followed.
        met = reached.where(F.col("level") < min(max(depth, 1), graph.DEEPEST)).select("id")
        possible = every.where("status = 'ambiguous'").select("path", "tab", "ord", F.explode("targets").alias("t")).withColumn("id", key("t.path", "t.ord")).join(met, "id", "left_semi").select("path", "tab", "ord").distinct().count()
        for r in found:
            out.add(self.place(r), 600_000, "definitions")
        for k, r in enumerate(shown):
            out.add(f"  {r.level}: {self.place(r)}", (5 - r.level) * 100_000 + 50_000 - min(k, 49_999), f"callers at {r.level}")
        files = len({r.path for r in shown})
        deepest = max((r.level for r in shown), default=0)
        out.add(f"{len(shown)} caller{'s' * (len(shown) != 1)} in {files} file{'s' * (files != 1)}, to depth {min(max(depth, 1), graph.DEEPEST)}" + (f"; nothing reaches depth {deepest + 1}" if deepest < depth else "") + (f"; {possible} ambiguous use{'s' * (possible != 1)} not followed" if possible else ""), 600_000, "summary")
        return out

    def search(self, query: str, limit: int = 20, budget: int = 2000) -> Answer:
        """Definitions that answer words, best first."""
        if not search.query_words(query):
            raise Refused(f"no words in {query!r}")
        out = Answer(f"search {query}", self.root, budget=budget)
        rows = self.symbols().where(~F.col("kind").isin(*HIDDEN, "argument"))
        file_ = F.col("kind") == "file"
        bare = F.regexp_replace("qualified", r"#\d+$", "")
        docs = rows.select(
            "path", "start", "ord", F.when(file_, F.col("path")).otherwise(F.col("name")).alias("s_name"), F.when(file_, F.lit("")).otherwise(bare.substr(F.lit(1), F.greatest(F.length(bare) - F.length("name"), F.lit(0)))).alias("s_qualifier"),
            F.regexp_replace("path", r"\.[^./]*$", "").alias("s_path"), F.coalesce("doc", F.lit("")).alias("s_doc"), (text.test_file("path") | F.col("qualified").rlike(r"(^|::|\.)tests?(::|\.)")).alias("tested"),
        )
        got = search.search(docs, query, {"s_name": search.NAMED, "s_qualifier": 1.0, "s_path": 1.0, "s_doc": 1.0}, ["path", "start", "ord"], limit, F.col("tested"))
        if not got.answers:
            said = f": the best of the {got.holding} that hold one holds only {', '.join(got.best_holds)}" if got.best_holds else ""
            out.add(f"0 definitions match enough of its words{said}" + (f"; none holds {', '.join(got.absent)}" if got.absent else ""), 600_000, "summary")
            return out
        hits = got.ranked.select("path", "ord", "score").join(self.symbols(), ["path", "ord"]).orderBy(F.desc("score"), "path", "start", "ord").collect()
        for k, r in enumerate(hits):
            out.add(f"{self.place(r)} {r.score:.3f}", 500_000 - k, "results")
        return out

    def map(self, focus: list[str] = (), budget: int = 1024) -> Answer:
        """The definitions that matter most, by PageRank around a focus, grouped by file, the best file first."""
        out = Answer("map " + " ".join(focus) if focus else "map", self.root, budget=budget)
        symbols = settled(self.symbols().withColumn("id", F.concat_ws("\t", "path", "ord")))
        weights = None
        own: set[str] = set()
        if focus:
            parts = []
            for item in focus:
                found = self.targets(item)
                parts += [(f"{r.path}\t{r.ord}", 1.0 / len(found)) for r in found]
            own = {p for p, _ in parts}
            weights = self.spark.createDataFrame(parts, "id string, weight double")
        share = graph.pagerank(symbols.select("id"), self.graph(), weights)
        shown = share.where("share > 0").join(symbols.where(~F.col("kind").isin("file", "variant", *HIDDEN)), "id").where(~F.col("id").isin(*own) if own else F.lit(True))
        ranked = ranking.placed(shown, [F.desc("share"), "path", "start", "ord"])
        ranked = ranked.join(ranked.groupBy("path").agg(F.min("place").alias("best")), "path").orderBy("best", "place").collect()
        files: dict[str, list] = {}
        for r in ranked:
            files.setdefault(r.path, []).append(r)
        out.add(f"{len(ranked)} definitions in {len(files)} files, by PageRank" + (f" around {', '.join(focus)}" if focus else ""), 600_000, "summary")
        for path, inside in files.items():
            out.add(f"{path}:", 500_000 - min(r.place for r in inside), "files", heads=len(inside))
            text_of = self._lines(path) if any(r.kind not in ("file", "section") for r in inside) else []
            for r in inside:
                span = f"{r.start}" if r.start == r.end else f"{r.start}-{r.end}"
                out.add(f"  {span} {self.signature(r, text_of) or r.kind + ' ' + r.name}", 500_000 - r.place, "definitions")
        return out

    # History.

    def history(self) -> dict[str, int]:
        """Read the commits not yet known and tie them to definitions."""
        commits = self._read("commits")
        known = {r.sha for r in commits.select("sha").collect()} if commits is not None else set()
        got = git.history(self.spark, self.root, known)
        n = got["commits"].count()
        if n:
            ids = [r.id for r in got["changes"].select(F.explode(F.array("old", "new")).alias("id")).distinct().where("not id rlike '^0+$'").collect()]
            bytes_of = git.blobs(self.root, ids)
            data = self.spark.createDataFrame([(k, bytearray(v)) for k, v in bytes_of.items()], "blob string, data binary")
            sides = {}
            for side in ("old", "new"):
                path = F.coalesce("renamed", "path") if side == "old" else F.col("path")
                named = got["changes"].select("rev", "path", F.col(side).alias("blob"), path.alias("at")).join(data, "blob").withColumn("language", text.language_of("at")).where("language is not null")
                facts = git.extracted(named.select("blob", "language", "data").dropDuplicates(["blob", "language"]), extract)
                spans = named.join(facts, ["blob", "language"]).select("rev", "path", F.explode("symbols").alias("s")).where("s.kind not in ('file', 'anchor', 'impl')")
                sides[side] = spans.select("rev", "path", "s.qualified", "s.kind", "s.start", "s.end")
            touched = history.touches(got["hunks"], sides["old"], sides["new"])
            for name, df in (("trailers", got["trailers"]), ("changes", got["changes"].drop("old", "new")), ("touches", touched), ("commits", got["commits"].drop("place"))):
                df.write.mode("append").parquet(f"{self.kept}/{name}")
        return {"commits": n}

    def _commits(self) -> DataFrame:
        order = self.spark.createDataFrame([(s, k) for k, s in enumerate(git.order(self.root))], "sha string, place long")
        return self._read("commits").join(order, "sha")

    def why(self, name: str, tasks: DataFrame | None = None, budget: int = 2000) -> Answer:
        """The commits that touched a definition, through renames, and the tasks they name."""
        self.history()
        found, out = self.targets(name), Answer(f"why {name}", self.root, budget=budget)
        wanted = self.spark.createDataFrame([(r.path, r.qualified) for r in found], "path string, qualified string")
        commits = settled(self._commits())
        rows = history.touching(commits, self._read("touches"), self._read("changes"), wanted).collect()
        for r in found:
            out.add(self.place(r), 900_000, "definitions")
        if tasks is not None and rows:
            some = commits.where(F.col("rev").isin([r.rev for r in rows]))
            for t in history.tasks_of(some, self._read("trailers"), tasks).collect():
                out.add(f"  task {t.id} {t.state}: {t.title}", 800_000, "tasks")
                for n in t.notes or []:
                    out.add(f"    {n.kind} {n.id}: {n.title}", 600_000 if n.superseded_by else 700_000, "notes")
        for k, r in enumerate(rows):
            out.add(f"  {r.sha[:9]} {time.strftime('%Y-%m-%d', time.gmtime(r.time))} +{r.added} -{r.removed} {r.subject}", 500_000 - k, "commits")
        return out

    def touched(self, task: str, key: str = "task", budget: int = 2000) -> Answer:
        """What the commits of a task changed, and where it is now."""
        self.history()
        out = Answer(f"touched {task}", self.root, budget=budget)
        revs = history.of_task(self._read("trailers"), key, task)
        commits = settled(self._commits().join(revs, "rev"))
        rows = self._read("touches").join(commits.select("rev", "place"), "rev")
        rolled = history.rolled_up(rows, ["path", "qualified", "kind"], "place")
        now = self.symbols().select("path", "qualified", "start", "end")
        shown = rolled.join(now, ["path", "qualified"], "left").orderBy("nth").collect()
        listed = commits.orderBy("place").collect()
        if not listed:
            raise Refused(f"no commit names task {task}")
        for k, r in enumerate(listed):
            out.add(f"{r.sha[:9]} {time.strftime('%Y-%m-%d', time.gmtime(r.time))} {r.subject}", 800_000 - k, "commits")
        for k, r in enumerate(shown):
            at = f"{r.path}:{r.start}-{r.end}" if r.start is not None else f"{r.path} (gone)"
            out.add(f"  {at} {r.kind} {r.qualified} +{r.added} -{r.removed}, {r.commits} commit{'s' * (r.commits != 1)}", 500_000 - k, "definitions")
        return out
