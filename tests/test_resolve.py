"""Resolution of small sets of files, without a worktree."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant import schemas
from sextant.extract import extract
from sextant.resolve import cargo, edges, live, places


def resolved(spark, files: dict[str, tuple[str, str]], crates: dict[str, str] | None = None) -> set[tuple]:
    """(path, line, name, status, rule, target) of each edge of files by path: (language, text)."""
    rows = [{"blob": path, "language": lang, **extract(lang, text.encode())} for path, (lang, text) in files.items()]
    facts = spark.createDataFrame(rows, schemas.EXTRACTED)

    def part(name):
        own = [f.name for f in schemas.EXTRACTION[name].dataType.elementType.fields]
        return facts.select("language", F.col("blob").alias("path"), F.explode(name).alias("f")).select("language", "path", *[F.col(f"f.{c}").alias("written" if c == "path" else c) for c in own])

    symbols = part("symbols")
    got = edges.resolved(facts.select(F.col("blob").alias("path"), "language"), symbols, *(part(p) for p in ("calls", "refs", "imports")), crates=crates)
    led = got.select("path", "line", "name", "status", "rule", F.explode_outer("targets").alias("t")).alias("e").join(symbols.select(F.col("path").alias("s_path"), "ord", "qualified"), (F.col("t.path") == F.col("s_path")) & (F.col("t.ord") == F.col("ord")), "left")
    return {tuple(r) for r in led.select("e.path", "line", "name", "status", "rule", "qualified").collect()}


BASE = """class Base:
    def run(self):
        self.step()
        self.only_below()

    def other(self):
        self.step()

    def step(self):
        pass


class Calls(Base):
    def run(self):
        super().run()

    def step(self):
        pass


class Hides(Base):
    def run(self):
        pass

    def step(self):
        pass

    def only_below(self):
        pass


class Deep(Calls):
    pass


def use(b: Base):
    b.step()
"""


def test_a_use_through_self_reaches_what_subclasses_override(spark):
    got = resolved(spark, {"m.py": ("python", BASE)})
    step = {(line, rule, to) for _, line, name, _, rule, to in got if name == "step"}
    # `Hides` never runs Base.run, so from there its members are not reached; Deep reads those of Calls.
    assert {t for t in step if t[0] == 3} == {(3, "receiver", "Base.step"), (3, "override", "Calls.step")}
    assert {t for t in step if t[0] == 7} == {(7, "receiver", "Base.step"), (7, "override", "Calls.step"), (7, "override", "Hides.step")}
    # A variable of the class is told by its type alone.
    assert {t for t in step if t[0] == 37} == {(37, "receiver", "Base.step")}
    assert not any(rule == "override" for _, line, _, _, rule, _ in got if line == 4)


CRATE = {
    "pkg/src/lib.rs": "pub mod store;\nmod other;\npub fn top() {}\n",
    "pkg/src/main.rs": "mod other;\nfn main() { other::go(); }\n",
    "pkg/src/store/mod.rs": "pub mod disk;\nuse crate::other::make as build;\nuse self::disk::Disk;\npub fn make() {}\npub fn all() { build(); super::top(); disk::make(); crate::store::make(); Disk::open(); }\n",
    "pkg/src/store/disk.rs": "use super::*;\npub struct Disk;\nimpl Disk { pub fn open() {} }\npub fn make() {}\npub fn more() { all(); }\nmod tests {\n    fn it() { super::make(); }\n}\n",
    "pkg/src/other.rs": "pub fn make() {}\npub fn go() {}\npub struct Disk;\nimpl Disk { pub fn open() {} }\n",
}


def test_places_follow_mod_items(spark):
    files = spark.createDataFrame([(p, "rust") for p in [*CRATE, "pkg/tests/it.rs", "pkg/src/bin/tool.rs", "pkg/src/left.rs", "loose.rs"]], "path string, language string")
    facts = [("rust", p, s["kind"], s["qualified"], s["declared"]) for p, t in CRATE.items() for s in extract("rust", t.encode())["symbols"]]
    symbols = spark.createDataFrame(facts, "language string, path string, kind string, qualified string, declared boolean")
    got = {tuple(r) for r in places.placed(files, symbols).select("path", "crate", "module").collect()}
    assert got == {
        ("pkg/src/lib.rs", "pkg", ""), ("pkg/src/main.rs", "pkg:main", ""), ("pkg/src/store/mod.rs", "pkg", "store"), ("pkg/src/store/disk.rs", "pkg", "store::disk"), ("pkg/src/other.rs", "pkg", "other"),
        ("pkg/src/other.rs", "pkg:main", "other"), ("pkg/tests/it.rs", "pkg:tests/it", ""), ("pkg/src/bin/tool.rs", "pkg:bin/tool", ""), ("pkg/src/left.rs", "pkg", "left"), ("loose.rs", "loose.rs", ""),
    }


def test_rust_paths_are_told_from_the_root(spark):
    got = resolved(spark, {p: ("rust", t) for p, t in CRATE.items()})
    at = {(path.removeprefix("pkg/src/"), line, name): (status, rule, to) for path, line, name, status, rule, to in got}
    led = lambda path, line, name: at[path, line, name]
    assert led("main.rs", 2, "go") == ("resolved", "path", "go")
    assert led("store/mod.rs", 5, "build") == ("resolved", "import", "make")
    assert led("store/mod.rs", 5, "top") == ("resolved", "path", "top")
    assert led("store/mod.rs", 5, "open") == ("resolved", "path", "Disk::open")
    assert led("store/disk.rs", 5, "all") == ("resolved", "glob", "all")
    assert led("store/disk.rs", 7, "make") == ("resolved", "path", "make")
    made = {(path, to_status) for path, line, name, to_status, _, _ in got if name == "make" and line == 5}
    assert made == {("pkg/src/store/mod.rs", "resolved")}


MANIFESTS = {
    "": {"workspace": {"dependencies": {"core": {"path": "core", "features": ["wide"]}}}},
    "app": {
        "package": {"name": "my-app"},
        "features": {"default": ["fast"], "fast": ["dep:extra", "extra?/deep", "core?/seen"], "slow": ["core/odd"], "loud": []},
        "dependencies": {"core": {"workspace": True}, "extra": {"path": "../extra", "optional": True, "default-features": False}, "away": "1"},
        "target": {"cfg(windows)": {"dependencies": {"win": {"path": "../win"}}}},
        "bin": [{"name": "tool", "required-features": ["slow"]}, {"name": "kept", "required-features": ["fast", "away/x"]}],
    },
    "core": {"package": {"name": "core"}, "features": {"default": ["base"], "base": [], "wide": [], "odd": [], "seen": []}},
    "extra": {"package": {"name": "extra"}, "features": {"default": ["no"], "no": [], "deep": ["far"], "far": []}},
    "win": {"package": {"name": "win"}, "features": {"default": [], "odd": []}},
}


def test_features_that_a_build_turns_on():
    on = cargo.features(MANIFESTS, live.RUST)
    assert on == {"app": {"default", "fast"}, "core": {"default", "base", "wide", "seen"}, "extra": {"default", "no", "deep", "far"}, "win": {"default"}}
    assert cargo.libraries(MANIFESTS)["my_app"] == "app"
    assert cargo.skipped(MANIFESTS, on, {"app/src/bin/tool.rs", "app/src/bin/kept.rs"}) == ["app/src/bin/tool.rs"]


def test_branches_of_features_that_are_off_are_dead(spark):
    rows = [("rust", "app/src/lib.rs", 1, 2, 0, 'feature = "fast"'), ("rust", "app/src/lib.rs", 3, 4, 1, 'feature = "slow"'), ("rust", "none/a.rs", 5, 6, 0, 'feature = "slow"'), ("rust", "core/src/a.rs", 7, 8, 0, "windows")]
    branches = spark.createDataFrame(rows, "language string, path string, start int, end int, ord int, condition string")
    assert sorted(r.start for r in live.dead(branches, {"app": {"fast"}}).collect()) == [3, 7]


def test_paths_of_another_library(spark):
    files = {"app/src/main.rs": "use core_lib::store::put;\nfn main() { put(); core_lib::top(); }\n", "core/src/lib.rs": "pub mod store;\npub fn top() {}\n", "core/src/store.rs": "pub fn put() {}\n", "app/src/store.rs": "pub fn put() {}\npub fn top() {}\n"}
    got = resolved(spark, {p: ("rust", t) for p, t in files.items()}, {"core_lib": "core"})
    assert {(line, name, status, rule) for path, line, name, status, rule, _ in got if path == "app/src/main.rs"} == {(1, "put", "resolved", "import"), (2, "put", "resolved", "import"), (2, "top", "resolved", "path")}
