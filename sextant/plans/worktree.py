"""Extraction, resolution and the questions as queries, over a small worktree of six languages.

The driver's tables hold no code, so the worktree is written here, committed with git in a folder
of the driver, and read by the engine; its facts are kept in the shared folder. The SQL of a query is
the rows that reading the files gives."""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.engine import Answer, Engine
from sextant.session import shared_folder

FILES = {
    "py/__init__.py": "",
    "py/base.py": '"""Shapes."""\n\n\nclass Shape:\n    """A shape. It has an area."""\n\n    def area(self):\n        return 0\n\n    def describe(self):\n        return self.area()\n\n\nclass Named:\n    def describe(self):\n        return "named"\n',
    "py/round.py": "from .base import Named, Shape as Base\n\n\nclass Circle(Base):\n    def area(self):\n        return scale(3)\n\n\nclass Label(Circle, Named):\n    def show(self):\n        return self.describe()\n\n\ndef scale(x):\n    return x * 2\n\n\ndef main():\n    items = []\n    items.append(Circle())\n    return scale(1)\n",
    "rs/lib.rs": "pub mod tank;\nuse crate::tank::Tank;\n\npub fn run() {\n    let mut t = Tank::empty();\n    t.fill_up();\n    helper();\n}\n\nfn helper() {}\n",
    "rs/tank.rs": "/// Holds water.\npub struct Tank {\n    level: u32,\n}\n\nimpl Tank {\n    pub fn empty() -> Tank {\n        Tank { level: 0 }\n    }\n\n    pub fn fill_up(&mut self) {\n        self.check();\n        self.level += 1;\n    }\n\n    fn check(&self) {}\n}\n",
    "c/num.h": "#ifndef NUM_H\n#define NUM_H\nint twice(int a);\n#endif\n",
    "c/num.c": '#include "num.h"\n/* Doubles. */\nint twice(int a)\n{\n    return a + a;\n}\n\nint four(void)\n{\n    return twice(2);\n}\n',
    "c/main.c": '#include "num.h"\n#ifdef _WIN32\nstatic int size(void)\n{\n    return 1;\n}\n#else\nstatic int size(void)\n{\n    return 2;\n}\n#endif\nint main(void)\n{\n    return twice(size());\n}\n',
    "sh/lib.sh": "# Says hello.\nhello() {\n  echo hi\n}\nhello_world() {\n  hello\n}\n",
    "sh/start": '#!/usr/bin/env bash\nsource "$(dirname "$0")/lib.sh"\nhello_world\n',
    "nix/web.nix": '{ lib, config, ... }:\n{\n  imports = [ ./db.nix ];\n  options.services.web.port = lib.mkOption { default = 80; };\n  config = lib.mkIf (config.services.web.port == 80) { };\n}\n',
    "nix/db.nix": "{ lib, ... }:\n{\n  options.services.db.name = lib.mkOption { };\n}\n",
    "docs/guide.md": "# Guide\n\nSee [the tank](../rs/tank.rs) and `Tank::fill_up`.\n\n## Use\n\n[back](#guide) to `four`.\n\n\n## Use\n\nMore.\n",
}
#: What each further commit replaces: (path, before, after, message).
CHANGES = [("c/num.c", "return a + a;", "return 2 * a;", "Double by product\n\nTask: 8"), ("py/round.py", "scale(3)", "scale(4)", "Larger circles\n\nTask: 7, 9")]

_ENGINES: dict[str, Engine] = {}


def engine(spark: SparkSession) -> Engine:
    """The engine over the worktree, made once an application."""
    app = spark.sparkContext.applicationId
    if app not in _ENGINES:
        root = tempfile.mkdtemp(prefix="sextant-worktree-")
        # Commits of fixed dates have the same ids wherever they are made.
        env = os.environ | {f"GIT_{who}_DATE": "2024-01-02T03:04:05Z" for who in ("AUTHOR", "COMMITTER")}
        run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.email=a@b", "-c", "user.name=n", "-c", "commit.gpgsign=false", *a], check=True, capture_output=True, env=env)
        run("init", "-q")
        for path, content in FILES.items():
            os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
            with open(os.path.join(root, path), "w") as f:
                f.write(content)
        run("add", ".")
        run("commit", "-qm", "All files\n\nTask: 7")
        for path, before, after, message in CHANGES:
            with open(os.path.join(root, path)) as f:
                content = f.read()
            with open(os.path.join(root, path), "w") as f:
                f.write(content.replace(before, after))
            run("commit", "-qam", message)
        made = Engine(spark, root, f"{shared_folder(spark)}/worktree-{app}")
        made.check()
        _ENGINES[app] = made
    return _ENGINES[app]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def values(columns: str, rows: list[tuple]) -> str:
    told = lambda v: "NULL" if v is None else f"{v}::BIGINT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(told, r)) + ')' for r in rows)}) AS t ({columns})"


def _symbols(language: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = engine(spark).symbols().where((F.col("language") == language) & (F.col("kind") != "file"))
        return rows.select("path", "kind", "qualified", F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("last"))

    return run


def _edges(language: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = engine(spark)
        symbols = e.symbols().select(F.col("path").alias("s_path"), F.col("ord").alias("s_ord"), "qualified")
        rows = e.edges().where(F.col("language") == language).select("path", F.col("line").cast("long").alias("line"), "name", "use", "status", F.coalesce("rule", F.lit("")).alias("rule"), F.explode_outer("targets").alias("t"))
        led = rows.join(symbols, (F.col("t.path") == F.col("s_path")) & (F.col("t.ord") == F.col("s_ord")), "left")
        return led.select("path", "line", "name", "use", "status", "rule", F.coalesce(F.concat_ws(" ", "t.path", "qualified"), F.lit("")).alias("target")).distinct()

    return run


def _lines(ask: Callable[[Engine], Answer]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        lines = ask(engine(spark)).json()["results"]
        return spark.createDataFrame([(n, line) for n, line in enumerate(lines)], "n long, line string")

    return run


for _language in ("python", "rust", "c", "bash", "nix", "markdown"):
    QUERIES[f"symbols_{_language}"] = _symbols(_language)
    QUERIES[f"edges_{_language}"] = _edges(_language)

QUESTIONS: dict[str, Callable[[Engine], Answer]] = {
    "question_def": lambda e: e.def_("Shape"), "question_callers": lambda e: e.callers("scale"), "question_callees": lambda e: e.callees("Tank::fill_up"), "question_outline": lambda e: e.outline("py/round.py"),
    "question_impact": lambda e: e.impact("scale"), "question_search": lambda e: e.search("holds water"), "question_map": lambda e: e.map(["run"]), "question_why": lambda e: e.why("twice"), "question_touched": lambda e: e.touched("7"),
}
QUERIES |= {name: _lines(ask) for name, ask in QUESTIONS.items()}

#: What reading the files gives, in order.
ROWS: dict[str, list[tuple]] = {
    "symbols_python": [
        ("py/base.py", "class", "Named", 14, 16),
        ("py/base.py", "class", "Shape", 4, 11),
        ("py/base.py", "method", "Named.describe", 15, 16),
        ("py/base.py", "method", "Shape.area", 7, 8),
        ("py/base.py", "method", "Shape.describe", 10, 11),
        ("py/round.py", "class", "Circle", 4, 6),
        ("py/round.py", "class", "Label", 9, 11),
        ("py/round.py", "function", "main", 18, 21),
        ("py/round.py", "function", "scale", 14, 15),
        ("py/round.py", "method", "Circle.area", 5, 6),
        ("py/round.py", "method", "Label.show", 10, 11),
    ],
    "edges_python": [
        ("py/base.py", 11, "area", "call method", "resolved", "receiver", "py/base.py Shape.area"),
        ("py/base.py", 11, "area", "call method", "resolved", "override", "py/round.py Circle.area"),
        ("py/base.py", 11, "self", "reference value", "external", "", ""),
        ("py/round.py", 1, "Named", "import", "resolved", "import", "py/base.py Named"),
        ("py/round.py", 1, "Shape", "import", "resolved", "import", "py/base.py Shape"),
        ("py/round.py", 4, "Base", "reference value", "resolved", "import", "py/base.py Shape"),
        ("py/round.py", 6, "scale", "call free", "resolved", "scope", "py/round.py scale"),
        ("py/round.py", 9, "Circle", "reference value", "resolved", "scope", "py/round.py Circle"),
        ("py/round.py", 9, "Named", "reference value", "resolved", "import", "py/base.py Named"),
        ("py/round.py", 11, "describe", "call method", "resolved", "receiver", "py/base.py Shape.describe"),
        ("py/round.py", 11, "self", "reference value", "external", "", ""),
        ("py/round.py", 15, "x", "reference value", "external", "", ""),
        ("py/round.py", 20, "Circle", "call free", "resolved", "scope", "py/round.py Circle"),
        ("py/round.py", 20, "append", "call method", "external", "", ""),
        ("py/round.py", 20, "items", "reference value", "external", "", ""),
        ("py/round.py", 21, "scale", "call free", "resolved", "scope", "py/round.py scale"),
    ],
    "symbols_rust": [
        ("rs/lib.rs", "function", "helper", 10, 10),
        ("rs/lib.rs", "function", "run", 4, 8),
        ("rs/lib.rs", "module", "tank", 1, 1),
        ("rs/tank.rs", "impl", "impl Tank", 6, 17),
        ("rs/tank.rs", "method", "Tank::check", 16, 16),
        ("rs/tank.rs", "method", "Tank::empty", 7, 9),
        ("rs/tank.rs", "method", "Tank::fill_up", 11, 14),
        ("rs/tank.rs", "struct", "Tank", 2, 4),
    ],
    "edges_rust": [
        ("rs/lib.rs", 2, "Tank", "import", "resolved", "import", "rs/tank.rs Tank"),
        ("rs/lib.rs", 5, "empty", "call path", "resolved", "path", "rs/tank.rs Tank::empty"),
        ("rs/lib.rs", 6, "fill_up", "call method", "resolved", "unique", "rs/tank.rs Tank::fill_up"),
        ("rs/lib.rs", 7, "helper", "call free", "resolved", "module", "rs/lib.rs helper"),
        ("rs/tank.rs", 6, "Tank", "reference type", "resolved", "module", "rs/tank.rs Tank"),
        ("rs/tank.rs", 7, "Tank", "reference type", "resolved", "module", "rs/tank.rs Tank"),
        ("rs/tank.rs", 8, "Tank", "reference type", "resolved", "module", "rs/tank.rs Tank"),
        ("rs/tank.rs", 12, "check", "call method", "resolved", "receiver", "rs/tank.rs Tank::check"),
    ],
    "symbols_c": [
        ("c/main.c", "function", "main", 13, 16),
        ("c/main.c", "function", "size", 3, 6),
        ("c/main.c", "function", "size#2", 8, 11),
        ("c/num.c", "function", "four", 8, 11),
        ("c/num.c", "function", "twice", 3, 6),
        ("c/num.h", "declaration", "twice", 3, 3),
        ("c/num.h", "macro", "NUM_H", 2, 2),
    ],
    "edges_c": [
        ("c/main.c", 1, "h", "import", "resolved", "include", "c/num.h "),
        ("c/main.c", 15, "size", "call free", "resolved", "scope", "c/main.c size#2"),
        ("c/main.c", 15, "twice", "call free", "resolved", "include", "c/num.c twice"),
        ("c/num.c", 1, "h", "import", "resolved", "include", "c/num.h "),
        ("c/num.c", 10, "twice", "call free", "resolved", "scope", "c/num.c twice"),
    ],
    "symbols_bash": [
        ("sh/lib.sh", "function", "hello", 2, 4),
        ("sh/lib.sh", "function", "hello_world", 5, 7),
    ],
    "edges_bash": [
        ("sh/lib.sh", 6, "hello", "call free", "resolved", "scope", "sh/lib.sh hello"),
        ("sh/start", 2, "sh", "import", "resolved", "file", "sh/lib.sh "),
        ("sh/start", 3, "hello_world", "call free", "resolved", "source", "sh/lib.sh hello_world"),
    ],
    "symbols_nix": [
        ("nix/db.nix", "option", "services.db.name", 3, 3),
        ("nix/web.nix", "attribute", "config", 5, 5),
        ("nix/web.nix", "attribute", "imports", 3, 3),
        ("nix/web.nix", "attribute", "options.services.web.port.default", 4, 4),
        ("nix/web.nix", "option", "services.web.port", 4, 4),
    ],
    "edges_nix": [
        ("nix/db.nix", 3, "mkOption", "reference path", "external", "", ""),
        ("nix/web.nix", 3, "nix", "import", "resolved", "file", "nix/db.nix "),
        ("nix/web.nix", 4, "mkOption", "reference path", "external", "", ""),
        ("nix/web.nix", 5, "mkIf", "reference path", "external", "", ""),
        ("nix/web.nix", 5, "port", "reference path", "resolved", "option", "nix/web.nix services.web.port"),
    ],
    "symbols_markdown": [
        ("docs/guide.md", "section", "guide", 1, 12),
        ("docs/guide.md", "section", "use", 5, 7),
        ("docs/guide.md", "section", "use-1", 10, 12),
    ],
    "edges_markdown": [
        ("docs/guide.md", 3, "fill_up", "mention", "resolved", "unique", "rs/tank.rs Tank::fill_up"),
        ("docs/guide.md", 3, "rs", "link", "resolved", "file", "rs/tank.rs "),
        ("docs/guide.md", 7, "#guide", "link", "resolved", "anchor", "docs/guide.md guide"),
        ("docs/guide.md", 7, "four", "mention", "resolved", "unique", "c/num.c four"),
    ],
    "question_def": list(enumerate([
        "py/base.py:4-11 class Shape",
        "  /// A shape.",
        "  class Shape:",
    ])),
    "question_callers": list(enumerate([
        "py/round.py:14-15 function scale: 2 callers, 0 possible",
        "  py/round.py Circle.area: call 6",
        "  py/round.py main: call 21",
    ])),
    "question_callees": list(enumerate([
        "rs/tank.rs:11-14 method Tank::fill_up: 1 callee",
        "  rs/tank.rs:16 method Tank::check: 12",
    ])),
    "question_outline": list(enumerate([
        "py/round.py: 21 lines, 6 symbols",
        "  4-6 class Circle",
        "    5-6 method area",
        "  9-11 class Label",
        "    10-11 method show",
        "  14-15 function scale",
        "  18-21 function main",
    ])),
    "question_impact": list(enumerate([
        "py/round.py:14-15 function scale",
        "  1: py/round.py:5-6 method Circle.area",
        "  1: py/round.py:18-21 function main",
        "  2: py/base.py:10-11 method Shape.describe",
        "  3: py/round.py:10-11 method Label.show",
        "4 callers in 2 files, to depth 3",
    ])),
    "question_search": list(enumerate([
        "rs/tank.rs:2-4 struct Tank 6.532",
    ])),
    "question_map": list(enumerate([
        "5 definitions in 2 files, by PageRank around run",
        "rs/lib.rs:",
        "  10 fn helper()",
        "rs/tank.rs:",
        "  7-9 pub fn empty() -> Tank",
        "  11-14 pub fn fill_up(&mut self)",
        "  2-4 pub struct Tank",
        "  16 fn check(&self)",
    ])),
    "question_why": list(enumerate([
        "c/num.c:3-6 function twice",
        "c/num.h:3 declaration twice",
        "  b12b017d8 2024-01-02 +1 -1 Double by product",
        "  5721a128a 2024-01-02 +4 -0 All files",
        "  5721a128a 2024-01-02 +1 -0 All files",
    ])),
    "question_touched": list(enumerate([
        "9028ff80f 2024-01-02 Larger circles",
        "5721a128a 2024-01-02 All files",
        "  docs/guide.md:1-12 section guide +12 -0, 1 commit",
        "  py/base.py:4-11 class Shape +8 -0, 1 commit",
        "  py/round.py:4-6 class Circle +4 -1, 2 commits",
        "  rs/lib.rs:4-8 function run +5 -0, 1 commit",
        "  py/round.py:5-6 method Circle.area +3 -1, 2 commits",
        "  c/main.c:13-16 function main +4 -0, 1 commit",
        "  c/main.c:3-6 function size +4 -0, 1 commit",
        "  c/main.c:8-11 function size#2 +4 -0, 1 commit",
        "  c/num.c:8-11 function four +4 -0, 1 commit",
        "  c/num.c:3-6 function twice +4 -0, 1 commit",
        "  py/round.py:18-21 function main +4 -0, 1 commit",
        "  rs/tank.rs:11-14 method Tank::fill_up +4 -0, 1 commit",
        "  docs/guide.md:5-7 section use +3 -0, 1 commit",
        "  docs/guide.md:10-12 section use-1 +3 -0, 1 commit",
        "  py/base.py:14-16 class Named +3 -0, 1 commit",
        "  py/round.py:9-11 class Label +3 -0, 1 commit",
        "  rs/tank.rs:2-4 struct Tank +3 -0, 1 commit",
        "  rs/tank.rs:7-9 method Tank::empty +3 -0, 1 commit",
        "  sh/lib.sh:2-4 function hello +3 -0, 1 commit",
        "  sh/lib.sh:5-7 function hello_world +3 -0, 1 commit",
        "  py/base.py:15-16 method Named.describe +2 -0, 1 commit",
        "  py/base.py:7-8 method Shape.area +2 -0, 1 commit",
        "  py/base.py:10-11 method Shape.describe +2 -0, 1 commit",
        "  py/round.py:10-11 method Label.show +2 -0, 1 commit",
        "  py/round.py:14-15 function scale +2 -0, 1 commit",
        "  c/num.h:2-2 macro NUM_H +1 -0, 1 commit",
        "  c/num.h:3-3 declaration twice +1 -0, 1 commit",
        "  nix/db.nix:3-3 option services.db.name +1 -0, 1 commit",
        "  nix/web.nix:5-5 attribute config +1 -0, 1 commit",
        "  nix/web.nix:3-3 attribute imports +1 -0, 1 commit",
        "  nix/web.nix:4-4 attribute options.services.web.port.default +1 -0, 1 commit",
        "  nix/web.nix:4-4 option services.web.port +1 -0, 1 commit",
        "  rs/lib.rs:10-10 function helper +1 -0, 1 commit",
        "  rs/lib.rs:1-1 module tank +1 -0, 1 commit",
        "  rs/tank.rs:16-16 method Tank::check +1 -0, 1 commit",
    ])),
}
COLUMNS = {"symbols": "path, kind, qualified, first, last", "edges": "path, line, name, use, status, rule, target", "question": "n, line"}
SQL |= {name: values(COLUMNS[name.split("_")[0]], rows) for name, rows in ROWS.items()}
