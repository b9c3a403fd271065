"""The nine questions over a small git worktree of six languages."""

from __future__ import annotations

import subprocess

import pytest

from sextant.engine import Engine, Refused
from sextant.extract import extract
from sextant.sources import git

FILES = {
    "pkg/__init__.py": "",
    "pkg/base.py": '"""Base things."""\n\n\nclass Base:\n    """A base of shops."""\n\n    def open(self):\n        return self.close()\n\n    def close(self):\n        return 1\n\n\ndef helper(x):\n    return x\n',
    "pkg/shop.py": 'from .base import Base, helper\n\n\nclass Shop(Base):\n    """A shop. It sells."""\n\n    def close(self):\n        return helper(2)\n\n    def sell(self):\n        self.open()\n        return self.close()\n\n\ndef run():\n    s = Shop()\n    s.sell()\n    return helper(1)\n',
    "docs/a.md": "# Guide\n\nSee [shop](../pkg/shop.py) and `Shop.sell`.\n\n## Use\n\n[top](#guide)\n",
    "src/lib.rs": "/// A store.\npub struct Store { n: u32 }\nimpl Store {\n    pub fn new() -> Self { Store { n: 0 } }\n    pub fn put(&mut self) { self.check(); }\n    fn check(&self) {}\n}\npub fn main_thing() { let mut s = Store::new(); s.put(); }\n",
    "c/a.h": "#ifndef A_H\n#define A_H\nint add(int a, int b);\n#endif\n",
    "c/a.c": '#include "a.h"\n/* Adds. */\nint add(int a, int b)\n{\n    return a + b;\n}\n',
    "c/main.c": '#include "a.h"\nstatic int twice(int a)\n{\n    return add(a, a);\n}\n',
    "c/port.c": "#ifdef _WIN32\nint port(void)\n{\n    return 1;\n}\n#else\nint port(void)\n{\n    return 2;\n}\n#endif\nint use_port(void)\n{\n    return port();\n}\n",
    "bin/lib.sh": "# Greets.\ngreet() {\n  echo hi\n}\n",
    "bin/hook": "#!/usr/bin/env bash\nsource \"$(dirname \"$0\")/lib.sh\"\ngreet world\n",
    "nix/mod.nix": '{ lib, config, ... }:\n{\n  options.services.demo.enable = lib.mkEnableOption "demo";\n  config = lib.mkIf config.services.demo.enable { };\n}\n',
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    run("init", "-q")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    run("add", ".")
    run("commit", "-qm", "One\n\nTask: 7")
    (root / "pkg/shop.py").write_text(FILES["pkg/shop.py"].replace("helper(2)", "helper(3)"))
    run("commit", "-qam", "Two\n\nTask: 8")
    run("mv", "pkg/shop.py", "pkg/store.py")
    run("commit", "-qm", "Move")
    run("mv", "pkg/store.py", "pkg/shop.py")
    run("commit", "-qm", "Move back")
    made = Engine(spark, str(root), str(tmp_path_factory.mktemp("kept")))
    made.first = made.check()
    return made


def test_a_second_check_extracts_nothing(engine):
    assert engine.first == {"listed": 12, "hashed": 12, "extracted": 12, "gone": 0}
    assert engine.check()["extracted"] == 0


def test_def(engine):
    got = engine.def_("Shop").render().split("\n")
    assert got[1:] == ["pkg/shop.py:4-12 class Shop", "  /// A shop.", "  class Shop(Base):"]
    assert "  src/lib.rs:3-7 impl impl Store" in engine.def_("Store").render()
    assert [line for line in engine.def_("add").render().split("\n") if line.startswith("c/")][0].startswith("c/a.c:3-6 function add")
    with pytest.raises(Refused, match="nearest: Shop"):
        engine.def_("Shp")


def test_callers(engine):
    got = engine.callers("helper").render()
    assert "pkg/base.py:14-15 function helper: 3 callers, 0 possible" in got and "  pkg/shop.py run: call 18" in got and "  pkg/shop.py Shop.close: call 8" in got
    assert "src/lib.rs Store::put: call 5" in engine.callers("Store::check").render()
    assert "c/main.c twice: call 4" in engine.callers("c/a.c:add").render()
    assert "c/port.c:7-10 function port#2: 1 caller, 0 possible" in engine.callers("port").render()
    assert "bin/hook top: call 3" in engine.callers("greet").render()
    assert "docs/a.md guide: mention 3" in engine.callers("Shop.sell").render()


def test_callees_outline_impact(engine):
    got = engine.callees("Shop.sell").render()
    assert "pkg/base.py:7 method Base.open: 11" in got and "pkg/shop.py:7 method Shop.close: 12" in got
    assert engine.outline("pkg/shop.py").render().split("\n")[1:] == ["pkg/shop.py: 18 lines, 4 symbols", "  4-12 class Shop", "    7-8 method close", "    10-12 method sell", "  15-18 function run"]
    got = engine.impact("helper").render()
    assert "  1: pkg/shop.py:15-18 function run" in got and "  2: pkg/shop.py:10-12 method Shop.sell" in got


def test_search_and_map(engine):
    assert engine.search("shop sell").render().split("\n")[1].startswith("pkg/shop.py:10-12 method Shop.sell")
    assert "0 definitions match" in engine.search("frobnicate quux sell").render()
    got = engine.map(budget=4000).render()
    assert "pkg/base.py:" in got and "def helper(x):" in got
    small = engine.map(budget=60)
    assert len(small.render().encode()) <= 240 and small.json()["cut"]["budget"] == 60


def test_map_ranks_every_definition(spark):
    rows = [("a.py", k, "function", f"first{k}", 2 * k + 1, 2 * k + 2, "python") for k in range(2100)] + [("b.py", k, "function", f"last{k}", k + 1, k + 1, "python") for k in range(3)]
    big = Engine.__new__(Engine)
    big.spark, big.root = spark, "/tree"
    big.symbols = lambda: spark.createDataFrame(rows, "path string, ord int, kind string, name string, start int, end int, language string")
    big.graph = lambda: spark.createDataFrame([("a.py\t2099", "b.py\t2", 1.0)], "src string, dst string, w double")
    big._lines = lambda path: [f"def of_{path[0]}{k}():" for k in range(4300)]
    got = big.map(budget=1_000_000).json()
    assert got["cut"] is None and got["results"][0] == "2103 definitions in 2 files, by PageRank" and got["results"][1] == "b.py:"
    assert len(got["results"]) == 1 + 2 + 2103


def test_why_and_touched(engine):
    got = engine.why("Shop.close").render()
    assert got.index(" Two") < got.index(" One")
    got = engine.touched("8").render()
    assert "Two" in got and "method Shop.close +1 -1, 1 commit" in got
    with pytest.raises(Refused):
        engine.touched("99")


def test_extractors_survive_anything():
    for language in ("python", "rust", "c", "bash", "nix", "markdown", "other"):
        for data in (b"", b"\xff\xfe{", b"((((", b"def (", b"fn x(", b"/* open", b'"""', b"#if\n#endif\n#else", b"```\n# x", b"{ a = ", b"x" * 5000):
            got = extract(language, data)
            assert got["symbols"][0]["kind"] == "file"
    assert extract("python", b"def f(:")["syntax_error"]


def test_trailers():
    assert git.trailers("Subject: not\n\nBody text: here\nmore words\n\nTask: 7, 8\nSigned-off-by: A\n  B") == [("Task", "7, 8"), ("Signed-off-by", "A B")]
    assert git.library_name({"package": {"name": "a-b"}}) == "a_b" and git.library_name({"lib": {"name": "x"}, "package": {"name": "y"}}) == "x" and git.manifest(b"[") == {}
