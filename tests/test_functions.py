from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sextant.functions import conditions, text
from sextant.operators import search


def values(spark, expression, *rows):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").orderBy("i").select(expression).collect()]


WORDS = {
    "openDoor": ["open", "door", "opendoor"], "two plain words": ["two", "plain", "word"], "XMLHttpParser9": ["xml", "http", "parser9", "xmlhttpparser9"], "__tail_": ["tail"], "LEFT_SIDES": ["left", "side", "leftside"],
    "lib/disk.py:Disk.mount": ["lib", "disk", "py", "disk", "mount"], "ÜberGröße": ["über", "größe", "übergröße"], "- _ -": [], "berries shoes dues virus glass gas as": ["berry", "shoes", "due", "virus", "glass", "ga", "as"],
}


def test_words(spark):
    assert values(spark, text.words("x"), *WORDS) == list(WORDS.values())
    assert values(spark, text.words("x"), None) == [[]]
    for query, want in WORDS.items():
        assert search.query_words(query) == list(dict.fromkeys(want))
    # Counting without listing the words gives the same numbers.
    texts = [*WORDS, " ".join(WORDS), "Door_s open__door OPENdoors opendoor _opendoor_ open-door doors9 berrie s berry", None, ""]
    asked = ["door", "opendoor", "berry", "left", "side", "leftside", "shoes", "due", "glass", "x", "s", "word"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").withColumns({"w": text.words("x"), "cut": text.cut_lower("x")})
    for r in df.select("w", text.word_count(F.col("cut")).alias("n"), *[text.word_times(F.col("cut"), q).alias(f"q_{q}") for q in asked]).collect():
        assert r.n == len(r.w) and [r[f"q_{q}"] for q in asked] == [r.w.count(q) for q in asked]


def test_stop_words(spark):
    assert values(spark, text.is_stop("x"), "the", "thi", "load") == [True, text.stemmed("this") == "thi", False]


def test_slugs(spark):
    assert values(spark, text.slug("x"), "Hello, World!", "A_b-c  d", "Ünï 2") == ["hello-world", "a_b-c--d", "ünï-2"]


def test_first_sentence(spark):
    got = values(spark, text.first_sentence("x"), "One. Two.", "\n\n A\n b.\n\nNext", "", None, "x . y", "w" * 300)
    assert got[:5] == ["One.", "A b.", None, None, "x . y"] and got[5] == "w" * 200 + "…"


def test_paths(spark):
    df = spark.createDataFrame([("../b.nix", "a/c/d.nix"), ("./x", "y"), ("../../z", "a/b"), ("/top", "a/b/c")], "p string, b string")
    assert [r[0] for r in df.select(text.folded("p", "b")).collect()] == ["a/b.nix", "x", None, "top"]
    assert values(spark, text.relative_link("x"), "a.md?plain=1#L3", "https://x", "//x", "#", "#top", "mailto:x") == ["a.md#L3", None, None, None, "#top", None]
    assert values(spark, text.decoded("x"), "a%20b+c") == ["a b+c"]
    assert values(spark, text.language_of("x"), "a.rs", "b.PY", "c.h", "d.txt", "e.pyi", "f.C", "x.d/sh") == ["rust", None, "c", None, None, None, None]
    heads = {
        "#!/usr/bin/env bash\n": "bash", "#!/bin/sh -e": "bash", "#!/usr/bin/env -S FOO=1 python3.12 -x\n": "python", "#!/usr/bin/env -u X python": "python", "#!/opt/bin/python2": None, "#!/bin/dash": None, "#!/usr/bin/zsh\n": None,
        "# -*- shell-script -*-\n": "bash", "\n# -*- mode: Sh; x: 1 -*-": "bash", "# -*- python -*-": None, "# notes\n\n# shellcheck shell=bash\nx=1": "bash", "x=1\n# shellcheck shell=bash": None, "# shellcheck shell=ksh": None, "": None,
    }
    got = {r.h: r.l for r in spark.createDataFrame([(h,) for h in heads], "h string").select("h", text.language_of(F.lit("bin/hook"), F.col("h")).alias("l")).collect()}
    assert got == heads
    assert values(spark, text.language_of("x", F.lit("#!/bin/bash")), "hook", "a.txt", "b.py") == ["bash", None, "python"]
    assert values(spark, text.test_file("x"), "tests/a.rs", "a/test_x.py", "x_test.go", "conftest.py", "src/contest.rs", "attest.py") == [True, True, True, True, False, False]
    assert values(spark, text.suffix_matches("x", ["Storage", "load"]), "a::Storage::load", "Storage::load#2", "MyStorage::load", "load") == [True, True, False, False]


def test_blob_ids(spark):
    import hashlib

    for t in ("", "héllo"):
        data = t.encode()
        assert values(spark, text.blob_id("x"), t) == [hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()]


@pytest.mark.parametrize(
    ("cond", "want"),
    [("unix", True), ("windows", False), ("feature = \"x\"", None), ('all(unix, target_os = "linux")', True), ("any(windows, foo)", None), ("not(windows)", True), ('all(windows, foo)', False), ("all()", True), ("any()", False)],
)
def test_cfg(cond, want):
    assert conditions.cfg(cond, {"unix": True, "windows": False, "target_os": {"linux"}}) is want


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("1 + 2 * 3", 7), ("defined(A) && !defined(B)", 1), ("UNKNOWN", None), ("0 && UNKNOWN", 0), ("1 || UNKNOWN", 1), ("A > 3 ? 10 : 20", 10), ("-1 > 0u", 1), ("-7 / 2", -3), ("-7 % 2", -1),
        ("1 / 0", None), ("0x10 | 010", 24), ("~0", -1), ("B", 0), ("'a' == 97", 1), ("A << 2", 20), ("f(3)", None),
    ],
)
def test_c_if(expression, want):
    assert conditions.c_if(expression, {"A": "(2 + 3)", "B": None}) == want


@pytest.mark.parametrize(
    ("test", "want"),
    [
        ("sys.platform == 'linux'", True), ("sys.platform.startswith('win')", False), ("os.name in ('nt', 'ce')", False), ("sys.version_info >= (3, 8)", True), ("not TYPE_CHECKING", True),
        ("something()", None), ("something() and sys.platform == 'win32'", False), ("something() or os.name == 'posix'", True), ("sys.version_info[0] == 3", True), ("1 +", None),
    ],
)
def test_python_if(test, want):
    host = {"sys.platform": "linux", "os.name": "posix", "sys.version_info": (3, 13, 0), "TYPE_CHECKING": False}
    assert conditions.python_if(test, host) is want


def test_conditions_as_columns(spark):
    df = spark.createDataFrame([("unix",), ("foo",), (None,), ("windows",)], "c string")
    got = {r.c: r.v for r in conditions.evaluated(df, "c", lambda t: conditions.cfg(t, {"unix": True, "windows": False}), "v").collect()}
    assert got == {"unix": True, "foo": None, None: None, "windows": False}
