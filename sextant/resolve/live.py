"""Definitions that no build on the host compiles or runs are no targets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions import conditions
from sextant.operators.intervals import around
from sextant.resolve import cargo

#: What is decided of the host; everything else is unknown and excludes nothing.
RUST = {"unix": True, "windows": False, "target_os": {"linux"}, "target_family": {"unix"}, "target_pointer_width": {"64"}, "target_endian": {"little"}}
C = {"__linux__": "1", "__unix__": "1", "__STDC__": "1", "_WIN32": None, "_WIN64": None, "__APPLE__": None, "__MACH__": None, "__cplusplus": None, "_MSC_VER": None, "__FreeBSD__": None}
PYTHON = {"sys.platform": "linux", "os.name": "posix", "TYPE_CHECKING": False, "sys.version_info": (3, 13, 0)}


def value(language: str, condition: str, features: set[str] | None = None) -> bool | None:
    if language == "rust":
        return conditions.cfg(condition, RUST if features is None else RUST | {"feature": features})
    if language == "python":
        return conditions.python_if(condition, PYTHON)
    if language == "c":
        got = conditions.c_if(condition, C)
        return None if got is None else bool(got)
    return None


def dead(branches: DataFrame, features: dict[str, set[str]] | None = None) -> DataFrame:
    """Branches (language, path, start, end, condition) that are false on the host; each distinct condition
    is judged once, and once a package where it asks for features. `features` has those on by package."""
    on = dict(features or {})

    @F.pandas_udf("boolean")
    def judged(languages: pd.Series, texts: pd.Series, packages: pd.Series) -> pd.Series:
        return pd.Series([value(lang, t, on.get(p)) for lang, t, p in zip(languages, texts, packages, strict=True)], dtype=object)

    asks = (F.col("language") == "rust") & F.col("condition").contains("feature")
    rows = branches.where("condition is not null").withColumn("package", F.when(asks, cargo.package_of("path")).otherwise(""))
    known = rows.select("language", "condition", "package").distinct().withColumn("live", judged("language", "condition", "package"))
    return rows.join(known.where("live = false"), ["language", "condition", "package"], "left_semi").drop("package")


def live(symbols: DataFrame, branches: DataFrame, features: dict[str, set[str]] | None = None, skipped: list[str] = ()) -> DataFrame:
    """`symbols` without those that start in a branch false on the host, and those of files `skipped`, which no build reads."""
    gone = dead(branches, features).select("path", "start", "end", F.col("ord").alias("b_ord"))
    at = symbols.where("kind != 'file'").select("path", F.col("ord").alias("s_ord"), F.col("start").alias("at"))
    inside = around(at, gone, ["path"], "at", "b_ord").select("path", F.col("s_ord").alias("ord")).distinct()
    built = symbols.where((F.col("kind") == "file") | ~F.col("path").isin(*skipped)) if skipped else symbols
    return built.join(inside, ["path", "ord"], "left_anti")
