"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The members of the enumerated columns.
LANGUAGES = ("rust", "nix", "bash", "python", "c", "markdown")
KINDS = (
    "function", "method", "struct", "enum", "union", "trait", "impl", "module", "const", "static", "macro", "type_alias", "variant", "attribute", "variable", "option", "input", "file",
    "argument", "environment", "section", "class", "declaration", "anchor",
)
CALL_KINDS = ("free", "method", "path", "macro")
REF_KINDS = ("type", "path", "value", "set", "mention")
RULES = (
    "nested", "module", "import", "glob", "path", "receiver", "unique", "scope", "file", "folder", "input", "option", "source", "environment", "caller", "override", "fallback", "include",
    "field", "computed", "anchor",
)


def struct(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split() for f in text.split(", "))])


SYMBOL = struct("ord int, name string, qualified string, kind string, start int, end int, doc string, internal boolean, typed string, consumed boolean, value string, declared boolean")
CALL = struct("ord int, name string, path string, kind string, line int, caller string, receiver string, local string, typed string")
REFERENCE = struct("ord int, name string, path string, kind string, line int, user string, local string, typed string")
IMPORT = struct("ord int, path string, alias string, glob boolean, public boolean, line int, importer string, via string, condition string")
BRANCH = struct("ord int, start int, end int, condition string")
EXTRACTION = T.StructType(
    [
        T.StructField("symbols", T.ArrayType(SYMBOL)), T.StructField("calls", T.ArrayType(CALL)), T.StructField("refs", T.ArrayType(REFERENCE)), T.StructField("imports", T.ArrayType(IMPORT)),
        T.StructField("branches", T.ArrayType(BRANCH)), T.StructField("guard", T.StringType()), T.StructField("syntax_error", T.BooleanType()), T.StructField("too_deep", T.BooleanType()),
    ]
)
EXTRACTED = T.StructType([T.StructField("blob", T.StringType()), T.StructField("language", T.StringType()), *EXTRACTION.fields])
NOTE = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("title", T.StringType()), T.StructField("superseded_by", T.ArrayType(T.LongType()))])
TASKS = T.StructType([T.StructField("id", T.StringType()), T.StructField("state", T.StringType()), T.StructField("title", T.StringType()), T.StructField("commits", T.ArrayType(T.StringType())), T.StructField("notes", T.ArrayType(NOTE))])
