"""Line dedup with a log-template tree, in DataFrame functions only.

Lines are parsed as log lines are: down a tree of fixed depth, first by the number of
tokens, then by the leading tokens, where a token with a digit in it stands for any. A leaf
holds the lines of one path. Its commonest line, in terms of documents, is a template;
lines that share enough of their tokens with it, place by place, are of that template, and
the places in which they differ are variable fields. The commonest of the lines left is the
next template, and so on, until the lines left in a leaf are too few to be dropped. A round
takes the leading lines of all leaves at once, finds the templates among them, and hands
every line left to the first it is like, which is what one template after the other does.
A template found in enough documents is boilerplate, and its lines are dropped. The two joins
that move texts are sort-merge joins at every size, so that a hot line's rows can be split.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import Door, empty, removed, written

DEPTH = 3
SIMILAR = 0.7
LEAST_DOCUMENTS = 3
FIELD = "<*>"
#: Lines of a leaf that a round looks for templates among; more take more rounds.
LEADING = 128
#: Parts of a leaf whose leading lines are found apart.
SALTS = 64


def shapes(lines: Column) -> Column:
    """Of each line, its tokens between single spaces, those with a digit as FIELD, and how many
    there are. Most lines have neither digits nor white space to mend, which plain searches of
    their bytes tell; each step is a lambda's argument to the next, so it is made once."""

    def masked(line: Column) -> Column:
        fields = F.regexp_replace(line, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+", FIELD)
        return F.when(reduce(or_, (F.contains(line, F.lit(d)) for d in "0123456789")), fields).otherwise(line)

    def mended(line: Column) -> Column:
        odd = reduce(or_, (F.contains(line, F.lit(c)) for c in ("  ", "\t", "\x0b", "\x0c", "\r"))) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
        return F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]++", " "))).otherwise(line)

    counted = lambda x: F.struct(x.alias("shape"), F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("n"))
    return F.transform(F.transform(F.transform(lines, masked), mended), counted)


def leaf(n: Column, shape_: Column, depth: int) -> Column:
    """The path down the tree: number of tokens, and the leading ones."""
    return F.xxhash64(n, F.substring_index(shape_, " ", depth))


def alike(one: Column, other: Column, similar: float) -> Column:
    """Whether two lists of as many tokens agree in enough of their places."""
    equal = F.aggregate(F.zip_with(one, other, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    return equal >= F.size(one) * similar


def leaders(lines: DataFrame, similar: float, leading: int) -> DataFrame:
    """leaf and heads: the templates among the first `leading` of its `lines` (leaf, own, shape,
    n), by n and then shape from the last in order; a line like an earlier template is none."""
    order = (F.desc("n"), F.desc("shape"), F.desc("own"))
    for by in (["leaf", "salt"], ["leaf"]):
        lines = lines.withColumn("salt", F.pmod("own", F.lit(SALTS))).withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= leading)
    first = lines.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("nth", "shape", "own"))).alias("first"))
    tokens = F.transform("first", lambda x: F.struct(F.split(x["shape"], " ").alias("tokens"), x["own"].alias("own")))
    heads = F.aggregate(
        tokens, F.array().cast("array<struct<tokens:array<string>,own:bigint>>"),
        lambda got, x: F.when(F.exists(got, lambda h: alike(h["tokens"], x["tokens"], similar)), got).otherwise(F.concat(got, F.array(x))),
    )
    return first.select("leaf", heads.alias("heads"))


def families(lines: DataFrame, similar: float, least_documents: int, leading: int) -> tuple[DataFrame, list[str]]:
    """leaf, own and template of all `lines` (leaf, own, shape, n) but those left when a leaf's
    are of fewer than `least_documents` documents, and the folders written."""
    done, paths, left = None, [], lines
    while True:
        tokens = F.split("shape", " ")
        # As a lambda's argument the tokens are split once for a line, not once for a template.
        like = F.get(F.transform(F.array(tokens), lambda t: F.filter("heads", lambda h: alike(t, h["tokens"], similar)))[0], F.lit(0))["own"]
        found, path = written(left.join(leaders(left, similar, leading), "leaf").select("leaf", "own", like.alias("template"), F.when(like.isNull(), F.col("shape")).alias("shape"), "n"), "templates")
        paths.append(path)
        part = found.where("template is not null").select("leaf", "own", "template")
        done = part if done is None else done.unionByName(part)
        rest = found.where("template is null").drop("template")
        enough = rest.groupBy("leaf").agg(F.sum("n").alias("all")).where(F.col("all") >= least_documents).select("leaf")
        left, path = written(rest.join(enough, "leaf"), "left")
        paths.append(path)
        if empty(left):
            return done, paths


def without_boilerplate(documents: DataFrame, depth: int = DEPTH, similar: float = SIMILAR, least_documents: int = LEAST_DOCUMENTS, leading: int = LEADING) -> DataFrame:
    """`documents` (doc_id, text; other columns stay) and, of each row: line_n (lines),
    line_dropped (numbers, from 0, of the lines dropped, in order), line_kept (the other
    lines, joined by line feeds).

    Lines end at line feeds; tokens are runs of anything but ASCII white space. Blank lines
    stay. The leaf of a line of up to `depth` tokens is all of the line, so short lines are of
    a template only where they are equal, fields aside. A template's documents are counted
    by doc_id (null is one more); repeated rows and lines repeated within a document count
    once. A null text has no lines and line_kept null, an empty one has one empty line. Ties
    for the commonest line go to the line that is last in order. Rows that share a doc_id are
    one document: a line of one of them is also dropped where another has, under the same
    number, a line of the same leaf that is. Other columns stay; one that has one of the three
    names comes back with `_input` added.
    """
    door = Door(documents, ("line_n", "line_dropped", "line_kept"))
    own = door.rows.withColumns({"line_all": F.split(F.col(door.of("text")).cast("string"), "\n", -1), "doc_id": F.col(door.of("doc_id"))})
    # Made before the explosion, a shape is made once, however often it is used below.
    found = own.select("doc_id", F.posexplode(shapes(F.col("line_all"))).alias("at", "x")).select("doc_id", "at", "x.shape", "x.n").where(F.col("n") > 0)
    found = found.select("doc_id", "at", leaf(F.col("n"), F.col("shape"), depth).alias("leaf"), F.xxhash64("shape").alias("own"), "shape")
    light, light_path = written(found.drop("shape"), "lines")
    # Only leaves that enough documents reach can hold a template of as many.
    reached = light.select("leaf", "doc_id").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= least_documents).select("leaf")
    per_line = light.join(reached, "leaf").select("leaf", "own", "doc_id").distinct().groupBy("leaf", "own").agg(F.count("*").alias("n"))
    per_line, per_path = written(per_line, "shapes")
    # Each distinct line of such a leaf once.
    texts = found.join(per_line.hint("merge"), ["leaf", "own"]).groupBy("leaf", "own").agg(F.first("shape").alias("shape"), F.first("n").alias("n"))
    texts, shapes_path = written(texts, "shapes")
    templates, templates_paths = families(texts, similar, least_documents, leading)
    lines = light.join(templates, ["leaf", "own"]).select("doc_id", "at", "leaf", "template")
    common = lines.select("leaf", "template", "doc_id").distinct().groupBy("leaf", "template").agg(F.count("*").alias("n")).where(F.col("n") >= least_documents)
    gone = lines.join(common.select("leaf", "template"), ["leaf", "template"], "left_semi").select("doc_id", "at", "leaf").distinct()
    # A row of another text under the same doc_id must not lose its line of that number, so leaves go along.
    gone, _ = written(gone.groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_list(F.struct("at", "leaf")).alias("gone")), "gone")
    removed(door.spark, light_path, per_path, shapes_path, *templates_paths)
    out = own.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    line = lambda g: F.element_at("line_all", F.least(g["at"] + 1, F.size("line_all")))
    numbers = F.transform(F.filter("gone", lambda g: (g["at"] < F.size("line_all")) & F.exists(shapes(F.array(line(g))), lambda x: g["leaf"] == leaf(x["n"], x["shape"], depth))), lambda g: g["at"])
    out = out.withColumn("line_dropped", F.when(F.col("line_all").isNotNull(), F.coalesce(F.sort_array(F.array_distinct(numbers)), F.array().cast("array<int>"))))
    kept = F.filter("line_all", lambda x, i: ~F.array_contains("line_dropped", i))
    return door.out(
        out, F.when(F.col("line_all").isNull(), F.lit(0)).otherwise(F.size("line_all")).cast("long").alias("line_n"),
        F.coalesce("line_dropped", F.array().cast("array<int>")).alias("line_dropped"), F.when(F.col("line_all").isNotNull(), F.array_join(kept, "\n")).alias("line_kept"),
    )


def digested(cut: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of the rows of `without_boilerplate`."""
    return cut.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("line_n").alias("n_lines"), F.size("line_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("line_kept", F.lit("")), 256).alias("kept_sha256"))
