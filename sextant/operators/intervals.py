"""Joins of points and intervals with intervals, nesting and extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 64


def _buckets(lo: Column, hi: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def around(points: DataFrame, spans: DataFrame, key: list[str], at: str, id_: str, width: int = BUCKET) -> DataFrame:
    """Pairs of points (key, `at`) and the spans (key, start, end, `id_`) that hold them.

    Spans are dealt to buckets of `width`, so this is an equi-join on key and bucket, however long
    the file; a point is in one bucket only, so no pair comes twice.
    """
    dealt = spans.withColumn("bucket_", _buckets(F.col("start"), F.col("end"), width))
    held = points.withColumn("bucket_", F.floor(F.col(at) / width))
    return held.join(dealt, [*key, "bucket_"]).where((F.col("start") <= F.col(at)) & (F.col(at) <= F.col("end"))).drop("bucket_")


def innermost(points: DataFrame, spans: DataFrame, key: list[str], at: str, point: list[str], id_: str, width: int = BUCKET) -> DataFrame:
    """Each point with the `id_` of the innermost span around it: latest start, then earliest end, then least id; null if none."""
    found = around(points, spans, key, at, id_, width)
    best = found.groupBy(*point).agg(F.max_by(F.col(id_), F.struct(F.col("start"), -F.col("end"), -F.col(id_))).alias(id_))
    return points.join(best, point, "left")


def stack(points: DataFrame, spans: DataFrame, key: list[str], at: str, point: list[str], id_: str) -> DataFrame:
    """All spans around each point, depth 1 the innermost."""
    order = Window.partitionBy(*point).orderBy(F.desc("start"), "end", id_)
    return around(points, spans, key, at, id_).withColumn("depth", F.row_number().over(order))


def overlap(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Common whole numbers of two intervals of (start, count); a count of 0 has none."""
    lo, hi = F.greatest(a[0], b[0]), F.least(a[0] + a[1], b[0] + b[1])
    return F.greatest(hi - lo, F.lit(0))


def overlapping(hunks: DataFrame, spans: DataFrame, key: list[str], start: str, count: str, width: int = BUCKET) -> DataFrame:
    """Pairs of hunks (key, `start`, `count`) and spans (key, start, end) with `lines`, how many they share, where any."""
    dealt = spans.withColumn("bucket_", _buckets(F.col("start"), F.col("end"), width))
    some = hunks.where(F.col(count) > 0).withColumns({"h_lo": F.col(start), "h_hi": F.col(start) + F.col(count) - 1}).drop(*({start, count} & {"start", "end"}))
    some = some.withColumn("bucket_", _buckets(F.col("h_lo"), F.col("h_hi"), width))
    first = F.floor(F.greatest("h_lo", "start") / width)  # the pair counts in the first bucket that both reach
    found = some.join(dealt, [*key, "bucket_"]).where((F.col("h_lo") <= F.col("end")) & (F.col("start") <= F.col("h_hi")) & (F.col("bucket_") == first))
    return found.withColumn("lines", F.least("h_hi", "end") - F.greatest("h_lo", "start") + 1).drop("bucket_", "h_lo", "h_hi")


def depths(spans: DataFrame, key: list[str], id_: str) -> DataFrame:
    """Nesting depth of well-nested spans: how many others hold them. Of equal spans the lesser id is outside."""
    outer = spans.select(*key, F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col(id_).alias("o_id"))
    inside = (F.col("o_start") <= F.col("start")) & (F.col("end") <= F.col("o_end")) & (F.col("o_id") != F.col(id_))
    same = (F.col("o_start") == F.col("start")) & (F.col("o_end") == F.col("end"))
    dealt = outer.withColumn("bucket_", _buckets(F.col("o_start"), F.col("o_end"), BUCKET))
    held = spans.withColumn("bucket_", F.floor(F.col("start") / BUCKET)).join(dealt, [*key, "bucket_"]).where(inside & (~same | (F.col("o_id") < F.col(id_))))
    n = held.groupBy(*key, id_).agg(F.count("*").alias("depth"))
    return spans.join(n, [*key, id_], "left").withColumn("depth", F.coalesce("depth", F.lit(0)).cast("long"))


def extents(headings: DataFrame, key: list[str], at: str, level: str, last: str) -> DataFrame:
    """Headings with `until`: the place before the next heading of the same or a higher level
    (a number no greater), else `last`. Levels are few, so each level looks ahead for itself."""
    ahead = Window.partitionBy(*key).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.when(F.col(level) == k, F.first(F.when(F.col(level) <= k, F.col(at)), ignorenulls=True).over(ahead)) for k in range(1, 7)]
    return headings.withColumn("until", F.coalesce(F.coalesce(*nexts) - 1, F.col(last)))


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """`rows` with `name` made distinct within `key`: the second of a name becomes `name#2`."""
    nth = F.row_number().over(Window.partitionBy(*key, name).orderBy(*order))
    return rows.withColumn(name, F.when(nth > 1, F.concat(F.col(name), F.lit("#"), nth.cast("string"))).otherwise(F.col(name)))


def nearest_prefix(paths: DataFrame, roots: DataFrame, path: str, root: str, separator: str = "/") -> DataFrame:
    """Each path with its longest root that is one of its folders: folders are exploded, so it is an equi-join."""
    cut = F.split(F.col(path), separator)
    folders = F.transform(F.sequence(F.lit(1), F.size(cut)), lambda k: F.array_join(F.slice(cut, 1, k), separator))
    found = paths.select(path, F.explode(folders).alias(root)).distinct().join(roots.select(root).distinct(), root)
    best = found.groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return paths.join(best, path, "left")


def suffixes(paths: DataFrame, path: str, name: str = "suffix", separator: str = "/") -> DataFrame:
    """Each path with each of its suffixes of whole segments, for equi-joins by a written tail."""
    cut = F.split(F.col(path), separator)
    tails = F.transform(F.sequence(F.lit(1), F.size(cut)), lambda k: F.array_join(F.slice(cut, k, F.size(cut)), separator))
    return paths.withColumn(name, F.explode(tails))
