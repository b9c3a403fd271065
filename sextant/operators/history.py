"""Commits tied to definitions: touched lines, renames, trailers and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators.intervals import overlapping
from sextant.operators.ranking import placed
from sextant.session import settled


def touches(hunks: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """rev, path, qualified, kind, added, removed of the definitions that hunks overlap: lines added count on
    the new side, lines removed on the old. `old` and `new` hold (rev, path, qualified, kind, start, end)."""
    key = ["rev", "path"]
    plus = overlapping(hunks, new, key, "new_start", "new_count").select(*key, "qualified", "kind", F.col("lines").alias("added"), F.lit(0).alias("removed"))
    minus = overlapping(hunks, old, key, "old_start", "old_count").select(*key, "qualified", "kind", F.lit(0).alias("added"), F.col("lines").alias("removed"))
    return plus.unionByName(minus).groupBy(*key, "qualified", "kind").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def followed(changes: DataFrame, paths: DataFrame, most: int = 10_000) -> DataFrame:
    """start, path and the range of places (`from` newest, down to `until`, excluded) in which a file now at `start` was at `path`.

    `changes` holds (place, path, renamed): place grows with age, and a rename tells the older
    path. Each round follows one more rename of every path that has one.
    """
    renames = changes.where("path is not null and place is not null and renamed is not null").groupBy("path", "place").agg(F.min("renamed").alias("renamed"))
    now = paths.select(F.col("path").alias("start"), "path", F.lit(-1).cast("long").alias("from")).distinct()
    # Many starts come to one path at one place: what follows there is looked up once.
    ends = now.select("path", "from").union(renames.select("renamed", "place")).distinct().select("path", F.col("from").alias("at"), F.lit(False).alias("rename"), F.lit(None).cast("string").alias("renamed"))
    marks = ends.unionByName(renames.select("path", F.col("place").alias("at"), F.lit(True).alias("rename"), "renamed")).withColumn("r", F.when(F.col("rename"), F.struct("at", "renamed")))
    after = Window.partitionBy("path").orderBy(F.desc("at"), "rename").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = marks.withColumn("r", F.last("r", ignorenulls=True).over(after)).where("not rename and r is not null")
    steps = settled(steps.select("path", F.col("at").alias("from"), F.col("r.at").alias("until"), F.col("r.renamed").alias("renamed")))
    done = None
    for _ in range(most):
        # Merged, not broadcast: steps are as many as renames, and a broadcast would send them to the driver in each round.
        next_ = settled(now.join(steps.hint("merge"), ["path", "from"], "left").select("start", "path", "from", "until", "renamed"))
        part = next_.select("start", "path", "from", "until")
        done = part if done is None else done.unionByName(part)
        now = next_.where("until is not null").select("start", F.col("renamed").alias("path"), F.col("until").alias("from"))
        if not now.take(1):
            break
    return done


def touching(commits: DataFrame, touched: DataFrame, changes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Commits (place, rev and more) that touched a wanted definition (path, qualified), newest first, its file's renames followed."""
    placed = touched.join(commits.select("rev", "place"), "rev")
    ranges = followed(changes.join(commits.select("rev", "place"), "rev").select("place", "path", "renamed"), wanted.select("path").distinct())
    at = wanted.select(F.col("path").alias("start"), "qualified").join(ranges, "start")
    # The renaming commit itself changed the file under its newer path.
    hits = at.join(placed, ["path", "qualified"]).where((F.col("place") > F.col("from")) & (F.col("until").isNull() | (F.col("place") <= F.col("until"))))
    return hits.select("start", "qualified", "rev", "place", "added", "removed").join(commits.drop("place"), "rev").orderBy("place", "start", "qualified")


def of_task(trailers: DataFrame, key: str, task: str) -> DataFrame:
    """Revisions whose trailer `key` (in any case) lists `task`."""
    held = F.array_contains(F.split(F.trim("value"), r"[,\s]+"), task)
    return trailers.where((F.lower("key") == key.lower()) & held).select("rev").distinct()


def rolled_up(touched: DataFrame, key: list[str], place: str) -> DataFrame:
    """Added, removed and commits of each definition, first seen at `first`, most changed first as `nth`."""
    sums = touched.groupBy(*key).agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("commits"), F.min(place).alias("first"))
    return placed(sums, [F.desc(F.col("added") + F.col("removed")), "first", *key], "nth")


def tasks_of(commits: DataFrame, trailers: DataFrame, tasks: DataFrame, key: str = "task", listed: DataFrame | None = None) -> DataFrame:
    """Tasks (id, commits) that commits name in a trailer and that list the commit by a short id; first commit first.

    `listed` holds the short ids as rows (id, short) where they are too many for the lists
    `commits`. A commit's id is cut to each length that short ids have, so the two meet by equality.
    """
    if listed is None:
        listed = tasks.select("id", F.explode("commits").alias("short"))
    lengths = listed.where("short is not null").select(F.length("short").alias("cut")).distinct()
    named = trailers.where(F.lower("key") == key).select("rev", F.explode(F.split(F.trim("value"), r"[,\s]+")).alias("id"))
    found = named.join(commits.select("rev", "sha", "place"), "rev").join(F.broadcast(lengths), F.col("cut") <= F.length("sha"))
    believed = found.withColumn("short", F.substring("sha", F.lit(1), F.col("cut"))).join(listed.select("id", "short"), ["id", "short"], "left_semi")
    return believed.groupBy("id").agg(F.min("place").alias("first"), F.count_distinct("rev").alias("n")).join(tasks.drop("commits"), "id").orderBy("first", "id")
