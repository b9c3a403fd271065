"""Joins in tiers: the first tier with a hit settles a use, and ambiguity is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of dealt rows that a task makes, about.
TASK_BYTES = 128 << 20


def one(hits: DataFrame, site: list[str], target: str, rule: str = "rule") -> DataFrame:
    """Hits of a site as one row: status resolved, ambiguous or external, the rule, and the distinct targets in order.

    A hit without a target is a hit all the same: it settles the site as external.
    """
    return (
        hits.groupBy(*site)
        .agg(F.sort_array(F.collect_set(target)).alias("targets"), F.min(rule).alias("rule"))
        .withColumn("status", F.when(F.size("targets") == 0, "external").when(F.size("targets") == 1, "resolved").otherwise("ambiguous"))
        .withColumn("rule", F.when(F.col("status") == "resolved", F.col("rule")))
    )


def first_tier(sites: DataFrame, tiers: list[tuple[str, DataFrame]], site: list[str], target: str) -> DataFrame:
    """`sites` with status, rule and targets. Each tier is (rule, hits): rows of the site's key and
    `target`, null for a hit that leads outside. Only the first tier in which a site has a hit
    counts; a site with none is external."""
    every = None
    for k, (rule, hits) in enumerate(tiers):
        rows = hits.select(*site, target).withColumns({"tier": F.lit(k), "rule": F.lit(rule)})
        every = rows if every is None else every.unionByName(rows)
    first = every.withColumn("best", F.min("tier").over(Window.partitionBy(*site))).where("tier = best")
    settled = one(first, site, target)
    out = sites.join(settled, site, "left")
    return out.withColumns({"status": F.coalesce("status", F.lit("external")), "targets": F.coalesce("targets", F.array().cast(settled.schema["targets"].dataType))})


def dealt(sites: DataFrame, told: DataFrame, scope: list[str], size: Column) -> DataFrame:
    """`sites` with what `told` has for their scope, of `size` bytes each.

    `told` has one row a scope, few but maybe wide, and is broadcast; sites are dealt evenly to as
    many tasks as the bytes of all rows ask for, so neither a hot scope nor wide rows make a long task.
    """
    wide = told.select(*scope, size.cast("long").alias("size"))
    n = sites.groupBy(*scope).agg(F.count("*").alias("k")).join(F.broadcast(wide), scope).agg(F.sum(F.col("k") * F.col("size"))).first()[0] or 0
    tasks = -(-n // TASK_BYTES)
    return (sites.repartition(tasks) if tasks > 1 else sites).join(F.broadcast(told), scope)
