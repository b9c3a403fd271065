"""Graph operators as driver loops over DataFrames, each step settled in the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.session import settled

# Fixed values.
DAMPING, TOLERANCE, STEPS = 0.85, 1e-6, 100
AMBIGUOUS = 0.1
DEEPEST = 5
FOLLOWED = 8


def combined(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, w) added up; loops and weights of 0 or less go."""
    return edges.where("src != dst and w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def use_weight(status: Column, n: Column, outside: Column) -> Column:
    """What an edge to one of n targets weighs: 1 resolved, a share of 0.1 ambiguous, 0 if it may lead outside."""
    return F.when(status == "resolved", F.lit(1.0)).when((status == "ambiguous") & ~outside, F.lit(AMBIGUOUS) / n).otherwise(F.lit(0.0))


def tempered(edges: DataFrame) -> DataFrame:
    """Edges with `part`, what share of src's rank goes along each: weights above 1 count as their
    square root, and a node whose weights sum to less than 1 keeps the rest back."""
    own = edges.withColumn("w", F.when(F.col("w") > 1, F.sqrt("w")).otherwise(F.col("w")))
    out = own.groupBy("src").agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("out"))
    return own.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("part"))


def pagerank(nodes: DataFrame, edges: DataFrame, focus: DataFrame | None = None, steps: int = STEPS, tolerance: float = TOLERANCE, every: int = 5) -> DataFrame:
    """id and share of each of `nodes` (id): shares add up to 1.

    `focus` (id, weight) is where jumps lead, all nodes alike without it; what nodes keep back
    jumps too. Ends when shares move by less than `tolerance` in all, or after `steps`.
    """
    n = nodes.count()
    jump = nodes.select("id", F.lit(1.0 / max(n, 1)).alias("jump"))
    if focus is not None:
        total = focus.agg(F.sum("weight")).first()[0] or 1.0
        jump = nodes.join(focus.groupBy("id").agg(F.sum("weight").alias("f")), "id", "left").select("id", (F.coalesce("f", F.lit(0.0)) / total).alias("jump"))
    jump = settled(jump)
    along = settled(tempered(combined(edges)))
    share = jump.select("id", F.col("jump").alias("share"))
    for step in range(steps):
        flow = along.join(share, along.src == share.id).groupBy("dst").agg((F.sum(F.col("part") * F.col("share")) * DAMPING).alias("in"))
        came = jump.join(flow, jump.id == flow.dst, "left").select("id", "jump", F.coalesce("in", F.lit(0.0)).alias("in"))
        came = settled(came)
        rest = 1.0 - (came.agg(F.sum("in")).first()[0] or 0.0)
        now = came.select("id", (F.col("in") + F.lit(rest) * F.col("jump")).alias("share"))
        if tolerance > 0:
            moved = now.withColumnRenamed("share", "now").join(share, "id").agg(F.sum(F.abs(F.col("now") - F.col("share")))).first()[0] or 0.0
            share = now
            if moved < tolerance:
                break
        else:
            share = now
    return share


def levels(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Nodes reached from `start` (id) along edges (src, dst), with the first level that reaches them; start is level 0."""
    seen = settled(start.select("id").distinct().withColumn("level", F.lit(0)))
    front = seen
    for level in range(1, max(1, min(depth, DEEPEST)) + 1):
        new = edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        front = settled(new.withColumn("level", F.lit(level)))
        if not front.take(1):
            break
        seen = settled(seen.unionByName(front))
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """Pairs (src, dst) of nodes joined by a path of one edge or more, src and dst apart: new pairs are extended until none is new."""
    base = settled(edges.select("src", "dst").where("src != dst").distinct())
    known, front = base, base
    while front.take(1):
        further = front.join(base.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).where("src != dst").distinct()
        front = settled(further.join(known, ["src", "dst"], "left_anti"))
        known = settled(known.unionByName(front))
    return known


def followed(aliases: DataFrame, depth: int = FOLLOWED) -> DataFrame:
    """Aliases (name, to) followed to where they end, within `depth` steps."""
    out = aliases.select("name", "to")
    for _ in range(depth - 1):
        on = aliases.select(F.col("name").alias("to"), F.col("to").alias("on"))
        out = out.join(on, "to", "left").select("name", F.coalesce("on", "to").alias("to"))
    return out


def linearized(bases: dict[str, list[str]], name: str, depth: int = FOLLOWED) -> list[str]:
    """C3 order of a class and its bases; where they disagree, or beyond `depth`, depth first."""

    def merged(lists: list[list[str]]) -> list[str] | None:
        out: list[str] = []
        lists = [list(x) for x in lists if x]
        while lists:
            head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
            if head is None:
                return None
            out.append(head)
            lists = [y for y in ([z for z in x if z != head] for x in lists) if y]
        return out

    def order(c: str, left: int) -> list[str]:
        if not left:
            return [c]
        above = [order(b, left - 1) for b in bases.get(c, [])]
        got = merged([*above, list(bases.get(c, []))])
        return [c, *(got if got is not None else dict.fromkeys(x for a in above for x in a if x != c))]

    return order(name, depth)
