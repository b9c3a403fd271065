"""The budget cut: a prefix of an answer's lines by rank that fits a number of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = 4


def rank_key(tier: Column, n: Column) -> Column:
    """Lines of a higher tier first, then in order of n."""
    return tier * 100_000 - F.least(n, F.lit(99_999))


def budget_cut(lines: DataFrame, budget: int, reserve: int = 0, group: list[str] | None = None) -> DataFrame:
    """Lines (ord, rank, size) that stand in the longest prefix, by rank from the highest and then
    ord, whose bytes and line ends fit `budget` tokens less `reserve` bytes; with `cum`.

    Sizes are positive, so the prefix is what a running sum does not exceed. `group` cuts
    several answers at once, each to the budget.
    """
    order = Window.partitionBy(*[F.col(g) for g in group or []]) if group else Window.partitionBy(F.lit(0))
    running = F.sum(F.col("size") + 1).over(order.orderBy(F.desc("rank"), "ord").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("cum", running).where(F.col("cum") <= budget * TOKEN - reserve)


def left_out(lines: DataFrame, kept: DataFrame, part: str = "part", key: str = "ord") -> DataFrame:
    """Lines left out for each part, in the order the parts are first seen."""
    return lines.join(kept.select(key), key, "left_anti").groupBy(part).agg(F.count("*").alias("n"), F.min(key).alias("first")).orderBy("first")


def rendered(lines: list[dict], head: str, budget: int) -> tuple[list[str], dict | None]:
    """Text of an answer held by the driver: dicts of text, rank, part, heads (number of lines it
    heads, none for a plain line), in order. Headings whose lines are all cut go too, and the
    note on the cut fits the budget: the reserve grows until it does."""
    room = budget * TOKEN - len(head.encode()) - 1
    sizes = [len(line["text"].encode()) + 1 for line in lines]
    if sum(sizes) <= room:
        return [head, *(line["text"] for line in lines)], None
    needed = -(-(sum(sizes) + len(head.encode()) + 1) // TOKEN)
    reserve, best = 0, ([head], None)
    for _ in range(8):
        keep, used = set(), 0
        for i in sorted(range(len(lines)), key=lambda k: -lines[k]["rank"]):
            if used + sizes[i] > room - reserve:
                break
            used += sizes[i]
            keep.add(i)
        for i, line in enumerate(lines):
            if i in keep and line.get("heads") and not any(j in keep for j in range(i + 1, i + 1 + line["heads"])):
                keep.discard(i)
        gone: dict[str, int] = {}
        for i, line in enumerate(lines):
            if i not in keep:
                gone[line["part"]] = gone.get(line["part"], 0) + 1
        note = f"cut to {budget} tokens, leaving out " + ", ".join(f"{p} {n}" for p, n in gone.items()) + f"; --budget {needed} holds it all"
        best = ([head, *(line["text"] for i, line in enumerate(lines) if i in keep), note], {"budget": budget, "left_out": gone, "needed": needed})
        if sum(sizes[i] for i in keep) + len(note.encode()) + 1 <= room:
            break
        reserve = max(reserve + 1, len(note.encode()) + 1)
    return best
