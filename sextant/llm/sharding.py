"""Sharding by a hypergeometric communication matrix.

A uniform shuffle into shards of exact sizes, without moving a row twice to find its place:
how many rows each partition sends to each shard is drawn first, from the multivariate
hypergeometric law that a uniform shuffle of all rows would follow. Each partition deals its
rows to the shards in a random order of its own, the rows are exchanged, and each shard is
permuted again: rows carry a random key, shards are cut into ranges of keys, counts of the
ranges give their first slots, and each range orders its rows by key.

The matrix is drawn in two steps, which follow the same law: the driver draws the rows of at
most GROUPS groups of partitions, and a task draws, of its own group alone, the rows of the
partitions. What is sent to tasks is the groups' matrix, of a fixed size, and eight bytes a partition.

The labels and keys of a partition depend on its number, its number of rows and the seed
alone, so a lost task comes out the same, and the ranges are counted without reading rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import Door, lean

SHARDS = 16
#: Rows that a range of keys within a shard holds about.
RANGE_ROWS = 4000
KEY_BITS = 62
#: Groups of partitions whose rows of the matrix the driver draws.
GROUPS = 1024


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws from good + bad, not put back, are good.

    By inversion around the mode: the law's weights follow from each other by ratios, as far
    out as they are over 1e-25 of the greatest, so this holds for any number of rows."""
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    p = good / (good + bad)
    reach = int(12 * math.sqrt(n * p * (1 - p) + 1)) + 64
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    over = np.cumprod((good - up) / (up + 1) * ((n - up) / (bad - n + up + 1)))
    under = np.cumprod(down / (good - down + 1) * ((bad - n + down) / (n - down + 1)))
    weights = np.concatenate((under[::-1], [1.0], over))
    total = np.cumsum(weights)
    return mode - len(under) + int(np.searchsorted(total, draw.random() * total[-1], side="right"))


def rows_to_shards(draw: np.random.Generator, rows: list[int], left: np.ndarray) -> np.ndarray:
    """matrix[p, s]: how many of its rows each of several lots sends to each shard that has `left` places, all of them filled."""
    left = left.copy()
    out = np.zeros((len(rows), len(left)), np.int64)
    for p, n in enumerate(rows):
        need, beyond = int(n), int(left.sum())
        for s in range(len(left)):
            beyond -= int(left[s])
            out[p, s] = hypergeometric(draw, int(left[s]), beyond, need)
            need -= int(out[p, s])
        left -= out[p]
    return out


class Communication:
    """matrix[p, s]: rows that partition p sends to shard s; shard sizes are at most one apart."""

    def __init__(self, rows: list[int], shards: int, seed: int, groups: int = GROUPS):
        self.rows, self.seed = np.array(rows, np.int64), seed
        self.width = max(1, -(-len(rows) // groups))
        draw = np.random.default_rng([seed, 1])
        total = int(self.rows.sum())
        sizes = np.full(shards, total // shards, np.int64)
        sizes[draw.permutation(shards)[: total % shards]] += 1
        lots = [int(self.rows[at : at + self.width].sum()) for at in range(0, len(rows), self.width)]
        self.groups = rows_to_shards(draw, lots, sizes)
        self.drawn: tuple[int, np.ndarray] = (-1, np.zeros((0, shards), np.int64))

    def of(self, p: int) -> np.ndarray:
        """The row of partition p, of which its group is drawn."""
        g = p // self.width
        if self.drawn[0] != g:
            some = self.rows[g * self.width : (g + 1) * self.width].tolist()
            self.drawn = (g, rows_to_shards(np.random.default_rng([self.seed, 3, g]), some, self.groups[g]))
        return self.drawn[1][p - g * self.width]


def dealt(p: int, counts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and key of each row of partition p, in the order of its rows."""
    draw = np.random.default_rng([seed, 2, p])
    labels = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    return draw.permutation(labels), draw.integers(0, 1 << KEY_BITS, len(labels), dtype=np.int64)


def _labelled(matrix, at_of, seed: int, payload: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, labels = 0, None
        for part in batches:
            if not part.num_rows:
                continue
            if labels is None:
                p = part.column("sh_partition")[0].as_py()
                k = np.searchsorted(at_of.value, p)
                if k == len(at_of.value) or at_of.value[k] != p:
                    raise RuntimeError(f"partition {p} had no rows when partitions were counted: the input's partitions are not stable; write it first")
                labels, keys = dealt(p, matrix.value.of(int(k)), seed)
            if at + part.num_rows > len(labels):
                raise RuntimeError(f"partition {p} has more rows than were counted: the input's partitions are not stable; write it first")
            rows = slice(at, at := at + part.num_rows)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in payload), pa.array(labels[rows]), pa.array(keys[rows])], names=[*payload, "sh_shard", "sh_key"])
        if labels is not None and at < len(labels):
            raise RuntimeError(f"partition {p} has fewer rows than were counted: the input's partitions are not stable; write it first")

    return run


def _counted(matrix, at_of, seed: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part in batches:
            for k in sorted(part.column("k").to_pylist()):
                counts = matrix.value.of(k)
                labels, keys = dealt(int(at_of.value[k]), counts, seed)
                got = np.bincount(labels.astype(np.int64) * ranges + (keys >> KEY_BITS - ranges.bit_length() + 1), minlength=len(counts) * ranges)
                total = got if not len(total) else total + got
        if len(total):
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    return run


MADE = ("shard", "slot")


def sharded(rows: DataFrame, shards: int = SHARDS, seed: int = 9, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`rows` with shard (0 to `shards` - 1) and slot (gapless from 0 in its shard): a uniform
    random order of all rows, dealt into shards whose counts are at most one apart.

    Law `rows`: each row counts one, whatever it holds, and groups have no part in it; nulls,
    empty texts, repeated rows and rows of one key are rows like others, and copies spread over
    all shards. An empty table gives no rows; with fewer rows than shards some shards are empty.
    Reruns agree as long as the input is partitioned alike, as files read under the same
    settings are; an input whose partitions change between two reads fails and must be written
    first. Columns named shard or slot come back with `_input` added.
    """
    door = Door(rows, MADE)
    spark = door.spark
    numbered = door.rows.withColumn("sh_partition", F.spark_partition_id())
    counts = {r.p: r.n for r in numbered.groupBy(F.col("sh_partition").alias("p")).agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    matrix = spark.sparkContext.broadcast(Communication([counts[p] for p in parts], shards, seed))
    at_of = spark.sparkContext.broadcast(np.array(parts, np.int64))
    ranges = 1
    while ranges * shards * range_rows < sum(counts.values()):
        ranges *= 2
    tasks = max(1, min(len(parts), spark.sparkContext.defaultParallelism * 4))
    # Runs of partitions together, so that a task draws few groups.
    per_task = spark.range(0, len(parts), 1, tasks).select(F.col("id").alias("k"))
    cells = per_task.mapInArrow(_counted(matrix, at_of, seed, ranges), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    firsts = cells.select((F.col("cell") / ranges).cast("int").alias("s"), (F.col("cell") % ranges).alias("r"), "n")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = firsts.select("s", "r", before.alias("sh_before"))

    labelled = numbered.mapInArrow(lean(_labelled(matrix, at_of, seed, door.own)), door.schema("sh_shard int, sh_key long"))
    labelled = labelled.withColumn("sh_range", F.shiftright("sh_key", KEY_BITS - ranges.bit_length() + 1))
    place = F.row_number().over(Window.partitionBy("sh_shard", "sh_range").orderBy("sh_key")) - 1
    ordered = labelled.withColumn("sh_place", place).join(firsts, (F.col("sh_shard") == F.col("s")) & (F.col("sh_range") == F.col("r")))
    return door.out(ordered, F.col("sh_shard").alias("shard"), (F.col("sh_before") + F.col("sh_place")).cast("long").alias("slot"))
