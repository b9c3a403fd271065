"""Quality classifier: ridge on random Fourier features of document statistics, calibrated.

A pass over the texts gives each document 23 statistics. Random cosines of the
scaled statistics approximate a Gaussian kernel; each partition sums its normal equations,
the sums are added up and solved once. Scores of the labelled rows are counted in fixed bins,
isotonic regression of the bins gives what share of label 1 a score stands for, and scores
between bins are interpolated. At most FIT_ROWS labels, those of least hash, are learned from,
so the texts are measured once to be scored, and only those of these labels once more before.
What reaches the driver are sums whose size depends on the number of features alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import Door, as_bytes, lean, removed, slices, written

FEATURES = 192
RIDGE = 1e-4
BINS = 512
#: Labels that are learned from at most. Their ids are what is broadcast.
FIT_ROWS = 50_000
#: Symbols counted one by one, as a share of words.
MARKS = b"!|%#$&*.,?;:-_=<>{}[]()/\\@~^+\"'"
#: Symbols of MARKS that have a statistic of their own; the others share one.
ALONE = b"!|%#$&*.,"
STATISTICS = 13 + len(ALONE) + 1


def statistics(text: bytes | None) -> list[float]:
    """Statistics of one whole text; of none or an empty one, zeros."""
    if not text:
        return [0.0] * STATISTICS
    words = text.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    digits = int(counts[48:58].sum())
    beyond = int(counts[128:].sum())
    share = counts[counts > 0] / size
    per = 1 / max(1, n)
    seen = Counter(words)
    top = max(seen.values(), default=0)
    lines = text.split(b"\n")
    marks = [int(counts[m]) * per for m in ALONE]
    rest = sum(int(counts[m]) for m in MARKS if m not in ALONE) * per
    return [
        math.log1p(n), math.log1p(size), (size - n) * per, len(seen) * per, top * per, sum(map(eq, words, words[1:])) * per,
        upper / max(1, upper + lower), digits / size, beyond / size, float(-(share * np.log2(share)).sum()),
        math.log1p(len(lines)), len(set(lines)) / len(lines), sum(len(w) <= 3 for w in seen) / max(1, len(seen)), *[math.log1p(m) for m in marks], math.log1p(rest),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in slices(whole, "text", 1024, 4 << 20):
            made = pa.array([statistics(t) for t in as_bytes(part.column("text"))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), made], names=[*(c for c in part.schema.names if c != "text"), "x"])


class Model:
    """mean and scale of the statistics, directions and phases of the cosines, weights, and the calibration's knots."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        # Half the directions see wide and half see fine differences.
        width = np.where(np.arange(features) % 2 == 0, 1.0, 3.0) * math.sqrt(len(mean)) / 2
        self.directions = draw.normal(size=(len(mean), features)) / width
        self.phases = draw.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        out = np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([out, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.mapped(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    return part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, STATISTICS)


def _normal(model: Model):
    """(x, y) to one row a partition: the sums of its normal equations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(model.phases) + 1
        total = np.zeros((d, d + 1))
        for part in batches:
            for at in range(0, part.num_rows, 4096):
                some = part.slice(at, 4096)
                z = model.mapped(_matrix(some))
                total += z.T @ np.hstack([z, some.column("y").to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for part in batches:
        for sums in part.column("sums"):
            one = np.frombuffer(sums.as_buffer(), np.float64)
            total = one.copy() if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _binned(model: Model, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, bins))
        for part in batches:
            if part.num_rows:
                raw, y = model.raw(_matrix(part)), part.column("y").to_numpy()
                of = np.minimum((raw + 0.5) / 2 * bins, bins - 1).astype(np.int64)
                for k, weight in enumerate((np.ones(len(y)), y, raw)):
                    counts[k] += np.bincount(of, weight, bins)
        full = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(full), *(pa.array(c[full]) for c in counts)], names=["bin", "n", "y", "raw"])

    return run


def isotonic(n: np.ndarray, y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order: mean raw score and share of label 1 of each pool (half a count of both labels added)."""
    pools: list[list[float]] = []
    for one in zip(n, y, raw, strict=True):
        pools.append([float(v) for v in one])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    of = np.array(pools)
    return of[:, 2] / of[:, 0], (of[:, 1] + 0.5) / (of[:, 0] + 1)


def fitted(measured: DataFrame, features: int = FEATURES, ridge: float = RIDGE, bins: int = BINS, seed: int = 2) -> Model:
    """A model of rows (x, y); y is 0.0 or 1.0. Without rows of both labels, every score is the share of label 1, or 0.5."""
    spark = measured.sparkSession
    sums = measured.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).collect()
    mean, scale = np.zeros(STATISTICS), np.ones(STATISTICS)
    for r in sums:
        # A statistic that is the same everywhere may differ by rounding.
        mean[r.k], scale[r.k] = r["mean"], r.sd if r.sd > 1e-9 * (1 + abs(r["mean"])) else 1.0
    model = Model(mean, scale, features, seed)
    parts = measured.select("x", "y").mapInArrow(_normal(model), "sums binary")
    # Added up in two steps, so the driver gets a few sums however many partitions there are.
    groups = max(1, min(16, spark.sparkContext.defaultParallelism))
    total = None
    for r in parts.repartition(groups).mapInArrow(_added, "sums binary").collect():
        one = np.frombuffer(r.sums, np.float64).reshape(features + 1, features + 2)
        total = one if total is None else total + one
    n = total[-1, features] if total is not None else 0
    share = total[-1, -1] / n if n else 0.5
    if n and 0 < share < 1:
        left = total[:, :-1] + np.diag([ridge * n] * features + [0.0])
        model.weights = np.linalg.solve(left, total[:, -1])
        rows = measured.select("x", "y").mapInArrow(_binned(model, bins), "bin long, n double, y double, raw double").groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "y", "raw")]).orderBy("bin").collect()
        model.knots = isotonic(*(np.array([r[c] for r in rows]) for c in ("n", "y", "raw")))
    else:
        model.knots = (np.array([0.0]), np.array([float(share)]))
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


MADE = ("score", "held_out")


def scored(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **settings) -> DataFrame:
    """`documents` (doc_id long, text string; other columns stay) with held_out and score, the
    likelihood of `labels.quality` 1 by the whole text alone.

    Labels (doc_id, quality 0 or 1; a null label or id is left out) are learned from where
    `held_out` is false, `fit_rows` of them at most; labels that repeat count as often as they
    do, and so do documents that share an id; those of no document do not count. Null and empty
    texts have statistics of zero and are scored like others. Repeated rows get the same score.
    No documents give no rows; no labels give 0.5. Columns named score or held_out come back
    with `_input` added.
    """
    door = Door(documents, MADE)
    ids, text = F.col(door.of("doc_id")), door.string("text", "qual_text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("y in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(fit_rows)
    # The labels are at most `fit_rows` pairs of numbers; texts stay where they are.
    some = door.rows.select(ids.cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    measured, path = written(some.select("y", "text").mapInArrow(lean(_measured), "y double, x array<double>"), "statistics")
    model = fitted(measured, **settings)
    removed(door.spark, path)
    own = door.own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text, 1024, 4 << 20):
                x = np.array([statistics(t) for t in as_bytes(part.column(text))]).reshape(part.num_rows, STATISTICS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(model.score(x))], names=[*own, "qual_score"])

    rows = door.rows.mapInArrow(lean(run), door.schema("qual_score double"))
    return door.out(rows, F.col("qual_score").alias("score"), held_out(ids).alias("held_out"))


def digested(rows: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of the rows of `scored`."""
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))
