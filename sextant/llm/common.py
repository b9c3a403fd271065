"""Helpers shared by the operators: written tables, hashing of words, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from sextant.session import shared_folder, shipped

#: Java and Python pattern of a word: anything but the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
MASK = (1 << 64) - 1


_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below the one all executors share. It goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_folder(spark)}/sextant-{app}-{uuid.uuid4().hex[:8]}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS[app])
        files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(hadoop)
        files.deleteOnExit(hadoop)
    return _FOLDERS[app]


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: lineage ends there, and the
    files outlive any executor. Returns the table and its path, for `removed`."""
    shipped(df.sparkSession)
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Door:
    """The columns of a table under names of our own, in_0, in_1, ..., while an operator works
    on it, so that no name it uses inside can meet one of the user's. At the way out they have
    their names again, beside the columns `made`; one that has the name of a column made, in
    any case, comes out with `_input` added. Ships the package before any Python function is made."""

    def __init__(self, df: DataFrame, made: tuple[str, ...]):
        shipped(df.sparkSession)
        self.spark, self.names, self.made = df.sparkSession, df.columns, made
        self.own = [f"in_{i}" for i in range(len(self.names))]
        self.rows = df.select(*[quoted(c).alias(i) for c, i in zip(self.names, self.own, strict=True)])

    def of(self, name: str) -> str:
        """What a column is called inside."""
        return self.own[[c.lower() for c in self.names].index(name.lower())]

    def string(self, name: str, other: str) -> str:
        """What a column is called inside as a string: of another type, it is cast beside itself as `other`."""
        if self.rows.schema[self.of(name)].dataType == StringType():
            return self.of(name)
        self.rows = self.rows.withColumn(other, F.col(self.of(name)).cast("string"))
        return other

    def schema(self, ddl: str) -> StructType:
        """The columns inside and those that `ddl` adds."""
        return StructType([*self.rows.schema.fields[: len(self.own)], *StructType.fromDDL(ddl).fields])

    def out(self, df: DataFrame, *made: Column) -> DataFrame:
        return df.select(*[F.col(i).alias(c) for i, c in zip(self.own, outer(self.names, self.made), strict=True)], *made)


def outer(names: list[str], made: tuple[str, ...]) -> list[str]:
    """What a user's columns are called beside the columns that an operator made."""
    taken, out = {c.lower() for c in made}, []
    for c in names:
        while c.lower() in taken:
            c += "_input"
        taken.add(c.lower())
        out.append(c)
    return out


def restored(df: DataFrame, names: list[str], made: tuple[str, ...]) -> DataFrame:
    """The user's columns alone, under their own names, of what an operator that makes `made` gave."""
    return df.select(*[quoted(o).alias(c) for o, c in zip(outer(names, made), names, strict=True)])


def slices(part: pa.RecordBatch, column: str, rows: int = 512, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `rows` rows and, if they are more than one, `most` bytes of a text column."""
    sizes = np.array(pc.fill_null(pc.binary_length(part.column(column)), 0), dtype=np.int64)
    at = 0
    while at < part.num_rows:
        n = int(np.searchsorted(np.cumsum(sizes[at : at + rows]), most, side="right"))
        n = min(max(1, n), rows, part.num_rows - at)
        yield part.slice(at, n)
        at += n


def empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash; forgets all when it holds too many words."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


#: A-Z to a-z in UTF-8 bytes; other characters stay.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    steps = (np.arange(1, n + 1, dtype=np.uint64) + U64(seed * 1_000_003 & MASK)) * U64(0x9E3779B97F4A7C15)
    return mixed(steps) | U64(1)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 of each text, without decoding it."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def lean(run):
    """A function over batches that gives its worker's freed memory back to the system at the end
    of each task: workers live on beside the executor, within the same limit."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def with_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component (its smallest node reachable) of every node of `edges` (a, b long).

    Contraction: each round every node points at the smallest of itself and its
    neighbours, the pointers are followed twice, edges are drawn between what the nodes
    point at, and the loops among them go. A round at least removes all nodes but the
    local minima of each neighbourhood, so few rounds are left to do; each is written
    to the shared folder. Rows: O(edges) in each round, and no group is gathered.
    """
    spark = edges.sparkSession
    now, path = written(
        edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label
    )
    trail = [path]
    labels: DataFrame | None = None
    while not empty(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        points, path = written(points, label)
        trail.append(path)
        for _ in range(2):
            on = points.select(F.col("node").alias("to"), F.col("to").alias("further"))
            points = points.join(on, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        points, path = written(points, label)
        trail.append(path)
        ends = now
        for end in ("a", "b"):
            ends = ends.join(points.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end)
        now, path = written(
            ends.where("a_to != b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), label
        )
        trail.append(path)
        if labels is None:
            labels = points.select("node", F.col("to").alias("component"))
        else:
            on = points.select(F.col("node").alias("component"), "to")
            labels = labels.join(on, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels, path = written(labels, label)
        trail.append(path)
    if labels is None:
        labels = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        trail.remove(path)
    removed(spark, *[p for p in trail if p != path])
    return labels
