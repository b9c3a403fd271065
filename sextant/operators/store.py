"""The catalog: contents known by git blob, incremental checks, digests and what is kept."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Nanoseconds in which a change may hide behind an equal stat, and that released contents stay.
RACY_NS = 2_000_000_000
KEPT_NS = 7 * 24 * 3600 * 1_000_000_000


def stale(listed: DataFrame, known: DataFrame, extractor: str) -> DataFrame:
    """`listed` (path, size, mtime, ctime, inode) with `why`: new, changed, racy, extractor, or null where
    the record in `known` (also seen, extractor, content) still holds."""
    same = [F.col(f"l.{c}") == F.col(f"k.{c}") for c in ("size", "mtime", "ctime", "inode")]
    equal = same[0] & same[1] & same[2] & same[3]
    joined = listed.alias("l").join(known.alias("k"), "path", "left")
    why = (
        F.when(F.col("k.content").isNull(), "new").when(~equal, "changed").when(F.col("k.extractor") != extractor, "extractor").when(F.col("l.mtime") >= F.col("k.seen") - RACY_NS, "racy")
    )
    return joined.select("path", "l.size", "l.mtime", "l.ctime", "l.inode", F.col("k.content").alias("content"), why.alias("why"))


def gone(listed: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(listed.select("path"), "path", "left_anti")


def unknown(blobs: DataFrame, contents: DataFrame, extractor: str) -> DataFrame:
    """Distinct (blob, language) that no content of this extractor holds: what must be extracted."""
    have = contents.where(F.col("extractor") == extractor).select("blob", "language")
    return blobs.select("blob", "language").distinct().join(have, ["blob", "language"], "left_anti")


def compared(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key and status (added, gone, changed, same) between two listings of (key, digest)."""
    joined = old.select(key, F.col(digest).alias("was"), F.lit(True).alias("had")).join(new.select(key, F.col(digest).alias("is"), F.lit(True).alias("has")), key, "full_outer")
    status = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "gone").when(~F.col("was").eqNullSafe(F.col("is")), "changed").otherwise("same")
    return joined.select(key, status.alias("status"))


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`new` over `old`: one row a key, those of `new` where both have it."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def digest(files: DataFrame, group: list[str], path: str, blob: str) -> DataFrame:
    """Digest of each group's files in order of path: SHA-1 of `path`, a zero byte, `blob`, a line end for each."""
    entry = F.struct(F.col(path).alias("p"), F.concat(F.col(path).cast("string"), F.lit("\0"), F.col(blob), F.lit("\n")).alias("e"))
    return files.groupBy(*group).agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]), "").cast("binary")).alias("digest"))


def pruned(contents: DataFrame, files: DataFrame, now: int) -> DataFrame:
    """Contents that stay: those a file holds, and those released within a week."""
    used = files.select(F.col("content").alias("id")).distinct()
    held = contents.join(used, "id", "left_semi")
    free = contents.join(used, "id", "left_anti").where(F.col("released").isNull() | (F.col("released") > now - KEPT_NS))
    return held.unionByName(free)


def counters(checked: DataFrame, extracted: int, lost: int) -> dict[str, int]:
    """What a check did: files listed, hashed again, extracted and gone."""
    row = checked.agg(F.count("*").alias("listed"), F.count("why").alias("hashed")).first()
    return {"listed": row.listed, "hashed": row.hashed, "extracted": extracted, "gone": lost}


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def kept_view(spark: SparkSession, root: str, name: str, key: str, make) -> DataFrame:
    """A view kept as Parquet under its key: read where it is, made and written where it is not."""
    path = f"{root}/{name}/{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
        tidied(spark, f"{root}/{name}", key, time.time_ns())
    marked(spark, f"{path}/_SUCCESS", time.time_ns())
    return spark.read.parquet(path)


def marked(spark: SparkSession, path: str, now: int) -> None:
    """Mark a file as used now, by its time of modification."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(hadoop, now // 1_000_000, -1)


def tidied(spark: SparkSession, folder: str, key: str, now: int) -> list[str]:
    """Remove whole views of other keys that nothing has written or read for a week; their keys, sorted."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system, out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for entry in system.listStatus(hadoop):
        other = entry.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if other != key and system.exists(done) and system.getFileStatus(done).getModificationTime() < (now - KEPT_NS) // 1_000_000:
            system.delete(entry.getPath(), True)
            out.append(other)
    return sorted(out)


def held_by(rows: DataFrame, blob: Column, order: Column) -> DataFrame:
    """One row a blob: its first holder and how many hold it."""
    return rows.groupBy(blob.alias("blob")).agg(F.min(order).alias("first"), F.count("*").alias("holders"))
