"""Files that arrive as a stream: each batch's unknown contents are extracted and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.extract import VERSION, extract
from sextant.functions import text
from sextant.operators import store
from sextant.session import shipped
from sextant.sources import git

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """path, data, blob, language of the files that appear below `folder`."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    head = F.decode(F.substring("content", 1, git.HEAD_BYTES), "ISO-8859-1")
    return files.select("path", F.col("content").alias("data"), text.blob_id(F.col("content")).alias("blob"), text.language_of("path", head).alias("language")).where("language is not null")


def kept(batch: DataFrame, root: str) -> int:
    """Append the facts of a batch's contents that `root` does not hold; how many there were."""
    spark = batch.sparkSession
    path = f"{root}/facts"
    have = spark.read.parquet(path).select("blob", "language").withColumn("extractor", F.lit(VERSION)) if store.exists(spark, path) else spark.createDataFrame([], "blob string, language string, extractor string")
    batch = batch.persist()
    try:
        new = batch.dropDuplicates(["blob", "language"]).join(store.unknown(batch, have, VERSION), ["blob", "language"])
        made = git.extracted(new, extract).persist()
        n = made.count()
        if n:
            made.write.mode("append").partitionBy("language").parquet(path)
        batch.select("path", "blob", "language").write.mode("append").parquet(f"{root}/arrivals")
        made.unpersist()
    finally:
        batch.unpersist()
    return n


def follow(spark: SparkSession, folder: str, root: str, checkpoint: str) -> StreamingQuery:
    """Keep the facts of what arrives below `folder` under `root`. A batch that is run again appends
    no content twice; the same bytes under another path are read once."""
    shipped(spark)
    return arriving(spark, folder).writeStream.foreachBatch(lambda batch, _: kept(batch, root) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
