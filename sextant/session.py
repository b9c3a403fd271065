"""Session and the cutting of lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows and bytes of a batch sent to Python, in place of Spark's defaults: texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, "16m"


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors once an application, wherever the driver imported it
    from, and keep Arrow's batches small where the session leaves them at the default."""
    for name, usual, now in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", now)
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sextant-"), "sextant_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    out.write(whole, os.path.join("sextant", os.path.relpath(whole, top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(spark.sparkContext.applicationId)


def session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster use the session you have."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as `spark.checkpoint.dir` names it. A local session that
    names none gets one of its own; on a cluster such a folder would be spread over machines."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sextant-"))
    return context.getCheckpointDir().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once into the checkpoint folder all executors share; lineage ends there."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
