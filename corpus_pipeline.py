"""A corpus pipeline of five stages, each an operator of `sextant.llm`.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all
but the last return the columns of `documents`, and those that stand beside them, whatever
their names. No rows give no rows. `docs` needs doc_id, text and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from sextant.llm import contamination, minhash, mixing, quality, sharding
from sextant.llm.common import outer, quoted, restored, written

#: A document goes where label 1 is less likely than this.
LEAST_SCORE = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: those of a score of LEAST_SCORE or more.

    Null and empty texts are scored like others, by statistics of zero; repeated rows have one
    score, and stay or go together. A score of just LEAST_SCORE stays; without labels all stay.
    """
    rows = quality.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return restored(rows.where(F.col("score") >= LEAST_SCORE), docs.columns, quality.MADE)


def one_of_each(docs: DataFrame, key: str) -> DataFrame:
    """One row of each `key`: the first in order of text and then of the other columns that have an order."""
    orderly = [f.name for f in docs.schema.fields if f.name != "text" and not isinstance(f.dataType, (MapType, VariantType))]
    whole = F.struct(*[quoted(c).alias(f"in_{i}") for i, c in enumerate(docs.columns)])
    order = F.struct("text", *[quoted(c).alias(f"by_{i}") for i, c in enumerate(orderly)])
    first = docs.groupBy(F.col(key).alias("group_key")).agg(F.min_by(whole, order).alias("first_row"))
    return first.select(*[F.col(f"first_row.in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at similarity 0.8 or more, the one of smallest doc_id.

    Documents without words link with nothing and all stay, by id. Rows that share a doc_id are
    one node of the groups, of which the first in order of text stays; of those without one, which
    are in no group, the first of each text. Rows are added up before they move, so neither a
    hot id nor a hot text meets in one task.
    """
    kept = minhash.near_duplicates(docs, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    named = one_of_each(docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*map(quoted, docs.columns)), "doc_id")
    return named.union(one_of_each(docs.where("doc_id is null"), "text"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark.

    Null and empty texts have none and stay; repeated rows stay or go together. Without a
    benchmark all stay.
    """
    rows = contamination.scanned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return restored(rows.where(F.size("bm_starts") == 0), docs.columns, contamination.MADE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents as often as the mix takes them, and cut to the words it
    takes, n_chars with them where there is such a column.

    A null source is a source; texts that are null or without words come as often as all of
    their source is taken. Repeated rows have a place each.
    """
    mix, _ = mixing.mixed_sources(docs)
    whole = mixing.copies(mix, outer(docs.columns, mixing.MADE)).toDF(*docs.columns)
    return whole.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else whole


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix in a uniform random order over 16 shards of equal counts: shard and
    slot beside the columns of documents. Rows count alike, whatever they hold, copies too."""
    return sharding.sharded(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: No SQL: the classifier is trained. The stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
