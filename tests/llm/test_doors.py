"""What holds for every operator: columns of any name, first calls in a fresh session, queries and their SQL."""

from __future__ import annotations

import os
import random
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm import common, contamination, html, lines, mixing, quality, queries, sharding, sql, substrings
from tests.llm.test_operators import prose

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"
#: Names that an operator might use inside, and names of what operators make.
NAMES = ["a", "b", "c", "s", "t1", "row", "range", "place", "low", "gone", "gone_id", "copied", "starts", "bm_extra", "rounds", "ahead", "n_blocks", "before", "in_0", "in_1", "host", "a.b", "qual_text", "node"]
MADE = ["score", "Held_Out", "bm_starts", "line_kept", "sub_spans", "mix_taken", "main_text", "shard", "slot"]


def table(spark, texts, extra):
    """Texts with columns of clashing names, of several types."""
    rng = random.Random(1)
    df = spark.createDataFrame([(i, t, rng.choice(["x", "y", None])) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for k, name in enumerate(extra):
        kind = [F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")), F.col("doc_id") * 10 + k, F.array("doc_id", F.lit(k)), F.create_map(F.lit("k"), F.col("doc_id"))][k % 4]
        df = df.withColumn(name, kind)
    path = f"{common.shared_dir(spark)}/clash-{len(extra)}-{random.random()}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def texts():
    rng = random.Random(2)
    shared = prose(rng, 45, 60)
    out = [f"{prose(rng, rng.randrange(60))} {shared if i % 3 == 0 else ''}\nthe line that all have" for i in range(24)]
    return [*out, None, "", prose(rng, 4000)]


def scored(spark, df):
    return quality.scored(df, spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int"))


def scanned(size):
    return lambda spark, df: contamination.scanned(df, spark.createDataFrame([(i, t) for i, t in enumerate(texts()) if t and i % 5 == 0], "item_id long, text string"), pattern_bytes=size)


OPERATORS = {
    "quality": (scored, quality.MADE), "one pass": (scanned(1 << 30), contamination.MADE), "several passes": (scanned(9000), contamination.MADE), "lines": (lambda spark, df: lines.without_boilerplate(df), ("line_n", "line_dropped", "line_kept")),
    "substrings": (lambda spark, df: substrings.without_repeats(df), ("sub_n_words", "sub_spans", "sub_kept")), "mixing": (lambda spark, df: mixing.mixed_sources(df)[0], mixing.MADE),
    "sharding": (lambda spark, df: sharding.sharded(df), sharding.MADE),
    "html": (lambda spark, df: html.extracted(df.withColumns({"url": F.lit("http://h.example/"), "html": F.concat(F.lit("<p>"), "text")})), ("main_text",)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name_come_back(spark, name):
    run, made = OPERATORS[name]
    df = table(spark, texts(), NAMES + MADE)
    out = run(spark, df)
    names = [c for c in out.columns if c not in made]
    assert names[: len(df.columns)] == [f"{c}_input" if c.lower() in made else c for c in df.columns]
    want = {r.doc_id: r for r in df.collect()}
    got = common.restored(out, [*df.columns], made).collect()
    assert len(got) == len(want) and all(r == want[r.doc_id] for r in got)
    # What is made is what the bare table gives.
    bare = run(spark, df.select("doc_id", "text", "source")).select("doc_id", *made).collect() if name != "sharding" else []
    of = {r.doc_id: r for r in bare}
    assert all(r == of[r.doc_id] for r in out.select("doc_id", *made).collect() if bare)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "none has these words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = table(spark, texts(), NAMES + MADE)
    want = {r.doc_id: r for r in df.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        rows = out.collect()
        assert rows and all(r[c] == want[r.doc_id][c] for r in rows for c in NAMES + MADE)
    last = corpus_pipeline.shard(spark, df, str(tmp_path))
    assert sorted(last.columns) == sorted([c + "_input" if c in ("shard", "slot") else c for c in df.columns] + ["shard", "slot"])


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = table(spark, texts(), []).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, str(tmp_path)).count() == 0


def test_no_folder_is_left_to_a_machine(spark):
    class Elsewhere:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    from sextant.session import shared_folder

    Elsewhere.conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Elsewhere)


FIRST = """
import sys
from pyspark.sql import SparkSession
sys.path.append({root!r})
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + {folder!r}).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__
for name in {names!r}:
    from sextant import session
    if name != {names!r}[0]:
        spark.stop()
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + {folder!r}).getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
    print(name, __spark_entry__.queries()[name](spark, {data!r}).count())
"""


def test_each_query_may_be_the_first_of_a_session(tmp_path):
    """Workers find the package although neither their folder nor PYTHONPATH has it."""
    names = [*queries.QUERIES, "pipeline"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", FIRST.format(root=ROOT, names=names, folder=str(tmp_path / "shared"), data=SMALL)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.split("\n") if line] == names


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sql.SQL)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(sql.SQL[name])
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    key = lambda rows: sorted((tuple(map(rounded, r)) for r in rows), key=str)
    assert key([r[c] for c in columns] for r in df.collect()) == key([r[i] for i in at] for r in want.fetchall())


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_give_a_row_for_each_of_theirs(spark, name):
    of = {"op1_embedding_dedup": ("embeddings", "vec_id"), "op5_html_extraction": ("pages", "page_id"), "op7_warc": ("pages", "page_id")}
    source, key = of.get(name, ("documents", "doc_id"))
    want = sorted(r[0] for r in spark.read.parquet(f"{SMALL}/{source}.parquet").select(key).collect())
    assert sorted(r[0] for r in queries.QUERIES[name](spark, SMALL).select(key).collect()) == want
