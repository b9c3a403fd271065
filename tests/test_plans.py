"""Registered queries against brute force over whole small tables."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sextant.operators import tiers
from sextant.plans import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, at = random.Random(5), tmp_path_factory.mktemp("tables")
    made = {
        "nation": ([(k,) for k in range(25)], "n_nationkey int"),
        "customer": ([(k, rng.randrange(25)) for k in range(40)], "c_custkey long, c_nationkey int"),
        "orders": ([(k, rng.randrange(40)) for k in range(1, 200)], "o_orderkey long, o_custkey long"),
        "part": ([(k,) for k in range(1, 61)], "p_partkey long"),
        "lineitem": ([(o, n, rng.randrange(1, 61)) for o in range(1, 8) for n in range(1, 8)] + [(9, n, k) for n, k in enumerate((50, 51, 1, 52, 53, 54, 55), 1)], "l_orderkey long, l_linenumber int, l_partkey long"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at), {name: rows for name, (rows, _) in made.items()}


def brute_shares(tables, jump):
    nation_of = dict(tables["customer"])
    counts = Counter((nation_of[c], o % 25) for o, c in tables["orders"] if nation_of[c] != o % 25)
    weight = {e: math.sqrt(n) for e, n in counts.items()}
    out = Counter()
    for (src, _), w in weight.items():
        out[src] += w
    share = dict(jump)
    for _ in range(6):
        came = Counter()
        for (src, dst), w in weight.items():
            came[dst] += 0.85 * w / max(out[src], 1.0) * share[src]
        share = {k: came[k] + (1 - sum(came.values())) * j for k, j in jump.items()}
    return share


def test_pagerank_reads_all_orders(spark, tables):
    at, rows = tables
    for query, jump in ((queries.pagerank_uniform, {k: 1 / 25 for k in range(25)}), (queries.pagerank_focus, {k: 0.5 * (k in (3, 7)) for k in range(25)})):
        assert {r.id: r.share for r in query(spark, at).collect()} == pytest.approx(brute_shares(rows, jump), abs=2e-6)


def test_impact_follows_all_lines_of_an_order(spark, tables):
    at, rows = tables
    part_of = {(o, n): p for o, n, p in rows["lineitem"]}
    level, front = {1: 0}, {1}
    for k in (1, 2, 3):
        front = {part_of[o, n + 1] for (o, n), p in part_of.items() if p in front and (o, n + 1) in part_of} - set(level)
        level |= dict.fromkeys(front, k)
    assert level.keys() >= {1, 52, 53, 54}
    assert {r.id: r.level for r in queries.impact_levels(spark, at).collect()} == level


def test_lists_of_targets_are_written_once_a_scope_and_dealt_evenly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tiers, "TASK_BYTES", 20_000, raising=False)
    nation_of = {c: 0 if c % 5 else 1 + c % 3 for c in range(400)}
    nation_of_supplier = {s: 0 if s % 3 else 2 for s in range(90)} | {90: 3}
    for name, rows, schema in (
        ("nation", [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3)], "n_nationkey int, n_regionkey int"),
        ("customer", [*nation_of.items(), (400, 4), (401, 9)], "c_custkey long, c_nationkey int"),
        ("supplier", list(nation_of_supplier.items()), "s_suppkey long, s_nationkey int"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    by_nation = {k: [s for s, n in nation_of_supplier.items() if n == k] for k in (0, 2, 3)} | {1: [s for s, n in nation_of_supplier.items() if n == 0]}
    rule = {0: "", 1: "", 2: "", 3: "module"}
    want = {c: ("resolved" if len(by_nation[k]) == 1 else "ambiguous", rule[k], len(by_nation[k]), ",".join(map(str, by_nation[k]))) for c, k in nation_of.items()} | {400: ("external", "", 0, "")}
    found = queries.resolve_tiers(spark, str(tmp_path))
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert {r.c_custkey: (r.status, r.rule, r.n, r.targets) for r in rows} == want and len(rows) == len(want)
    made = Counter()
    for r in rows:
        made[r.task] += len(r.targets)
    assert max(made.values()) < 22_000 < sum(made.values())
    assert "array_join" not in found._jdf.queryExecution().optimizedPlan().toString()
