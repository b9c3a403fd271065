from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from sextant.operators import graph, history, intervals, render, search, store, tiers


def test_tiers_keep_ambiguity_and_stop_outside(spark):
    sites = spark.createDataFrame([(i,) for i in range(5)], "s int")
    one = spark.createDataFrame([(0, 10), (1, 11), (1, 12), (3, None)], "s int, t int")
    two = spark.createDataFrame([(0, 99), (2, 20), (3, 30)], "s int, t int")
    got = {r.s: (r.status, r.rule, r.targets) for r in tiers.first_tier(sites, [("near", one), ("far", two)], ["s"], "t").collect()}
    assert got == {0: ("resolved", "near", [10]), 1: ("ambiguous", None, [11, 12]), 2: ("resolved", "far", [20]), 3: ("external", None, []), 4: ("external", None, [])}


def test_intervals_against_brute_force(spark):
    rng = random.Random(1)
    spans = [(f, i, a := rng.randrange(400), a + rng.randrange(200)) for f in range(2) for i in range(30)]
    points = [(rng.randrange(2), k, rng.randrange(600)) for k in range(80)]
    s = spark.createDataFrame(spans, "f int, id int, start int, end int")
    p = spark.createDataFrame(points, "f int, k int, at int")
    got = {r.k: r.id for r in intervals.innermost(p, s, ["f"], "at", ["f", "k"], "id").collect()}
    for f, k, at in points:
        held = [(a, -b, -i) for g, i, a, b in spans if g == f and a <= at <= b]
        assert got[k] == (-max(held)[2] if held else None)
    hunks = [(rng.randrange(2), k, rng.randrange(600), rng.choice([0, 1, 5, 90])) for k in range(60)]
    h = spark.createDataFrame(hunks, "f int, k int, at int, n int")
    shared = {(r.k, r.id): r.lines for r in intervals.overlapping(h, s, ["f"], "at", "n").collect()}
    want = {(k, i): n for f, k, at, c in hunks for g, i, a, b in spans if g == f and (n := min(at + c - 1, b) - max(at, a) + 1) > 0 and c}
    assert shared == want


def test_nesting_and_extents(spark):
    rows = [("f", 1, 1, 20), ("f", 2, 2, 9), ("f", 3, 3, 4), ("f", 4, 10, 12), ("f", 5, 10, 12)]
    got = {r.id: r.depth for r in intervals.depths(spark.createDataFrame(rows, "p string, id int, start int, end int"), ["p"], "id").collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 1, 5: 2}
    heads = spark.createDataFrame([("f", 1, 1, 30), ("f", 5, 2, 30), ("f", 9, 3, 30), ("f", 12, 2, 30), ("f", 20, 1, 30)], "p string, at int, level int, last int")
    assert {r.at: r.until for r in intervals.extents(heads, ["p"], "at", "level", "last").collect()} == {1: 19, 5: 11, 9: 11, 12: 19, 20: 30}
    paths = spark.createDataFrame([("a/b/c.rs",), ("a/x.rs",), ("z.rs",)], "path string")
    roots = spark.createDataFrame([("a",), ("a/b",)], "root string")
    assert {r.path: r.root for r in intervals.nearest_prefix(paths, roots, "path", "root").collect()} == {"a/b/c.rs": "a/b", "a/x.rs": "a", "z.rs": None}


def brute_rank(n, edges, jump, steps=100):
    w = {k: v**0.5 if v > 1 else v for k, v in edges.items() if k[0] != k[1]}
    out = [max(1.0, sum(v for (a, _), v in w.items() if a == u)) for u in range(n)]
    share = list(jump)
    for _ in range(steps):
        now = [0.0] * n
        for (a, b), v in w.items():
            now[b] += 0.85 * share[a] / out[a] * v
        rest = 1 - sum(now)
        now = [x + rest * j for x, j in zip(now, jump, strict=True)]
        moved = sum(abs(x - y) for x, y in zip(now, share, strict=True))
        share = now
        if moved < 1e-6:
            break
    return share


def test_pagerank(spark):
    edges = {(0, 1): 4.0, (1, 2): 1.0, (2, 0): 0.1, (3, 3): 5.0, (0, 2): 2.0}
    nodes = spark.range(5).select(F.col("id").cast("int").alias("id"))
    e = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src int, dst int, w double")
    got = {r.id: r.share for r in graph.pagerank(nodes, e).collect()}
    want = brute_rank(5, edges, [0.2] * 5)
    assert abs(sum(got.values()) - 1) < 1e-9 and all(abs(got[i] - want[i]) < 1e-6 for i in range(5))
    focus = spark.createDataFrame([(0, 1.0)], "id int, weight double")
    got = {r.id: r.share for r in graph.pagerank(nodes, e, focus).collect()}
    want = brute_rank(5, edges, [1.0, 0, 0, 0, 0])
    assert all(abs(got[i] - want[i]) < 1e-6 for i in range(5)) and got[4] == 0


def test_levels_and_closure(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (5, 6)], "src int, dst int")
    start = spark.createDataFrame([(0,)], "id int")
    assert {r.id: r.level for r in graph.levels(e, start, 9).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    assert {r.id for r in graph.levels(e, start, 1).collect()} == {0, 1}
    assert {(r.src, r.dst) for r in graph.closure(e).collect()} == {(a, b) for a in (0, 1, 2) for b in (0, 1, 2, 3) if a != b} | {(5, 6)}
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "name string, to string")
    assert {r.name: r.to for r in graph.followed(aliases).collect()} == {"a": "c", "b": "c", "x": "y"}
    assert graph.linearized({"D": ["B", "C"], "B": ["A"], "C": ["A"]}, "D") == ["D", "B", "C", "A"]
    assert graph.linearized({"X": ["A", "B"], "Y": ["B", "A"], "Z": ["X", "Y"]}, "Z")[0] == "Z"


def test_search_ranks_and_gates(spark):
    docs = spark.createDataFrame([(0, "load", "loads a store from disk"), (1, "save", "saves a store"), (2, "test_load", "checks load"), (3, "other", "nothing at all")], "id int, name string, doc string")
    fields = {"name": search.NAMED, "doc": 1.0}
    got = search.search(docs, "load the store", fields, ["id"], test=F.col("name").startswith("test_"))
    assert got.answers and [r.id for r in got.ranked.collect()][0] == 0
    gated = search.search(docs, "frobnicate quux store", fields, ["id"])
    assert not gated.answers and gated.best_holds == ["store"] and set(gated.absent) == {"frobnicate", "quux"} and gated.holding == 2
    assert search.search(docs, " :: ", fields, ["id"]).ranked.count() == 0
    assert search.search(docs.limit(0), "load", fields, ["id"]).ranked.count() == 0


def test_budget_cut(spark):
    lines = spark.createDataFrame([(i, 10 * (i % 3), 20 + i) for i in range(12)], "ord int, rank int, size int")
    kept = {r.ord for r in render.budget_cut(lines, 30).collect()}
    used, want = 0, set()
    for i in sorted(range(12), key=lambda k: (-(10 * (k % 3)), k)):
        if used + 21 + i > 120:
            break
        used += 21 + i
        want.add(i)
    assert kept == want
    rows = [{"text": f"line {i}", "rank": 100 - i, "part": "lines", "heads": 0} for i in range(50)]
    out, cut = render.rendered(rows, "head", 40)
    assert out[1:-1] == [r["text"] for r in rows][: len(out) - 2] and cut["left_out"] == {"lines": 50 - len(out) + 2} and len("\n".join(out).encode()) <= 160
    assert render.rendered(rows, "head", 4000)[1] is None


def test_store(spark):
    listed = spark.createDataFrame([("a", 1, 10, 1, 1), ("b", 2, 10, 1, 2), ("c", 1, 99_999_999_999, 1, 3), ("d", 1, 1, 1, 4)], "path string, size long, mtime long, ctime long, inode long")
    known = spark.createDataFrame([("a", 1, 10, 1, 1, "x", "1", 50_000_000_000), ("b", 1, 10, 1, 2, "y", "1", 50_000_000_000), ("c", 1, 99_999_999_999, 1, 3, "z", "1", 100_000_000_000), ("e", 1, 1, 1, 9, "w", "1", 5)], "path string, size long, mtime long, ctime long, inode long, content string, extractor string, seen long")
    assert {r.path: r.why for r in store.stale(listed, known, "1").collect()} == {"a": None, "b": "changed", "c": "racy", "d": "new"}
    assert {r.path for r in store.gone(listed, known).collect()} == {"e"}
    assert {r.path: r.why for r in store.stale(listed, known, "2").collect()}["a"] == "extractor"


def test_history(spark):
    hunks = spark.createDataFrame([("r1", "f", 5, 2, 5, 3), ("r1", "f", 30, 1, 31, 0)], "rev string, path string, old_start int, old_count int, new_start int, new_count int")
    spans = spark.createDataFrame([("r1", "f", "a", "function", 1, 6), ("r1", "f", "b", "function", 28, 40)], "rev string, path string, qualified string, kind string, start int, end int")
    got = {r.qualified: (r.added, r.removed) for r in history.touches(hunks, spans, spans).collect()}
    assert got == {"a": (2, 2), "b": (0, 1)}
    commits = spark.createDataFrame([(f"r{k}", k) for k in range(6)], "rev string, place long")
    changes = spark.createDataFrame([("r2", "new", "old"), ("r4", "old", "older")], "rev string, path string, renamed string")
    touched = spark.createDataFrame([("r0", "new", "q", 1, 0), ("r3", "old", "q", 1, 1), ("r5", "older", "q", 2, 0), ("r1", "old", "q", 9, 9)], "rev string, path string, qualified string, added int, removed int")
    wanted = spark.createDataFrame([("new", "q")], "path string, qualified string")
    assert [r.rev for r in history.touching(commits, touched, changes, wanted).collect()] == ["r0", "r3", "r5"]
    lines = spark.createDataFrame([("r1", "Task", "7, 17"), ("r2", "task", "177"), ("r3", "Other", "17")], "rev string, key string, value string")
    assert [r.rev for r in history.of_task(lines, "TASK", "17").collect()] == ["r1"]


def test_tasks_meet_commits_by_short_ids_of_any_length(spark):
    shas = {k: f"{k % 3:x}{k:039x}" for k in range(12)}
    commits = spark.createDataFrame([(k, sha, 20 - k // 2) for k, sha in shas.items()], "rev int, sha string, place int")
    lines = [(k, "Task" if k % 4 else "TASK", f" a, t{k % 3}\tb ") for k in shas] + [(1, "Other", "z")]
    board = {"a": [shas[1][:1], shas[4], shas[4][:7], None, shas[5] + "0"], "b": [""], "t2": [shas[2][:40], "2"], "t1": [shas[2]], "z": [""], "none": []}
    tasks = spark.createDataFrame([(k, v, k.upper()) for k, v in board.items()], "id string, commits array<string>, title string")
    want = {}
    for rev, key, value in lines:
        for id in value.replace(",", " ").split():
            if key.lower() == "task" and any(c is not None and shas[rev].startswith(c) for c in board.get(id, [])):
                want.setdefault(id, set()).add(rev)
    rows = sorted((min(20 - k // 2 for k in revs), id, len(revs), id.upper()) for id, revs in want.items())
    trailers = spark.createDataFrame(lines, "rev int, key string, value string")
    got = history.tasks_of(commits, trailers, tasks)
    assert [(r["first"], r.id, r.n, r.title) for r in got.collect()] == rows and len({r[0] for r in rows}) < len(rows) == 3
    assert "exists(" not in got._jdf.queryExecution().optimizedPlan().toString(), "a commit meets its short ids by equality, not a task's whole list"


def test_renames_are_followed_without_broadcasts(spark, monkeypatch):
    rng, plans = random.Random(3), []

    def settled(df, of=history.settled):
        out = of(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(history, "settled", settled)
    changes = [(place, f"p{rng.randrange(7)}", rng.choice([None, f"p{rng.randrange(7)}"])) for place in rng.choices(range(40), k=50)] + [(3, None, "p1"), (3, "p1", "p2"), (3, "p1", "p4")]
    starts = [f"p{k}" for k in range(9)] + ["p1", None]
    want = []
    for start in set(starts):
        path, at = start, -1
        while True:
            after = min(((place, to) for place, p, to in changes if p == path and to is not None and place > at and path is not None), default=(None, None))
            want.append((start, path, at, after[0]))
            if after[0] is None:
                break
            at, path = after
    got = history.followed(spark.createDataFrame(changes, "place long, path string, renamed string"), spark.createDataFrame([(s,) for s in starts], "path string"))
    assert sorted(map(str, ((r.start, r.path, r["from"], r.until) for r in got.collect()))) == sorted(map(str, want))
    assert len(want) > 25 and plans and not any("Broadcast" in p for p in plans)


def test_views_that_nothing_used_for_a_week_go(spark, tmp_path):
    make = lambda: spark.range(3)
    root, now = str(tmp_path), time.time_ns()
    for key in ("old", "read", "new"):
        assert store.kept_view(spark, root, "v", key, make).count() == 3
    for key in ("old", "read", "new"):
        store.marked(spark, f"{root}/v/{key}/_SUCCESS", now - store.KEPT_NS - 10**9)
    store.kept_view(spark, root, "v", "read", make)
    assert store.tidied(spark, f"{root}/v", "new", now) == ["old"]
    assert sorted(p.name for p in (tmp_path / "v").iterdir()) == ["new", "read"]
