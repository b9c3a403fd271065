"""The operators against brute force on small tables with nulls, empty and repeated rows."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import contamination, html, lines, minhash, mixing, quality, sharding, substrings, vectors, warc
from sextant.llm.common import with_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def components(nodes, links):
    at = {n: n for n in nodes}

    def top(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        at[b] = a
    return {n: top(n) for n in nodes}


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        k = rng.randrange(len(words))
        choice = rng.randrange(3)
        if choice == 0:
            words[k] = f"x{rng.randrange(30)}"
        elif choice == 1 and len(words) > 6:
            del words[k]
        else:
            words.insert(k, f"x{rng.randrange(30)}")
    return " ".join(words)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (40, 60), (60, 40)]
    got = {r.node: r.component for r in with_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: (0 if n < 100 else 100) for n in [*range(41), 60, *range(100, 130)]}
    assert with_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_vectors_link_as_all_pairs_do(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 24))
    rows = [(i, (base[i % 30] + rng.normal(size=24) * 0.25 * (i % 4)).astype(np.float32).tolist()) for i in range(240)]
    rows += [(300, None), (301, []), (302, [0.0] * 24), (303, [float("nan")] + [1.0] * 23), (304, [None] + [1.0] * 23), (305, rows[0][1]), (306, rows[0][1]), (307, [1.0, 2.0]), (308, [1.0, 2.0]), (309, [float("inf")] * 24), (None, rows[0][1])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.9, tile_bytes=24 * 8 * 16).collect()
    sound = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, b in itertools.combinations(sound, 2) if len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] / np.linalg.norm(sound[a]) / np.linalg.norm(sound[b]) >= 0.9]
    degree = {i: sum(i in pair for pair in links) for i, _ in rows}
    of = components([i for i, _ in rows if i is not None], links)
    assert len(links) > 200 and len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == ((degree[r.vec_id], of[r.vec_id], of[r.vec_id] == r.vec_id) if r.vec_id is not None else (0, None, True))
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_any_scale_and_rows_of_one_id(spark):
    rows = [(1, [1e-200, 0.0]), (2, [1e-200, 1e-203]), (3, [1e200, 0.0]), (4, [0.0, 1e300]), (5, [1e-300, 1e-5]), (6, [5e-324, 0.0]), (7, [-1e308, 0.0]), (8, [0.0, -0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 6: (3, 1), 4: (1, 4), 5: (1, 4), 7: (0, 7), 8: (0, 8)}
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [1.0, -0.1]), (0, [0.1, 1.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 1, 0, True), (1, 1, 0, False), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)]


# 2


def test_scores_are_those_of_plain_numpy(spark):
    rng = random.Random(22)
    docs = [(i, prose(rng, rng.randrange(5, 90)) + rng.choice([" ok", "!!", " |"]) * rng.randrange(9)) for i in range(400)]
    labels = [(i, int(t.count("!") + rng.random() < 2)) for i, t in docs if i % 3]
    got = {r.doc_id: r.score for r in quality.scored(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = np.array([quality.statistics(t.encode()) for _, t in docs])
    own = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    known, y = x[[i for i, _ in own]], np.array([q for _, q in own], float)
    # The features once more: cosines of scaled statistics by the model's own directions.
    scale = known.std(axis=0)
    model = quality.Model(known.mean(axis=0), np.where(scale < 1e-9, 1, scale), quality.FEATURES, 2)
    mapped = lambda rows: np.hstack([np.cos(np.clip((rows - model.mean) / model.scale, -5, 5) @ model.directions + model.phases) * math.sqrt(2 / quality.FEATURES), np.ones((len(rows), 1))])
    z = mapped(known)
    penalty = np.diag([quality.RIDGE * len(y)] * quality.FEATURES + [0.0])
    weights = np.linalg.lstsq(np.vstack([z, np.sqrt(penalty)]), np.concatenate([y, np.zeros(len(penalty))]), rcond=None)[0]
    raw = np.clip(z @ weights, -0.5, 1.5)
    of = np.minimum((raw + 0.5) / 2 * quality.BINS, quality.BINS - 1).astype(int)
    bins = [(float((of == b).sum()), y[of == b].sum(), raw[of == b].sum()) for b in sorted(set(of))]
    # Isotonic regression by its minimax formula.
    n, hits = np.array([b[0] for b in bins]), np.array([b[1] for b in bins])
    level = [max(min(hits[a : b + 1].sum() / n[a : b + 1].sum() for b in range(k, len(bins))) for a in range(k + 1)) for k in range(len(bins))]
    pools = [[b for b, v in zip(bins, level, strict=True) if abs(v - u) < 1e-12] for u in sorted({round(v, 12) for v in level})]
    knots = [(sum(b[2] for b in p) / sum(b[0] for b in p), (sum(b[1] for b in p) + 0.5) / (sum(b[0] for b in p) + 1)) for p in pools]
    want = np.interp(np.clip(mapped(x) @ weights, -0.5, 1.5), [k for k, _ in knots], [v for _, v in knots])
    assert [got[i] for i, _ in docs] == pytest.approx(want.tolist(), abs=1e-6) and len(set(got.values())) > 20


def test_quality_learns_from_the_rows_it_may(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        text = prose(rng, rng.randrange(20, 200)) if good else " ".join(rng.choice(["a!!", "b!!"]) for _ in range(rng.randrange(20, 200)))
        docs.append((i, text, "en", "s", 1))
        labels.append((i, int(good), 0))
    docs += [(None, None, None, None, None), (1000, "", "en", "s", 0), (3, docs[3][1], "de", "t", 5)]
    labels += [(5, None, None), (None, 1, 0)]
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality.digested(quality.scored(spark.createDataFrame(docs, DOCS), labelled)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) > 0.97 * len(held)
    # Labels of held-out rows, and anything but the text, change no score.
    flipped = spark.createDataFrame([(i, 1 - q if i is not None and q is not None and zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = quality.scored(spark.createDataFrame([(i, t, "xx", "yy", 9) for i, t, *_ in docs], DOCS), flipped).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in again} == {(r.doc_id, round(r.score, 9)) for r in rows}
    none = quality.scored(spark.createDataFrame(docs[:2], DOCS), labelled.limit(0)).collect()
    assert [r.score for r in none] == [0.5, 0.5]
    assert quality.scored(spark.createDataFrame([], DOCS), labelled).count() == 0


def test_isotonic_pools_are_monotone():
    raw, share = quality.isotonic(np.ones(6), np.array([0, 1, 0, 1, 1, 0.0]), np.arange(6.0))
    assert (np.diff(share) >= 0).all() and (np.diff(raw) > 0).all()


# 3


def test_lines_of_templates_that_recur_go(spark):
    docs = [(i, f"unique text {'abcdefgh'[i]} of document {'stuvwxyz'[i]} here\nPage {i} of {i + 3} printed on day {i}\n\nshared closing line of all", "en", "s", 1) for i in range(6)]
    docs += [(10, None, None, None, None), (11, "", "en", "s", 0), (12, "a line with nothing in common at all", "en", "s", 1), (0, docs[0][1], "en", "s", 1), (None, "Page 3 of 9 printed on day 4", None, None, None)]
    got = lines.without_boilerplate(spark.createDataFrame(docs, DOCS)).collect()
    assert len(got) == len(docs)
    by = {(r.doc_id, r.lang): r for r in got}
    assert by[(2, "en")].line_dropped == [1, 3] and by[(2, "en")].line_kept == docs[2][1].split("\n")[0] + "\n" and by[(2, "en")].line_n == 4
    assert by[(10, None)].line_kept is None and by[(10, None)].line_n == 0
    assert by[(11, "en")].line_kept == "" and by[(11, "en")].line_n == 1
    assert by[(12, "en")].line_dropped == [] and by[(None, None)].line_dropped == [0]
    assert lines.without_boilerplate(spark.createDataFrame([], DOCS)).count() == 0


def test_similar_lines_share_the_commonest_template(spark):
    docs = [(i, f"posted by user {name} on the first of may") for i, name in enumerate(("ann", "bob", "cid", "dan"))] + [(9, "posted by user eve but all of these words differ")]
    got = {r.doc_id: r.line_dropped for r in lines.without_boilerplate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: [0], 1: [0], 2: [0], 3: [0], 9: []}


def test_every_family_of_a_leaf_has_a_template(spark):
    fixed = "posted by user none and this line is fixed"
    docs = [(i, f"posted by user {'abcdefgh'[i]} on the first of may") for i in range(8)] + [(i, fixed) for i in (20, 20, 21, 22, 23)] + [(30, "posted by user z on some other day altogether"), (31, "posted by user of which nothing else is alike")]
    docs += [(40 + i, "posted by user " + " ".join(f"{'pqr'[i % 3]}{x}" for x in "tuvwxy")) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    dropped = {i for i, t in docs if i < 8 or t == fixed or i >= 40}
    for leading in (1, 2, lines.LEADING):
        got = [(r.doc_id, r.text, r.line_dropped) for r in lines.without_boilerplate(df, leading=leading).collect()]
        assert sorted(got) == sorted((i, t, [0] if i in dropped else []) for i, t in docs)


def test_families_are_those_of_one_template_after_the_other(spark):
    rng = random.Random(33)
    rows = [(leaf, k, " ".join(["a", "b", "c", *(rng.choice("xyz") for _ in range(5))]), rng.randrange(1, 5)) for leaf in range(6) for k in range(40)]
    rows = list({(leaf, shape): (leaf, k, shape, n) for leaf, k, shape, n in rows}.values())
    want = {}
    for leaf in range(6):
        left = sorted((r for r in rows if r[0] == leaf), key=lambda r: (r[3], r[2]), reverse=True)
        while sum(r[3] for r in left) >= 3:
            head = left[0]
            of = [r for r in left if sum(x == y for x, y in zip(r[2].split(), head[2].split())) >= 0.7 * 8]
            want |= {(leaf, r[1]): head[1] for r in of}
            left = [r for r in left if r not in of]
    df = spark.createDataFrame(rows, "leaf long, own long, shape string, n long")
    for leading in (3, lines.LEADING):
        got = {(r.leaf, r.own): r.template for r in lines.families(df, 0.7, 3, leading)[0].collect()}
        # Lines left at the end are of too few documents; a round may still settle some of them.
        assert want.items() <= got.items()
        assert sum(r[3] for r in rows if (r[0], r[1]) not in want) < 3 * 6


def test_lines_dropped_are_those_of_a_serial_parser(spark):
    rng = random.Random(3)
    kinds = ["{} joined the group {} today", "page {} of the {} book", "all {} reserved", "of {}", "the {} {} {} was here and left", "  spaced\tout {}  line "]
    docs = [(i if rng.random() < 0.95 else None, "\n".join(rng.choice(kinds).format(*(rng.choice(["ann", "bob", "7", "x9", "cid", "dan"]) for _ in range(3))) if rng.random() < 0.7 else prose(rng, 6, 9) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    leaves = {}
    for i, t in docs:
        for line in t.split("\n"):
            tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))
            if tokens:
                leaves.setdefault((len(tokens), tokens[:3]), {}).setdefault(tokens, set()).add(i)
    gone = set()
    for left in leaves.values():
        while sum(map(len, left.values())) >= 3:
            head = max(left, key=lambda t: (len(left[t]), " ".join(t)))
            family = [t for t in left if sum(x == y for x, y in zip(t, head, strict=True)) >= 0.7 * len(t)]
            if len(set().union(*(left[t] for t in family))) >= 3:
                gone |= set(family)
            for t in family:
                del left[t]
    got = sorted((str(r.doc_id), r.text, r.line_dropped) for r in lines.without_boilerplate(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    numbers = lambda t: [k for k, line in enumerate(t.split("\n")) if tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line)) in gone]
    # Rows without an id are one document, whose lines of one number and leaf go together.
    assert [(i, d) for i, t, d in got if i != "None"] == [(str(i), numbers(t)) for i, t in sorted(docs, key=lambda d: (str(d[0]), d[1])) if i is not None]
    assert sum(len(d) for _, _, d in got) > 60 and len(gone) > 10


def test_short_lines_that_recur_go_and_blank_ones_stay(spark):
    docs = [(i, f"All rights reserved.\n\n  \nOf.\nPage {i}\nown {'abcd'[i]}\n版权所有。") for i in range(4)] + [(9, "All rights kept.\nOf\nPage")]
    got = {r.doc_id: (r.line_dropped, r.line_kept) for r in lines.without_boilerplate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: ([0, 3, 4, 6], f"\n  \nown {'abcd'[i]}") for i in range(4)} | {9: ([], docs[-1][1])}


# 4


def brute_targets(sizes, weights=(1, 2, 3), limit=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > limit * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: limit * sizes[s] for s in over}


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.randrange(1, 400)), "en", rng.choice(["a", "b", "B", "é", None, "tiny"] if i % 50 == 0 else ["a", "b", "B", "é", None]), 1) for i in range(500)]
    docs += [(900, None, "en", "empty", 0), (901, "", "en", "b", 0), (902, "one", "en", "tiny", 3)]
    df = spark.createDataFrame(docs, DOCS)
    mix, plan = mixing.mixed_sources(df, bucket_rows=20)
    rows = mix.collect()
    sizes = {}
    for _, t, _, s, _ in docs:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    target = brute_targets(sizes)
    taken = {}
    for r in rows:
        assert r.mix_size == len(WORD.findall(r.text or "")) and r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(target[r.source]) and 0 <= r.mix_taken <= 3 * r.mix_size
        assert r.mix_taken == r.mix_rounds * r.mix_size + sum(x.e - x.s for x in r.mix_spans)
        taken[r.source] = taken.get(r.source, 0) + r.mix_taken
    assert len(rows) == len(docs)
    for s, t in target.items():
        assert abs(taken[s] - t) <= 3 * mixing.BLOCK
    again, _ = mixing.mixed_sources(df.repartition(7), bucket_rows=20)
    assert {(r.doc_id, r.mix_taken) for r in again.collect()} == {(r.doc_id, r.mix_taken) for r in rows}
    quotas = {}
    for r in mixing.shard_quotas(plan, 4).collect():
        quotas.setdefault(r.source, []).append(r.quota)
    assert {s: sum(q) for s, q in quotas.items()} == {r.source: r.quota for r in plan.collect()}
    assert all(max(q) - min(q) <= 1 for q in quotas.values())
    words = {}
    for r in mixing.copies(mix, df.columns).collect():
        words[r.source] = words.get(r.source, 0) + len(WORD.findall(r.text or ""))
    assert {s: n for s, n in taken.items() if n} == {s: n for s, n in words.items() if n}
    assert mixing.mixed_sources(spark.createDataFrame([], DOCS))[0].count() == 0


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_shards_hold_the_quotas_of_each_source(spark, shards):
    rng = random.Random(44)
    rows = [(i, " ".join(f"w{x}" for x in range(rng.randrange(150))), ("a", "b", None)[min(i % 7, 2)]) for i in range(90)] + [(None, None, "a"), (3, "", "z")]
    mix, plan = mixing.mixed_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), bucket_rows=20, shards=shards)
    got, want, taken = {}, {(r.source, r.shard): r.quota for r in mixing.shard_quotas(plan, shards).collect()}, mix.collect()
    assert any(r.mix_rounds for r in taken) and any(r.mix_spans for r in taken)
    for r in taken:
        assert sum(x.e - x.s for x in r.mix_dealt) == r.mix_taken
        for n in range(r.mix_size):
            assert sum(x.s <= n < x.e for x in r.mix_dealt) == r.mix_rounds + sum(x.s <= n < x.e for x in r.mix_spans)
        for x in r.mix_dealt:
            got.setdefault((r.source, x.shard), set()).add(x.seat)
    assert {k: len(v) for k, v in got.items()} == {k: n for k, n in want.items() if n}


def test_blocks_are_permuted(spark):
    rows = [(n, k) for n in (1, 2, 3, 6, 97, 1000) for k in range(n)]
    keys = mixing.swaps(F.lit("a"), F.col("n"), 4)
    got = {}
    for r in spark.createDataFrame(rows, "n long, k long").withColumn("keys", keys).select("n", "k", mixing.permuted(F.col("k"), F.col("keys"), F.col("n")).alias("p")).collect():
        got.setdefault(r.n, {})[r.k] = r.p
    assert all(sorted(of.values()) == list(range(n)) for n, of in got.items())
    # The first tenth chosen is spread over the blocks, in no run.
    chosen = sorted(k for k, p in got[1000].items() if p < 100)
    assert sum(b - a == 1 for a, b in itertools.pairwise(chosen)) < 25 and 350 < np.mean(chosen) < 650


def test_quotas_go_to_the_highest_quotients(spark):
    rng = random.Random(44)
    for _ in range(5):
        targets = {f"s{k:02d}": rng.choice([0.0, rng.random(), rng.random() * 50, 10.0, 10.0]) for k in range(rng.randrange(1, 30))}
        seats = rng.randrange(1, 200)
        df = spark.createDataFrame([(s, t, seats) for s, t in targets.items()], "source string, target double, n long")
        got = {r.source: r.quota for r in mixing.apportioned(df, "n").collect()}
        want = dict.fromkeys(targets, 0)
        for _ in range(seats if sum(targets.values()) else 0):
            want[min(targets, key=lambda s: (-targets[s] / (2 * want[s] + 1), s))] += 1
        assert got == want


# 5


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Top</header><nav><ul><li><a href="/x">x</a></ul></nav><div class="cookie-notice">Cookies</div>{}<aside>Side</aside><div id="comments"><article>Nice</article></div><script>var a="</p>";</script><footer>&copy; end</footer></body></html>'
HTML = "page_id long, url string, html string"


def main_texts(spark, pages, url="http://one.example/{}", **settings):
    rows = [(i, url.format(i), p) for i, p in enumerate(pages)]
    got = {r.page_id: r.main_text for r in html.extracted(spark.createDataFrame(rows, HTML), **settings).collect()}
    return [got[i] for i in range(len(pages))]


def test_main_text_of_broken_pages(spark):
    page = PAGE.format("<article class=post><h1>A &amp; B</h1><p>one<b> two\n three<br>four<p>five&nbsp;&lt;p&gt;<form><p>no</form><ul><li>six<li>se<i>ven</i></ul><div class='ad'>buy</div></article>")
    odd = ["", "<", "plain & text", "<p", "<!-- open", "<script>x", "<a b='c", "</p></div>", "<div>" * 3000 + "deep" + "</div>" * 3000, "plain &amp; text <b>x</b>"]
    got = main_texts(spark, [page, *odd], url="http://h{}.example/")
    assert got[0] == "A & B one two three four five <p> six seven"
    assert got[3] == "plain & text" and got[9] == "deep" and got[10] == "plain & text x"


def test_names_are_whole_and_the_main_part_stays(spark):
    pages = {
        '<div class="content has-sidebar">Body of it</div>': "Body of it",
        '<article><p>a</p><p class="market-share">b</p><section id="search-algorithms">c</section><math>x+1</math></article><p>beside</p>': "a b c x+1",
        "<main><p>the long text of the main part</p><article>teaser</article><p>and its end</p></main><div>beside</div>": "the long text of the main part teaser and its end",
        "<main><article>all of the article that there is</article><p>more of them</p></main>": "all of the article that there is",
        "<article><header><h1>Title</h1></header>body<footer>by</footer></article>": "Title body",
        '<div class="page-header">x</div><div class="sidebar_left">y</div><p>text</p><div role="navigation">z</div>': "text",
        "<nav><article>not here</article></nav><p>here</p>": "here",
    }
    assert main_texts(spark, list(pages), url="http://h{}.example/") == list(pages.values())


def site(rng, n):
    """Pages of a host whose banner, unnamed, is the same everywhere and whose links, unnamed, are the same on most."""
    top = "<div class=top>Welcome to the site</div>"
    for i in range(n):
        links = "<div class=x1><span>One</span><p>Two</p></div>" if rng.random() < 0.9 else ""
        parts = "".join(f"<p>{prose(rng, rng.randrange(3, 20))}</p>" + ("<ul><li>a<li>b</ul>" if rng.random() < 0.3 else "") for _ in range(rng.randrange(1, 6)))
        yield f"<html><body>{top}<div class=body>{parts}</div>{links}<div class=ad>{prose(rng, 4)}</div></body></html>"


def test_the_tree_decides_what_goes(spark):
    pages = list(site(random.Random(5), 40))
    with_tree, without = main_texts(spark, pages), main_texts(spark, pages, least=0)
    assert all("Welcome" not in t and "Two" not in t for t in with_tree) and all("Welcome" in t for t in without)
    want = [" ".join(WORD.findall(re.sub("<[^>]*>", " ", re.search(r"<div class=body>(.*?)</div>", p)[1]))) for p in pages]
    # What lists repeat on page after page goes as well.
    assert [t.replace(" a b", "") for t in want] == [t.replace(" a b", "") for t in with_tree]
    # On a host of few pages the tree says too little.
    assert all("Welcome" in t for t in main_texts(spark, pages[:3], url="http://few.example/{}"))


def brute_tree(pages):
    """Importance of the nodes of one host's pages, and the topmost nodes that go, by the book."""
    seen = {}
    for p in pages:
        page = html.Page(p or "")
        noise = page.below(page.noise)
        for (key, kind, content), i in page.facts().items():
            node = seen.setdefault(key, {"path": page.path(i), "noise": noise[i], "main": page.tag[i] in html.MAIN, "shown": {}, "held": {}, "beside": set(), "pages": set()})
            node["held" if kind == 0 else "shown"].setdefault((kind, content), set()).add(page.own)
            if kind:
                node["pages"].add((kind, page.own))
                node["beside"] |= {page.own} if kind == 2 else set()
    for node in seen.values():
        node["m"] = sum(len(k) for k in node["shown"].values())
        node["entropy"] = sum(math.log(len(k), node["m"]) for k in node["held"].values()) if node["m"] > 1 else 0
    likely = {}
    for key, node in seen.items():
        below = [o for o in seen.values() if key in o["path"]]
        n = sum(len(o["held"]) for o in below)
        if not n:
            continue
        m, l = node["m"], len(node["shown"])  # noqa: E741
        shares = [len(k) / m for k in node["shown"].values()]
        diverse = 0.5 if m == 1 else -sum(p * math.log(p) for p in shares) / math.log(l) if l > 1 else 0
        node["importance"] = 1 - node["entropy"] / len(node["held"]) if node["held"] else (1 - 0.9**l) * diverse + 0.9**l * (1 - sum(o["entropy"] for o in below) / n)
        told = min(0.95, max(0.05, (node["importance"] * m + 4) / (m + 8)))
        prior = 0.02 if node["noise"] else 0.9 if node["main"] else 0.5 - 0.48 * len(node["beside"]) / m
        odds = told / (1 - told) * prior / (1 - prior)
        likely[key] = odds / (1 + odds)
    low = {k for k in likely if max(v for o, v in likely.items() if k in seen[o]["path"]) < html.LEAST}
    return seen, {k for k in low if not low & set(seen[k]["path"][:-1])}


def test_trees_are_those_of_brute_force(spark):
    rng = random.Random(55)
    pages = list(site(rng, 25)) + [f"<body><nav>menu</nav><article>{prose(rng, 9)}</article><p>beside {i % 3}</p></body>" for i in range(9)] + ["", None, "text alone"]
    pages += [pages[0], pages[30]]
    df = spark.createDataFrame([(i, "http://a.example/x", p) for i, p in enumerate(pages)], HTML)
    trees, _ = html.style_trees(df)
    seen, low = brute_tree(pages)
    got = {r.path[-1]: r for r in trees.collect()}
    assert got.keys() == {k for k, n in seen.items() if "importance" in n}
    for k, r in got.items():
        assert r.importance == pytest.approx(seen[k]["importance"], abs=1e-9) and (r.pages, r.path, r.noise) == (seen[k]["m"], seen[k]["path"], seen[k]["noise"])
    assert {k for r in html.removed_branches(trees).collect() for k in r.low} == low and len(low) >= 3


def test_pages_without_text_or_host(spark):
    rows = [(i, f"http://h.example/{i}", f"<html><body><div class=top>Welcome to the site</div><div class=body><p>{prose(random.Random(i), 20)}</p></div></body></html>") for i in range(12)]
    rows += [(100, None, None), (101, "http://other.example/", rows[0][2]), (102, "nonsense", ""), (0, rows[0][1], rows[0][2]), (None, rows[1][1], rows[1][2]), (103, "http://long.example/", "<p>" + "long text " * 60_000)]
    got = {r.page_id: r.main_text for r in html.extracted(spark.createDataFrame(rows, HTML)).collect()}
    assert got[3] == prose(random.Random(3), 20) and got[0] == prose(random.Random(0), 20) and got[None] == prose(random.Random(1), 20)
    assert got[100] == "" and got[102] == "" and got[101] == "Welcome to the site " + prose(random.Random(0), 20) and len(got[103]) == 599_999
    assert html.digested(html.extracted(spark.createDataFrame([], HTML))).count() == 0


# 6


def brute_sets(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("percent", [80, 85])
def test_near_copies_link_as_all_pairs_do(spark, percent):
    rng = random.Random(percent)
    docs = []
    for family in range(5):
        base = prose(rng, rng.choice([12, 40, 90]))
        docs += [edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(60)]
    docs += ["", None, "one two", "ONE two", "one two three", "a b c d e", "É x", "é x", prose(rng, 3000)]
    rows = [(i * 3, t, "en", "s", 1) for i, t in enumerate(docs)] + [(None, docs[0], None, None, None), (0, docs[0], "en", "s", 1)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), percent=percent).collect()
    sets = {i: brute_sets(t) for i, t, *_ in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    of = components(sets, links)
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(brute_sets(docs[0]) if r.doc_id is None else sets[r.doc_id])
        assert r.doc_id is None or (r.component_id, r.kept) == (of[r.doc_id], of[r.doc_id] == r.doc_id)
    assert len(set(of.values())) < len(of) - 60
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_links_past_a_centre_share_an_element():
    rng = random.Random(6)
    seen = 0
    for _ in range(800):
        n, percent = rng.choice([20, 30, 40]), rng.choice([80, 85])
        group = []
        for _ in range(8):
            x = set(range(n))
            for _ in range(rng.randrange(4)):
                k, at = rng.randrange(1, 4), rng.randrange(n)
                x -= set(range(at, at + k))
                x |= {1000 + rng.randrange(12) for _ in range(rng.choice([0, k, k, k + 1]))}
            group.append(x)
        arrays = [np.sort(minhash.mixed(np.array(sorted(x), np.uint64))) for x in group]
        shorter = max(0, *(len(arrays[0]) - len(a) for a in arrays))
        told = [minhash.judged(arrays[0], a, percent, shorter) for a in arrays]
        for i, j in itertools.combinations(range(1, 8), 2):
            if 100 * len(group[i] & group[j]) >= percent * len(group[i] | group[j]) and not (told[i][0] and told[j][0]):
                seen += 1
                assert set(np.concatenate(told[i][2:4]).tolist()) & set(np.concatenate(told[j][2:4]).tolist())
    assert seen > 500


def test_sketches_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(40):
        both = rng.integers(0, 1 << 62, 80).astype(np.uint64)
        one, two = (np.unique(np.concatenate((both, rng.integers(0, 1 << 62, 10).astype(np.uint64)))) for _ in range(2))
        a, b = minhash.sketches([one, two], 150, 6)
        agree.append((a == b).mean())
    assert np.mean(agree) == pytest.approx(0.8, abs=0.02)
    tiny = minhash.sketches([np.array([5], np.uint64)], 16, 1)
    assert (tiny != minhash.FULL).all()


# 7


def test_archives_come_back(spark):
    pages = [(i, f"http://Www.h{i % 3}.example/a b?q={i}", f"<p>page {i // 2} é\r\n\r\nWARC/1.1\r\n</p>") for i in range(40)]
    pages += [(100, None, None), (101, "http://x", ""), (None, "http://n", "<p>page 1 é\r\n\r\nWARC/1.1\r\n</p>"), (7, pages[7][1], pages[7][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = warc.archived(df).collect()
    assert len(rows) == len(pages)
    largest = {}
    for i, _, h in pages:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", -1))
    import base64

    for r in rows:
        payload = next((h or "" for i, _, h in pages if i == r.page_id), "").encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = largest[payload.decode()]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
    in_order = lambda found: sorted(found, key=lambda r: warc.order((r.url_key, r.captured, r.page_id, None, None, None, None, None, r.file, r.offset)))
    assert [r.nth for r in in_order(rows)] == list(range(len(rows)))
    path = f"{spark.conf.get('spark.checkpoint.dir')}/small-files"
    warc.write(df, path, file_bundles=1)
    many = warc.histories(warc.captures(df, path), range_rows=5).collect()
    at = {}
    for n, r in enumerate(in_order(many)):
        assert (r.nth, r.place) == (n, at.get(r.url_key, 0))
        at[r.url_key] = r.place + 1
    assert warc.archived(df.limit(0)).count() == 0
    small = warc.archived(df, least_bytes=10_000).collect()
    assert {r.record_type for r in small} == {"response"}


def test_archives_are_read_in_pieces():
    data = "".join(warc.record(i, f"http://x/{i}", "é" * (i * 700), None) + warc.ENDING for i in range(40)).encode()
    packed = gzip.compress(data[:5000]) + gzip.compress(data[5000:])
    assert b"".join(warc.inflated(packed, 1000)) == data
    got = list(warc.records(warc.inflated(packed, 1000)))
    assert [len(block) for _, block, _, _ in got] == [1400 * i for i in range(40)] and all(data[at : at + 4] == b"WARC" for _, _, at, _ in got)
    for broken in (packed[:-30], gzip.compress(data[:-7])):
        with pytest.raises(ValueError):
            list(warc.records(warc.inflated(broken, 1000)))


def test_loser_tree_merges_runs_of_any_number():
    rng = random.Random(7)
    for k in range(9):
        runs = [sorted((rng.randrange(20), i) for _ in range(rng.randrange(6))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], key=lambda x: x)) == sorted(x for r in runs for x in r)


# 8


def brute_removed(texts, width):
    seen = {}
    for d, t in enumerate(texts):
        words = WORD.findall(t or "")
        for i in range(len(words) - width + 1):
            seen.setdefault(tuple(words[i : i + width]), []).append((d, i))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + width))
    return gone


def test_repeated_windows_go(spark):
    rng = random.Random(8)
    passage, other = prose(rng, 60, 50), prose(rng, 36, 50)
    texts = [prose(rng, rng.randrange(0, 150)) for _ in range(40)]
    for _ in range(25):
        k = rng.randrange(40)
        texts[k] = f"{texts[k]} {rng.choice([passage, other, edited(rng, passage, 1), ' '.join(passage.split()[7:50])])} {prose(rng, rng.randrange(0, 30))}"
    texts += [texts[1], texts[1], f"{other}\n{other}", None, "", "short", " ".join(["again"] * 100), passage, " ".join(passage.split())]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1), (None, passage, None, None, None)]
    gone = brute_removed([r[1] for r in rows], 35)
    got = substrings.without_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    want = []
    for (i, t, *_), g in zip(rows, gone, strict=True):
        words = WORD.findall(t or "")
        want.append((str(i), len(words), len(g), " ".join(w for k, w in enumerate(words) if k not in g)))
    assert sorted((str(r.doc_id), r.sub_n_words, sum(x.e - x.s for x in r.sub_spans), r.sub_kept) for r in got) == sorted(want)
    for r in got:
        assert all(a.e < b.s for a, b in itertools.pairwise(r.sub_spans))
    assert substrings.digested(substrings.without_repeats(spark.createDataFrame([], DOCS))).count() == 0


def test_rolling_hashes_tell_windows_apart():
    hashes = np.array([3, 9, 3, 9, 3, 9, 4], np.uint64)
    rolled = substrings.rolling(hashes, 2, substrings.BASES[0])
    assert rolled[0] == rolled[2] == rolled[4] and len({*rolled.tolist()}) == 3
    assert len(substrings.rolling(hashes[:1], 2, substrings.BASES[0])) == 0
    assert substrings.intervals(np.array([0, 1, 5, 20]), 4) == [(0, 9), (20, 24)]


# 9


def test_shards_are_even_and_gapless(spark):
    docs = [(i % 300, "same" if i % 3 else f"t{i}", None, None, None) for i in range(1003)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/shard-input"
    df.write.parquet(path)
    read = spark.read.parquet(path)
    rows = sharding.sharded(read, range_rows=10).collect()
    counts = [0] * 16
    for r in rows:
        counts[r.shard] += 1
    assert len(rows) == 1004 and max(counts) - min(counts) <= 1
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert {(r.doc_id, r.text, r.shard, r.slot) for r in sharding.sharded(read, range_rows=10).collect()} == {(r.doc_id, r.text, r.shard, r.slot) for r in rows}
    assert sharding.sharded(read, seed=1).where("shard = 0").count() in (62, 63)
    assert sharding.sharded(read.limit(0)).count() == 0
    few = sharding.sharded(spark.createDataFrame([(1,), (2,)], "shard_of long").coalesce(1)).collect()
    assert len({r.shard for r in few}) == 2 and {r.slot for r in few} == {0}


def test_shards_are_those_of_the_matrix_dealt_serially(spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/serial-input"
    spark.range(0, 700, 1, 6).selectExpr("id AS doc_id").write.parquet(path)
    read = spark.read.parquet(path)
    parts = {}
    for r in read.selectExpr("spark_partition_id() AS p", "doc_id").collect():
        parts.setdefault(r.p, []).append(r.doc_id)
    order = sorted(parts)
    matrix = sharding.Communication([len(parts[p]) for p in order], 16, 9)
    held = {}
    for k, p in enumerate(order):
        labels, keys = sharding.dealt(p, matrix.of(k), 9)
        for doc, label, key in zip(parts[p], labels.tolist(), keys.tolist(), strict=True):
            held.setdefault(label, []).append((key, doc))
    want = {(doc, s, n) for s, rows in held.items() for n, (_, doc) in enumerate(sorted(rows))}
    assert {(r.doc_id, r.shard, r.slot) for r in sharding.sharded(read, range_rows=7).collect()} == want


@pytest.mark.parametrize("groups", [1, 3, 1024])
def test_matrix_adds_up(groups):
    for rows in ([], [0], [5], [100, 0, 37, 1], [3] * 50):
        c = sharding.Communication(rows, 16, 9, groups)
        m = np.array([c.of(p) for p in range(len(rows))]).reshape(-1, 16)
        assert m.sum(axis=1).tolist() == rows and (not len(rows) or m.sum(axis=0).max() - m.sum(axis=0).min() <= 1)
    drawn = np.array([sharding.Communication([50, 50], 2, s, groups).of(0)[0] for s in range(300)])
    assert 24 < drawn.mean() < 26 and 1.9 < drawn.std() < 3.2  # sd of the law: 2.51


def test_draws_follow_the_law():
    draw = np.random.default_rng(1)
    for good, bad, n in ((5, 7, 6), (3, 1, 2), (40, 400, 90)):
        total = math.comb(good + bad, n)
        got = np.bincount([sharding.hypergeometric(draw, good, bad, n) for _ in range(20_000)], minlength=good + 1) / 20_000
        want = [math.comb(good, k) * math.comb(bad, n - k) / total if 0 <= n - k <= bad else 0 for k in range(good + 1)]
        assert got == pytest.approx(want, abs=0.015)
    big = [sharding.hypergeometric(draw, 10**12, 15 * 10**12, 10**7) for _ in range(400)]
    assert np.mean(big) == pytest.approx(625_000, abs=250) and np.std(big) == pytest.approx(765.5, rel=0.15)
    assert sharding.hypergeometric(draw, 0, 5, 3) == 0 and sharding.hypergeometric(draw, 5, 0, 3) == 3 and sharding.hypergeometric(draw, 2, 2, 4) == 2


# 10


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


@pytest.mark.parametrize("pattern_bytes", [1 << 30, 400])
def test_hits_are_those_of_all_windows(spark, pattern_bytes):
    rng = random.Random(10)
    items = [(i, prose(rng, rng.choice([2, 5, 10, 14, 30]), 60)) for i in range(12)] + [(50, None), (51, ""), (52, "?!"), (None, "w1 w2"), (3, "w5 w6 w7"), (60, "É Straße"), (61, "café w1")]
    docs = []
    for i in range(60):
        text = prose(rng, rng.randrange(0, 60), 60)
        if i % 3 == 0 and items[i % 12][1]:
            words = items[i % 12][1].split()
            text += ", " + "-".join(words[: rng.randrange(1, len(words) + 1)]).upper() + "! " + text
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, "... ---"), (103, "É straße, CAFÉ w1; café W1"), (0, docs[0][1]), (None, "w5 w6 w7")]
    got = contamination.digested(contamination.scanned(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), pattern_bytes=pattern_bytes)).collect()
    windows = {}
    for i, t in items:
        words = plain_words(t)
        if i is not None and words:
            for k in range(max(1, len(words) - 9)):
                windows.setdefault(tuple(words[k : k + 10]), set()).add(i)
    want = []
    for i, t in docs:
        words, hit, ids = plain_words(t), set(), set()
        for w, of in windows.items():
            for k in range(len(words) - len(w) + 1):
                if tuple(words[k : k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    ids |= of
        want.append((str(i), len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
    assert sum(r.contaminated for r in got) > 10
    assert contamination.scanned(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_hits_map_back_to_the_original():
    assert contamination.without_hits("A b, C-d é!", [1, 3], [2, 5]) == "A , C-!"
    assert contamination.without_hits("A b", [], []) == "A b"
