"""The pipeline's stages, one after the other, against brute force."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
from tests.llm.test_operators import DOCS, WORD, brute_sets, brute_targets, components, edited, plain_words, prose


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    items = [(i, prose(rng, 14, 3000)) for i in range(3)]
    docs, labels = [], []
    for i in range(240):
        good = i % 5 != 0
        text = prose(rng, rng.randrange(40, 160), 3000) if good else " ".join(rng.choice(["a!!", "b!!"]) for _ in range(rng.randrange(40, 160)))
        if good and i % 7 == 0:
            text += " " + items[i % 3][1]
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    for i in range(240, 300):
        of = rng.choice([d for d in docs if d[0] % 5])
        docs.append((i, edited(rng, of[1], rng.choice([0, 1, 2, 9])), "en", of[3], 1))
    docs += [(3, docs[3][1], "en", "s0", 1), (None, docs[4][1], "en", None, 1), (400, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    before = spark.read.parquet(f"{d}/documents.parquet")
    columns = before.columns
    states = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, d).write.parquet(f"{d}/stage{k}.parquet")
        before = spark.read.parquet(f"{d}/stage{k}.parquet")
        assert k == 4 or before.columns == columns
        states.append(before.collect())
    judged, single, clean, mixed, shards = states

    ids = [r.doc_id for r in judged]
    assert {i for i in ids if i is not None and i < 240} == {i for i in range(240) if i % 5}
    assert all(i in ids for i in range(240, 300))

    sets = {}
    for r in judged:
        if r.doc_id is not None:
            sets.setdefault(r.doc_id, set()).update(brute_sets(r.text))
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = components(sets, links)
    assert sorted(r.doc_id for r in single if r.doc_id is not None) == sorted(i for i in of if of[i] == i) and len(links) > 20
    assert [r.text for r in single if r.doc_id is None] == [docs[4][1]]

    windows = {tuple(w[k : k + 10]) for _, t in items for w in [plain_words(t)] for k in range(len(w) - 9)}
    leaks = lambda t: any(tuple(w[k : k + 10]) in windows for w in [plain_words(t)] for k in range(len(w) - 9))
    assert sorted((str(r.doc_id), str(r.text)) for r in clean) == sorted((str(r.doc_id), str(r.text)) for r in single if not leaks(r.text))

    sizes: dict = {}
    for r in clean:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    taken: dict = {}
    known = {r.doc_id: r.text for r in clean}
    for r in mixed:
        words = WORD.findall(r.text)
        assert r.n_chars == len(r.text) and set(words) <= set(WORD.findall(known[r.doc_id]))
        taken[r.source] = taken.get(r.source, 0) + len(words)
    for s, t in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= 96

    assert sorted((str(r.doc_id), r.text) for r in shards) == sorted((str(r.doc_id), r.text) for r in mixed)
    counts = [sum(r.shard == s for r in shards) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in shards if r.shard == s) == list(range(counts[s])) for s in range(16))


def test_an_empty_corpus_goes_through(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
