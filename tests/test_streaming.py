from __future__ import annotations

from sextant.streaming import feed


def test_arrivals_are_extracted_once(spark, tmp_path):
    files, root, mark = tmp_path / "in", str(tmp_path / "kept"), str(tmp_path / "mark")
    files.mkdir()
    (files / "a.py").write_text("def one(): pass\n")
    (files / "b.py").write_text("def one(): pass\n")
    (files / "c.txt").write_text("nothing\n")
    feed.follow(spark, str(files), root, mark).awaitTermination()
    facts = spark.read.parquet(f"{root}/facts")
    assert facts.count() == 1 and spark.read.parquet(f"{root}/arrivals").count() == 2
    (files / "d.md").write_text("# Top\n")
    (files / "e.py").write_text("def one(): pass\n")
    feed.follow(spark, str(files), root, mark).awaitTermination()
    facts = spark.read.parquet(f"{root}/facts")
    assert {(r.language, r.symbols[1].name) for r in facts.collect()} == {("python", "one"), ("markdown", "Top")} and facts.count() == 2
