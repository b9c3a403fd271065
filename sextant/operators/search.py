"""Ranked retrieval: BM25 with named fields, and the gate that says whether anything answers.

The words of a query are few, so a document's words are never listed: their number and each
query word's count are searches of its text. What the scores need of
the corpus (documents, mean length, documents that hold a word) is one aggregate row.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import text
from sextant.session import settled

# Fixed values.
K1, B = 1.2, 0.75
NAMED = 5.0
TESTED = 0.5


def query_words(query: str) -> list[str]:
    """Distinct words of a query in the order they come, as `text.words` gives them."""
    out: list[str] = []
    for identifier in re.findall(r"[^\W]+", query):
        cut = re.sub(r"([^\W\d_A-Z]|\d)([A-Z])", r"\1_\2", identifier)
        cut = re.sub(r"([A-Z])([A-Z][a-z])", r"\1_\2", cut)
        found = [p for p in cut.lower().split("_") if p]
        out += [text.stemmed(p) for p in found] + ([text.stemmed("".join(found))] if len(found) > 1 else [])
    return list(dict.fromkeys(out))


@dataclass
class Corpus:
    """What the scores need of all documents."""

    documents: int
    mean_length: float
    holding: list[int]

    def idf(self) -> list[float]:
        return [math.log(1 + (self.documents - h + 0.5) / (h + 0.5)) for h in self.holding]


def counted(documents: DataFrame, fields: dict[str, float], asked: list[str]) -> DataFrame:
    """`documents` with len (words of all fields, unweighted) and counts (weighted, of each word asked).

    A text is cut once and searched for what is asked; its words are never listed."""
    cuts = documents.withColumns({f"sw_{i}": text.cut_lower(c) for i, c in enumerate(fields)})
    length = sum((text.word_count(F.col(f"sw_{i}")) for i in range(len(fields))), F.lit(0))
    counts = [sum((text.word_times(F.col(f"sw_{i}"), q) * F.lit(float(weight)) for i, weight in enumerate(fields.values())), F.lit(0.0)) for q in asked]
    return cuts.withColumns({"len": length.cast("long"), "counts": F.array(*counts)}).drop(*[f"sw_{i}" for i in range(len(fields))])


def corpus(counts: DataFrame, asked: list[str]) -> Corpus:
    row = counts.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count(F.when(F.col("counts")[i] > 0, 1)).alias(f"h{i}") for i in range(len(asked))]).first()
    return Corpus(row.n, max(1.0, row["mean"] or 1.0), [row[f"h{i}"] for i in range(len(asked))])


def scores(counts: DataFrame, about: Corpus, test: Column | None = None) -> DataFrame:
    """Documents that hold a word asked, with score and held (which words)."""
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("len") / F.lit(about.mean_length))
    parts = [F.when(F.col("counts")[i] > 0, F.lit(idf) * F.col("counts")[i] * (K1 + 1) / (F.col("counts")[i] + norm)).otherwise(0.0) for i, idf in enumerate(about.idf())]
    score = sum(parts, F.lit(0.0))
    if test is not None:
        score = F.when(test, score * TESTED).otherwise(score)
    return counts.withColumns({"score": score, "held": F.transform("counts", lambda c: c > 0)}).where(F.exists("held", lambda h: h)).drop("counts")


@dataclass
class Answer:
    ranked: DataFrame
    answers: bool
    holding: int
    best_holds: list[str]
    absent: list[str]


def gate(asked: list[str], about: Corpus, held: list[bool]) -> tuple[bool, list[str], list[str]]:
    """Whether the best document holds enough of the words that weigh; else what it holds and what none holds."""
    stops = {text.stemmed(w) for w in text.STOP_WORDS}
    weighs = [w not in stops for w in asked]
    if not any(weighs):
        weighs = [True] * len(asked)
    idf = about.idf()
    alone = math.log(1 + (about.documents - 0.5) / 1.5)
    every = sum(v for v, w in zip(idf, weighs, strict=True) if w)
    got = sum(v for v, w, h in zip(idf, weighs, held, strict=True) if w and h)
    both = sum(w and h for w, h in zip(weighs, held, strict=True))
    if both >= min(2, sum(weighs)) or got >= min(alone, every) - 1e-9:
        return True, [], []
    best = [a for a, w, h in zip(asked, weighs, held, strict=True) if w and h] or [a for a, h in zip(asked, held, strict=True) if h]
    return False, best, [a for a, w, n in zip(asked, weighs, about.holding, strict=True) if w and not n]


def search(documents: DataFrame, query: str, fields: dict[str, float], order: list[str], limit: int | None = 20, test: Column | None = None) -> Answer:
    """Documents that answer `query` (their `order` columns, len, score, held), best first, ties by `order`; none if the best holds too little of it.

    A query without words and an empty table find nothing.
    """
    asked = query_words(query)
    rows = documents.withColumn("test", F.coalesce(test, F.lit(False)) if test is not None else F.lit(False))
    counts = counted(rows, fields, asked or [""]).select(*order, "test", "len", "counts")
    if not asked:
        return Answer(counts.limit(0), False, 0, [], [])
    counts = settled(counts)  # the texts are read once; three small passes follow
    about = corpus(counts, asked)
    ranked = scores(counts, about, F.col("test")).orderBy(F.desc("score"), *order)
    best = ranked.select("held").take(1)
    if not best:
        return Answer(ranked, False, 0, [], list(asked))
    passed, holds, absent = gate(asked, about, best[0].held)
    kept = ranked if limit is None else ranked.limit(limit)
    return Answer(kept if passed else kept.limit(0), passed, 0 if passed else ranked.count(), holds, absent)
