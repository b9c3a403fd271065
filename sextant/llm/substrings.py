"""Substring dedup: Rabin-Karp hashes of fixed-length windows of tokens, counted in Spark.

Counting each window of the corpus as a row would shuffle several times the input, so all
windows are first told apart by their anchor: the 8-token gram of smallest Rabin-Karp hash in
a window. Equal windows have equal anchors, so a window whose anchor occurs once in the
corpus cannot repeat; only windows with a repeated anchor are shuffled and counted. The
anchors are every 14th token or so. The windows of one anchor in one place of a text are a
run; runs are counted first, as one row each, and a run found twice is all repeated. Single
windows are counted only where an anchor has a run that is found once, and then once for
each distinct run. Repeated windows merge into maximal removal intervals.

Copies of a whole text are one text that counts as two. A window is known by its own hash
and its anchor's, 128 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import U64, Door, WordHashes, as_bytes, lean, mixed, removed, slices, written

WINDOW = 35
GRAM = 8
#: Bases of the rolling hashes of grams and of windows, modulo 2^64; odd, so powers have inverses.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    np.multiply.accumulate(np.full(n - 1, base, U64), out=out[1:]) if n > 1 else None
    return out


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of each run of `width` tokens: sum of token k times base^(width-1-k), modulo 2^64."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    inverse = pow(base, -1, 1 << 64)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(hashes * _powers(inverse, len(hashes)), dtype=U64)))
    return (sums[width:] - sums[:n]) * _powers(base, n + width - 1)[width - 1 :]


def anchors(hashes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window's anchor, and its place among the grams."""
    grams = mixed(rolling(hashes, gram, BASES[0]))
    view = sliding_window_view(grams, width - gram + 1)
    place = view.argmin(axis=1) + np.arange(len(view))
    return grams[place], place


def _anchored(width: int, gram: int):
    """(t1, t2, text) to the distinct anchors of each text: n is 2 where it has one twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for whole in batches:
            for part in slices(whole, "text"):
                t1, t2 = part.column("t1").to_numpy(), part.column("t2").to_numpy()
                out: list[list[np.ndarray]] = [[], [], [], []]
                for i, text in enumerate(as_bytes(part.column("text"))):
                    hashes = words.of(text.split())
                    if len(hashes) < width:
                        continue
                    anchor, place = anchors(hashes, width, gram)
                    first = np.concatenate(([True], place[1:] != place[:-1]))
                    value, count = np.unique(anchor[first], return_counts=True)
                    for to, values in zip(out, (np.full(len(value), t1[i]), np.full(len(value), t2[i]), value.view(np.int64), np.minimum(count, 2).astype(np.int32)), strict=True):
                        to.append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["t1", "t2", "anchor", "n"])

    return run


def _runs(width: int, gram: int):
    """(t1, t2, text, again) to the runs of windows whose anchor is in `again`: the anchor, the
    run's hash, its first start and its windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for whole in batches:
            for part in slices(whole, "text", 64):
                t1s, t2s = (part.column(c).to_pylist() for c in ("t1", "t2"))
                out: list[list] = [[], [], [], [], [], []]
                for t1, t2, text, again in zip(t1s, t2s, as_bytes(part.column("text")), part.column("again"), strict=True):
                    hashes = words.of(text.split())
                    anchor, place = anchors(hashes, width, gram)
                    window = rolling(hashes, width, BASES[1])
                    edges = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))
                    for k in np.flatnonzero(np.isin(anchor[edges[:-1]].view(np.int64), again.values.to_numpy())).tolist():
                        a, b = int(edges[k]), int(edges[k + 1])
                        of = window[a:b]
                        for to, value in zip(out, (t1, t2, anchor[a], xxhash.xxh3_64_intdigest(of.tobytes()), a, of.view(np.int64)), strict=True):
                            to.append(value)
                signed = [np.array(x, U64).view(np.int64) for x in out[2:4]]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                columns = [out[0], out[1], *signed, out[4], out[5]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["t1", "t2", "anchor", "run", "start", "windows"])

    return run


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals [start, end) of tokens under windows that start there."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + width)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.concatenate((cut, [len(starts) - 1]))] + width).tolist(), strict=True))


def _starts(marks: pa.ListScalar) -> np.ndarray:
    """Every start of marks (at, n): n starts from at on."""
    at, n = (marks.values.field(c).to_numpy() for c in ("at", "n"))
    return np.concatenate([np.arange(a, a + k) for a, k in zip(at.tolist(), n.tolist(), strict=True)])


def _removed(width: int, payload: list[str], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, column, 256):
                n, spans, kept = [], [], []
                for text, starts, copied in zip(as_bytes(part.column(column)), part.column("starts"), part.column("copied").to_pylist(), strict=True):
                    tokens = [] if text is None else text.split()
                    n.append(len(tokens))
                    if copied and len(tokens) >= width:
                        found = [(0, len(tokens))]
                    else:
                        found = intervals(_starts(starts), width) if starts.is_valid else []
                    spans.append([{"s": a, "e": b} for a, b in found])
                    for a, b in reversed(found):
                        del tokens[a:b]
                    kept.append(b" ".join(tokens).decode())
                made = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in payload), *made], names=[*payload, "sub_n_words", "sub_spans", "sub_kept"])

    return run


def without_repeats(documents: DataFrame, width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`documents` (with a string column text) and, of each row: sub_n_words; sub_spans, the
    maximal runs of words [s, e) under windows of `width` words that also start elsewhere in
    the corpus, the same text included; sub_kept, the other words joined by one space.

    Words are runs of anything but ASCII white space, unchanged. A null text is as an empty
    one: no words, no spans, kept ''. Texts of fewer than `width` words have no window.
    Windows are judged on the input, so all copies of a passage go. Repeated rows are copies
    like others. Other columns stay, of whatever types; one that has one of the three names
    comes back with `_input` added.
    """
    door = Door(documents, ("sub_n_words", "sub_spans", "sub_kept"))
    spark = door.spark
    text = door.string("text", "sub_text")
    keyed = door.rows.withColumns({"t1": F.xxhash64(F.coalesce(text, F.lit(""))), "t2": F.coalesce(F.length(text), F.lit(0))})
    # Of copies of a text one row is looked at: one of least hash, by the columns that have one.
    hashed = [f.name for f in door.rows.schema.fields if f.name in door.own and not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    row = F.xxhash64(*hashed)
    texts = keyed.select("t1", "t2", row.alias("row")).groupBy("t1", "t2").agg(F.min("row").alias("rep"), (F.count("*") > 1).alias("copied"))
    light = keyed.select("t1", "t2", F.coalesce(text, F.lit("")).alias("text"))
    found = light.mapInArrow(lean(_anchored(width, gram)), "t1 long, t2 int, anchor long, n int")
    found, found_path = written(found, "anchors")
    repeated = found.groupBy("anchor").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi"), F.max("n").alias("n")).where("lo < hi or n > 1").select("anchor")
    repeated, repeated_path = written(repeated, "anchors")
    flagged = found.join(repeated, "anchor").groupBy("t1", "t2").agg(F.collect_list("anchor").alias("again"))
    known, known_path = written(texts.join(flagged, ["t1", "t2"], "left"), "texts")
    removed(spark, found_path, repeated_path)
    whole = keyed.withColumn("row", row)
    some = whole.select("t1", "t2", F.col(text).alias("sub_whole"), "row").join(known.where("again is not null"), ["t1", "t2"]).where("row = rep")
    runs = some.select("t1", "t2", F.col("sub_whole").alias("text"), "again").mapInArrow(lean(_runs(width, gram)), "t1 long, t2 int, anchor long, run long, start int, windows array<long>")
    runs, runs_path = written(runs, "runs")
    known, marks_path = written(known.select("t1", "t2", "copied"), "texts")
    removed(spark, known_path)
    weighed = runs.join(known, ["t1", "t2"]).select("anchor", "run", "t1", F.when(F.col("copied"), 2).otherwise(1).alias("n"))
    counted, counted_path = written(weighed.groupBy("anchor", "run").agg(F.sum("n").alias("n"), F.min("t1").alias("lo")), "counted")
    partly = counted.groupBy("anchor").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where("least = 1 and kinds > 1").select("anchor")
    # One place of each distinct run of an anchor that has a single one.
    looked, looked_path = written(counted.join(partly, "anchor"), "counted")
    single = runs.join(looked, ["anchor", "run"]).where("t1 = lo")
    single = single.select("anchor", "t1", "t2", "n", F.posexplode("windows").alias("k", "window"), "start").select("anchor", "window", "t1", "t2", "n", (F.col("start") + F.col("k")).alias("at"))
    twice, twice_path = written(single.groupBy("anchor", "window").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "window"), "windows")
    marks = single.where("n = 1").join(twice, ["anchor", "window"], "left_semi").select("t1", "t2", "at", F.lit(1).alias("n"))
    whole_runs = runs.join(counted.where("n > 1").select("anchor", "run"), ["anchor", "run"], "left_semi").select("t1", "t2", F.col("start").alias("at"), F.size("windows").alias("n"))
    starts = marks.union(whole_runs).groupBy("t1", "t2").agg(F.collect_list(F.struct("at", "n")).alias("starts"))
    marks, _ = written(known.join(starts, ["t1", "t2"], "left").where("copied or starts is not null"), "marks")
    removed(spark, runs_path, counted_path, looked_path, twice_path, marks_path)
    out = whole.join(marks, ["t1", "t2"], "left").select(*door.rows.columns, "starts", F.coalesce("copied", F.lit(False)).alias("copied"))
    cut = out.mapInArrow(lean(_removed(width, door.own, text)), door.schema("sub_n_words long, sub_spans array<struct<s:int,e:int>>, sub_kept string"))
    return door.out(cut, F.col("sub_n_words"), F.col("sub_spans"), F.col("sub_kept"))


def digested(cut: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the rows of `without_repeats`."""
    n_removed = F.aggregate("sub_spans", F.lit(0), lambda t, x: t + x["e"] - x["s"]).cast("long")
    return cut.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("sub_n_words").alias("n_words"), n_removed.alias("n_removed"), F.sha2("sub_kept", 256).alias("kept_sha256"))
