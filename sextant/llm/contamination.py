"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every window of the benchmark items' words; each text is scanned once.
Both sides are normalised to lower-case words between single spaces, so a match is a run of
whole words, and its end maps back to word numbers and from there to the original.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import Door, as_bytes, lean, removed, slices, written

WINDOW = 10
#: Bytes of patterns and of their items' ids that one automaton may hold (it takes some 30 times
#: that); a larger benchmark is scanned for in as many passes as it needs.
PATTERN_BYTES = 4_000_000

#: ASCII that is no letter or digit becomes a space, A-Z become a-z, other bytes stay.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(65)) + bytes(range(97, 123)) + bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(91, 256))


def words_of(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(PLAIN).split()


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids, windows, sizes = [], [], []
            for item, text in zip(part.column("item_id").to_pylist(), as_bytes(part.column("text")), strict=True):
                words = words_of(text)
                if item is None or not words:
                    continue
                for i in range(max(1, len(words) - width + 1)):
                    run_of = words[i : i + width]
                    ids.append(item)
                    windows.append(b" ".join(run_of))
                    sizes.append(len(run_of))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.binary()), pa.array(sizes, pa.int32())], names=["item", "held", "words"])

    return run


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """held (binary: the window's words), words (their number), items (ids, sorted as strings), one row per distinct window."""
    found = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_windows(width), "item string, held binary, words int")
    return found.groupBy("held", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def automaton(rows: list[tuple[bytes, int, list[str]]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for held, words, items in rows:
        made.add_word(f" {held.decode('latin-1')} ", (words, tuple(items)))
    made.make_automaton()
    return made


#: The automaton that this worker made last, by its broadcast.
_MADE: dict[int, ahocorasick.Automaton] = {}


def _scan(rows, payload: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows.number not in _MADE:
            _MADE.clear()
            _MADE[rows.number] = automaton(rows.value)
        made = _MADE[rows.number]
        for part in (p for whole in batches for p in slices(whole, text)):
            counts, starts, ends, items = [], [], [], []
            for text_ in as_bytes(part.column(text)):
                words = words_of(text_)
                counts.append(len(words))
                plain = f" {b' '.join(words).decode('latin-1')} "
                found = list(made.iter(plain))
                if not found:
                    starts.append([])
                    ends.append([])
                    items.append([])
                    continue
                # The space that closes word k is number k + 1 of all spaces.
                spaces = np.flatnonzero(np.frombuffer(plain.encode("latin-1"), np.uint8) == 32)
                last = np.searchsorted(spaces, [at for at, _ in found])
                firsts = last - np.array([words for _, (words, _) in found])
                runs: list[list[int]] = []
                for a, b in sorted(zip(firsts.tolist(), last.tolist(), strict=True)):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                starts.append([a for a, _ in runs])
                ends.append([b for _, b in runs])
                items.append(sorted({i for _, (_, of) in found for i in of}))
            columns = [pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in payload), *columns], names=[*payload, *MADE])

    return run


MADE = ("bm_n_words", "bm_starts", "bm_ends", "bm_items")
SCANNED = "bm_n_words long, bm_starts array<int>, bm_ends array<int>, bm_items array<string>"


def scanned(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """`documents` (with a string column text) and, of each row: bm_n_words; bm_starts and
    bm_ends, the runs of words [start, end) that windows cover, in order and apart from
    each other; bm_items, the ids of the items whose windows occur, sorted as strings.

    Words are runs of a-z (A-Z lower-cased), digits and all characters beyond ASCII. A window
    is `width` consecutive words of an item; an item of fewer is one window, one without
    words, without text or without id has none. Null texts have no words. Repeated rows give
    repeated results; items that repeat an id are one item. Other columns stay; one that has
    one of the four names comes back with `_input` added. A benchmark whose windows and item
    ids exceed `pattern_bytes` is scanned for in several passes of that size each, written
    between passes, so that no executor holds more than one automaton a task.
    """
    door = Door(documents, MADE)
    spark = door.spark
    text = door.string("text", "bm_text")
    held, path = written(windows(benchmark, width), "windows")
    ids = F.aggregate("items", F.lit(0), lambda t, x: t + F.octet_length(x) + 8)
    size = held.agg(F.coalesce(F.sum(F.octet_length("held") + 2 + ids), F.lit(0))).first()[0]
    passes = max(1, -(-size // pattern_bytes))
    out, before = door.rows, None
    for k in range(passes):
        some = held.where(F.pmod(F.xxhash64("held"), F.lit(passes)) == k) if passes > 1 else held
        rows = Patterns(spark.sparkContext.broadcast([(bytes(r.held), r.words, list(r["items"])) for r in some.collect()]))
        payload = [*door.own, *(["bm_before"] if k else [])]
        schema = door.schema((f"bm_before struct<{BEFORE}>, " if k else "") + SCANNED)
        out = out.mapInArrow(lean(_scan(rows, payload, text)), schema)
        if k:
            out = _merged(out, door.own)
        if k + 1 < passes:
            out, now = written(out, "scanned")
            if before:
                removed(spark, before)
            before = now
            cast = [] if text in door.own else [F.col(door.of("text")).cast("string").alias(text)]
            out = out.select(*door.own, *cast, F.struct(*[F.col(c).alias(c) for c in MADE]).alias("bm_before"))
    removed(spark, path)
    return door.out(out, *[F.col(c) for c in MADE])


BEFORE = SCANNED.replace(" long", ":bigint").replace(" array", ":array")


class Patterns:
    """A broadcast of patterns, and its number, by which a worker knows what it has made."""

    def __init__(self, sent):
        self.sent, self.number = sent, sent._jbroadcast.id()

    def __getstate__(self):
        return self.sent, self.number

    def __setstate__(self, state):
        self.sent, self.number = state

    @property
    def value(self):
        return self.sent.value


def _merged(df: DataFrame, rest: list[str]) -> DataFrame:
    """Runs of this pass and of those before, as runs apart."""
    runs = F.array_sort(F.concat(F.arrays_zip(F.col("bm_starts").alias("s"), F.col("bm_ends").alias("e")), F.arrays_zip(F.col("bm_before.bm_starts").alias("s"), F.col("bm_before.bm_ends").alias("e"))))
    joined = F.aggregate(
        runs,
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda done, run: F.when((F.size(done) > 0) & (F.element_at(done, -1)["e"] >= run["s"]),
                                 F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["s"].alias("s"), F.greatest(F.element_at(done, -1)["e"], run["e"]).alias("e")))))
        .otherwise(F.concat(done, F.array(F.struct(run["s"].alias("s"), run["e"].alias("e"))))),
    )
    return df.withColumn("bm_runs", joined).select(
        *rest, "bm_n_words", F.col("bm_runs.s").alias("bm_starts"), F.col("bm_runs.e").alias("bm_ends"), F.sort_array(F.array_union("bm_items", "bm_before.bm_items")).alias("bm_items")
    )


def digested(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of the rows of `scanned`."""
    n_hit = F.aggregate(F.zip_with("bm_starts", "bm_ends", lambda a, b: b - a), F.lit(0), lambda t, x: t + x).cast("long")
    return hits.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("bm_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("bm_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bm_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_hits(text: str, starts: list[int], ends: list[int]) -> str:
    """The original text with the word runs [start, end) cut out: word numbers map to offsets of the original."""
    raw = text.encode()
    plain = raw.translate(PLAIN)
    solid = np.frombuffer(plain, np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    kept, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        kept.append(raw[at : edges[2 * a]])
        at = edges[2 * (b - 1) + 1]
    return b"".join([*kept, raw[at:]]).decode()
