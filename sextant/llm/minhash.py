"""MinHash near-dedup by fast similarity sketching.

Documents are sets of five-word shingles. Each set is sketched by rounds of hashed bin
placement: in round i < t every shingle falls in a hashed bin, in round t <= i < 2t in
bin i - t; a bin keeps the smallest hash of the first round that reached it. All t bins
are so filled after 2t rounds at most, after O(t log t / set size) of them mostly, and
each agrees between two sets with probability their Jaccard similarity. Bands of the
sketch give candidates, and full sets confirm them.

Copies of a set are one, and no pair is made in a bucket but (centre, member), with the member
that meets most others for its centre. Let c be the centre and D(x) the shingles that x has
and c lacks, and those that c has and x lacks. If y does not link to c, a set x of the bucket
that links to y shares at least (|c - x| + t |x - c| + t |c + y| - |c & y|) / (1 + t) of D(y),
t being the least similarity: that follows from the sizes of intersections and unions. So
members of a bucket in which some do not link are dealt anew, by the elements of D, into
buckets without c, leaving out as many elements of each D, by order of hash, as that bound
allows. What such buckets hold after the last round is compared pair by pair, as far as the
bound lets a pair link. No link is lost, and buckets of near copies cost about their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import LOWER, MASK, U64, WordHashes, as_bytes, batch, empty, lean, mixed, removed, seeds, slices, with_components, written
from sextant.session import shipped

SHINGLE = 5
#: 30 bands of 5 of 150 bins: a pair at similarity 0.85 shares no band with probability 2e-8.
BANDS, BAND_ROWS = 30, 5
#: Rounds of centres, before pairs. A further one pays where groups within groups are large.
ROUNDS = 1

PLACES = seeds(SHINGLE, 11)
FULL = U64(MASK)


def shingles(text: bytes | None, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text."""
    found = [] if text is None else text.translate(LOWER).split()
    n = len(found)
    if not n:
        return np.empty(0, U64)
    hashes = words.of(found)
    if n < SHINGLE:
        return mixed((hashes * PLACES[:n]).sum(keepdims=True, dtype=U64) + U64(n))
    total = hashes[: n - SHINGLE + 1] * PLACES[0]
    for k in range(1, SHINGLE):
        total += hashes[k : n - SHINGLE + 1 + k] * PLACES[k]
    return np.unique(mixed(total))


def sketches(sets: list[np.ndarray], bins: int, seed: int) -> np.ndarray:
    """One row of `bins` values for each set, none of them empty."""
    out = np.full((len(sets), bins), FULL, U64)
    if not sets:
        return out
    salts = seeds(2 * bins, seed)
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    rows = np.arange(len(sets))  # of `out`, that `owner` counts in
    for i in range(2 * bins):
        x = mixed(elements ^ salts[i])
        placed = ((x >> U64(32)) * U64(bins)) >> U64(32) if i < bins else U64(i - bins)
        got = np.full(len(rows) * bins, FULL, U64)
        np.minimum.at(got, owner * bins + placed.astype(np.int64), x)
        got = got.reshape(len(rows), bins)
        now = out[rows]
        now = np.where(now == FULL, got, now)
        out[rows] = now
        left = (now == FULL).any(axis=1)
        if not left.any():
            break
        if not left.all():
            keep = left[owner]
            elements, owner = elements[keep], (np.cumsum(left) - 1)[owner[keep]]
            rows = rows[left]
    return out


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("doc_id", pa.int64()), ("held", pa.binary())])


def _signed(bands: int, rows: int, seed: int):
    """Batches of (doc_id, text) to SIGNED; k1 and k2 name the set by 128 bits."""
    salts, places = seeds(bands, seed + 1), seeds(rows, seed + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for whole in batches:
            for part in slices(whole, "text", 256):
                sets = [shingles(t, words) for t in as_bytes(part.column("text"))]
                full = [i for i, s in enumerate(sets) if len(s)]
                made = sketches([sets[i] for i in full], bands * rows, seed).reshape(len(full), bands, rows)
                banded = mixed((made * places).sum(axis=2, dtype=U64) ^ salts).view(np.int64)
                of = dict(zip(full, banded.tolist(), strict=True))
                yield batch(
                    SIGNED,
                    doc_id=part.column("doc_id"),
                    n_shingles=[len(s) for s in sets],
                    k1=[int(mixed(s ^ salts[0]).sum(dtype=U64).view(np.int64)) for s in sets],
                    k2=[int(mixed(s + places[0]).sum(dtype=U64).view(np.int64)) for s in sets],
                    bands=[of.get(i, []) for i in range(len(sets))],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for whole in batches:
        for part in slices(whole, "text", 256):
            yield batch(SETS, doc_id=part.column("doc_id"), held=[shingles(t, words).tobytes() for t in as_bytes(part.column("text"))])


#: Tells an element that the centre lacks from one that the member lacks.
LACKS = U64(0x5851F42D4C957F2D)


def judged(c: np.ndarray, x: np.ndarray, percent: int, shorter: int) -> tuple[bool, float, np.ndarray, np.ndarray, int, int]:
    """Whether the sets link; for an x that does not, by how many shingles a set must be
    smaller than c to link to x without sharing any that c lacks; and the elements of D(x), of
    those that c lacks and of those that x lacks, by which members that link past the centre
    find each other; and how many x has that c lacks, and c that x lacks. `shorter`: what the
    smallest member lacks of the centre's size."""
    t, slip = percent / 100, 1e-9
    at = np.minimum(np.searchsorted(c, x), len(c) - 1)
    held = c[at] == x
    both, more = int(held.sum()), x[~held]
    union = len(c) + len(more)
    lacks = np.ones(len(c), bool)
    lacks[at[held]] = False
    less = c[lacks]
    none = less[:0]
    if 100 * both >= percent * union:
        # Without a shared element of `more`, x must be smaller than the centre and share this much of `less`.
        need = math.ceil((len(less) + t * len(more)) / (1 + t) - slip)
        return True, 0.0, mixed(more), mixed(less[: len(less) - need + 1] ^ LACKS) if len(x) < len(c) else none, len(more), len(less)
    gap = t * union - both
    need = math.ceil((gap - t * shorter) / (1 + t) - slip)
    if need >= 1:
        return False, gap / t, mixed(more[: max(0, len(more) - need + 1)]), none, len(more), len(less)
    return False, gap / t, mixed(more), mixed(less[: max(0, len(less) - max(1, math.ceil(gap - slip)) + 1)] ^ LACKS), len(more), len(less)


JUDGED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("gap", pa.float64()), ("more", pa.list_(pa.int64())), ("less", pa.list_(pa.int64())), ("adds", pa.int32()), ("lacks", pa.int32())])


def _judged(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "held_b", 256):
                found = []
                for c, x, shorter in zip(part.column("held_a"), part.column("held_b"), part.column("shorter").to_pylist(), strict=True):
                    c, x = (np.frombuffer(v.as_buffer(), U64) for v in (c, x))
                    found.append(judged(c, x, percent, shorter))
                linked, gap, more, less, adds, lacks = zip(*found, strict=True) if found else ((),) * 6
                yield batch(JUDGED, a=part.column("a"), b=part.column("b"), linked=linked, gap=gap, more=[e.view(np.int64) for e in more], less=[e.view(np.int64) for e in less], adds=adds, lacks=lacks)

    return run


def judged_pairs(pairs: DataFrame, documents: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """JUDGED of the pairs (a, b, shorter) of ids, from their full sets. Texts meet ids in a
    sort-merge join at every size."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    held, path = written(documents.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(lean(_sets), "doc_id long, held binary"), "sets")
    one, two = (held.select(F.col("doc_id").alias(k), F.col("held").alias(f"held_{k}")) for k in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "shorter", "held_a", "held_b")
    out, out_path = written(both.mapInArrow(lean(_judged(percent)), "a long, b long, linked boolean, gap double, more array<long>, less array<long>, adds int, lacks int"), "judged")
    removed(pairs.sparkSession, path)
    return out, out_path


def shared_buckets(rows: DataFrame) -> DataFrame:
    """Rows (bucket, rep, n, linked) of buckets that hold two ids or more and one that does not link, with their size."""
    of = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("least"), F.max("rep").alias("most"), F.min("linked").alias("linked_all"))
    return rows.join(of.where("size > 1 and least < most and not linked_all").select("bucket", "size"), "bucket")


def near_duplicates(documents: DataFrame, percent: int = 80, bands: int = BANDS, band_rows: int = BAND_ROWS, seed: int = 6) -> DataFrame:
    """Components of documents (doc_id long, text string; other columns are left out)
    whose shingle sets have 100 * intersection >= percent * union.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer than
    five words is one shingle; one without words, or null, has none and links with nothing.
    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id that
    links reach, itself included), kept (doc_id = component_id). Rows that share a doc_id
    count as one node; a null doc_id is in no component with others: component_id is null
    and it is kept. Copies give as many rows as came in; an empty table gives none.
    """
    spark = documents.sparkSession
    shipped(spark)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed, _ = written(own.mapInArrow(lean(_signed(bands, band_rows, seed)), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "signed")
    sets = (
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    trail: list[str] = []
    banded, path = written(sets.select(F.explode("bands").alias("bucket"), "rep", "n", F.lit(False).alias("linked")), "banded")
    trail.append(path)
    members, path = written(shared_buckets(banded), "members")
    trail.append(path)
    edges = banded.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    for _ in range(ROUNDS):
        # The centre of a bucket is the member that meets most others.
        degree = members.groupBy("rep").agg(F.sum("size").alias("degree"))
        ranked = members.join(degree, "rep")
        centres = ranked.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("rep")).alias("minus"), "n")).alias("c")).select("bucket", (-F.col("c.minus")).alias("a"), F.col("c.n").alias("size_a"))
        routes = members.join(centres, "bucket").where("rep != a")
        routes, path = written(routes.select("a", F.col("rep").alias("b"), "n", (F.col("size_a") - F.col("n")).alias("shorter")).distinct(), "routes")
        trail.append(path)
        most = routes.groupBy("a").agg(F.greatest(F.max("shorter"), F.lit(0)).alias("shorter"))
        found, path = judged_pairs(routes.select("a", "b").distinct().join(most, "a"), own, percent)
        trail.append(path)
        edges = edges.union(found.where("linked").select("a", "b"))
        # Elements that c has and x lacks only bring together x smaller than c, and y that such an x may link to.
        nearest = found.groupBy("a").agg(F.min(F.when(~F.col("linked"), F.col("gap"))).alias("nearest")).where("nearest is not null")
        dealt = routes.join(found, ["a", "b"]).join(nearest, "a")
        less = F.when(~F.col("linked") | (F.col("shorter") >= F.col("nearest")), F.col("less")).otherwise(F.array().cast("array<bigint>"))
        dealt = dealt.select("a", F.col("b").alias("rep"), "n", "linked", "gap", "shorter", "adds", "lacks", F.explode(F.concat(F.transform("more", lambda e: F.struct(F.lit(True).alias("more"), e.alias("e"))), F.transform(less, lambda e: F.struct(F.lit(False).alias("more"), e.alias("e"))))).alias("d"))
        dealt = dealt.select(F.xxhash64("a", "d.e").alias("bucket"), "rep", "n", "linked", "gap", "shorter", "adds", "lacks", F.col("d.more").alias("more"))
        members, path = written(shared_buckets(dealt), "members")
        trail.append(path)
        if empty(members):
            break
    else:
        sides = [members.select("bucket", *[F.col(c).alias(f"{c}_{k}") for c in ("rep", "n", "linked", "gap", "shorter", "more", "adds", "lacks")]) for k in "xy"]
        reach = F.col("more_x") | (F.col("shorter_x") >= F.col("gap_y")) | (~F.col("linked_x") & (F.col("shorter_y") >= F.col("gap_x")))
        sized = (F.col("n_x") * 100 >= F.col("n_y") * percent) & (F.col("n_y") * 100 >= F.col("n_x") * percent)
        # What x and y must share beside the centre, of what they can.
        t = percent / 100
        reach &= F.least("adds_x", "adds_y") + F.least("lacks_x", "lacks_y") >= (F.col("lacks_x") + t * F.col("adds_x") + t * F.col("gap_y")) / (1 + t) - 1e-9
        once = ~F.col("linked_y") & (F.col("linked_x") | (F.col("rep_x") < F.col("rep_y"))) & (F.col("rep_x") != F.col("rep_y"))
        pairs = sides[0].join(sides[1], "bucket").where(once & reach & sized)
        pairs, path = written(pairs.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"), F.lit(0).alias("shorter")).distinct(), "pairs")
        trail.append(path)
        found, path = judged_pairs(pairs, own, percent)
        trail.append(path)
        edges = edges.union(found.where("linked").select("a", "b"))
    labels = with_components(edges)
    removed(spark, *trail)
    reps = sets.select("k1", "k2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    whole = signed.select("doc_id", "n_shingles", "k1", "k2").join(reps, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
