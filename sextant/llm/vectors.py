"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are turned onto the principal axes, ordered by the first and cut into tiles of
bounded bytes. Two tiles are compared only where their ranges on the first axis are near
enough for the threshold and their boxes on the leading axes, with the longest of their
remainders, let a pair reach it. Within a pair of tiles the leading coordinates are multiplied
first; the norms of the rest of each vector bound what the rest of the product can add, so
most pairs stop there, and those left go through more coordinates and then through the
whole cosine, in double precision and of the vectors as they came.

A tile's partners stream past it, so one tile and one partner are held at a time. A pair of
tiles gives each vector's number of links and a spanning forest of the links, never the links
themselves; equal vectors, as far as direction goes, are one vector with a weight. Vectors are
scaled by their largest component first, so no square leaves the range of doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import lean, removed, with_components, written
from sextant.session import shipped

#: Bytes of a tile's vectors in double precision.
TILE_BYTES = 4 << 20
#: Bytes of the vectors that the axes are fitted to. Only speed depends on the axes.
FIT_BYTES = 4 << 20
#: Coordinates after which a pair's product is bounded; tiles have boxes on the first of them.
STEPS = (16, 32)
#: What single precision and the turn may be off by.
SLACK = 1e-4
#: Partners that stream past one copy of a tile.
STREAM = 64

TILES = "k long, dim int, nodes binary, weights binary, raw binary, lo array<double>, hi array<double>, rest double"


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of their component, where that is another, under the links (i, j) among n nodes."""
    labels = np.arange(n)
    while True:
        least = np.minimum(labels[i], labels[j])
        now = labels.copy()
        for ends in (i, j, labels[i], labels[j]):
            np.minimum.at(now, ends, least)
        now = now[now]
        if (now == labels).all():
            break
        labels = now
    nodes = np.flatnonzero(labels != np.arange(n))
    return nodes, labels[nodes]


def linked(a: dict, b: dict, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of a, of b) of the pairs at `threshold` or above, in turns; of one tile with itself, each pair once."""
    dim = a["raw"].shape[1]
    steps = [k for k in STEPS if k < dim]

    def ends(x: dict) -> list[np.ndarray]:
        rest = np.sqrt(np.maximum(0, (x["turned"][:, ::-1] ** 2).cumsum(axis=1)[:, ::-1]))
        return [rest[:, k : k + 1] for k in steps]

    rest_a, rest_b = ends(a), ends(b)
    first = steps[0] if steps else dim
    lead_b = np.hstack([b["turned"][:, :first], *rest_b[:1]]).astype(np.float32).T
    norm_a, norm_b = (np.sqrt(np.einsum("ij,ij->i", x["raw"], x["raw"])) for x in (a, b))
    height = max(1, (2 << 20) // max(1, lead_b.shape[1]))
    for at in range(0, len(a["raw"]), height):
        rows = slice(at, at + height)
        bound = np.hstack([a["turned"][rows, :first], *[r[rows] for r in rest_a[:1]]]).astype(np.float32) @ lead_b
        flat = np.flatnonzero(bound.ravel() >= threshold - SLACK)
        i, j = np.divmod(flat, bound.shape[1])
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for cut in range(0, len(i), 1 << 16):
            x, y = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
            for k, ra, rb in list(zip(steps, rest_a, rest_b, strict=True))[1:]:
                reach = np.einsum("ij,ij->i", a["turned"][x, :k], b["turned"][y, :k]) + ra[x, 0] * rb[y, 0]
                x, y = x[reach >= threshold - SLACK], y[reach >= threshold - SLACK]
            cosine = np.einsum("ij,ij->i", a["raw"][x], b["raw"][y]) / (norm_a[x] * norm_b[y])
            x, y = x[cosine >= threshold], y[cosine >= threshold]
            if len(x):
                yield x, y


def turned_to(axes: np.ndarray | None, raw: np.ndarray) -> np.ndarray:
    unit = raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
    return unit if axes is None else unit @ axes


def _tile(part: pa.RecordBatch, k: int, axes: dict[int, np.ndarray]) -> dict:
    dim = part.column("dim")[k].as_py()
    nodes, weights = (np.frombuffer(part.column(c)[k].as_buffer(), np.int64) for c in ("nodes", "weights"))
    raw = np.frombuffer(part.column("raw")[k].as_buffer(), np.float64).reshape(-1, dim)
    return {"nodes": nodes, "weights": weights, "raw": raw, "turned": turned_to(axes.get(dim), raw)}


def _links(a: dict, b: dict, same: bool, threshold: float) -> pa.RecordBatch:
    """What a pair of tiles tells: (a, b, degree) of nodes, a = b where only the degree counts."""
    shift = 0 if same else len(a["nodes"])
    nodes = a["nodes"] if same else np.concatenate((a["nodes"], b["nodes"]))
    weights = a["weights"] if same else np.concatenate((a["weights"], b["weights"]))
    degree = np.zeros(len(nodes), np.int64)
    ends, roots = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in linked(a, b, same, threshold):
        j = j + shift
        degree += np.bincount(i, weights[j], len(nodes)).astype(np.int64) + np.bincount(j, weights[i], len(nodes)).astype(np.int64)
        end, root = forest(i, j, len(nodes))
        ends.append(end)
        roots.append(root)
    end, root = forest(np.concatenate(ends), np.concatenate(roots), len(nodes))
    has = np.flatnonzero(degree)
    made = [np.concatenate((nodes[has], nodes[end])), np.concatenate((nodes[has], nodes[root])), np.concatenate((degree[has], np.zeros(len(end), np.int64)))]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["a", "b", "degree"])


def _compared(threshold: float, axes: dict[int, np.ndarray]):
    """Rows of each (a, stream): the tile a itself first (b is null), then its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for part in batches:
            for k in range(part.num_rows):
                if part.column("b")[k].as_py() is None:
                    now = _tile(part, k, axes)
                    if part.column("stream")[k].as_py() == 0:
                        yield _links(now, now, True, threshold)
                else:
                    yield _links(now, _tile(part, k, axes), False, threshold)

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _turned(axes: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            dims = part.column("dim").to_numpy()
            for dim in np.unique(dims):
                some = part.filter(pa.array(dims == dim))
                raw = _matrix(some.column("v"), int(dim))
                first = turned_to(axes.get(int(dim)), raw)[:, 0].copy()
                yield pa.RecordBatch.from_arrays(
                    [some.column("dim"), some.column("node"), some.column("weight"), pa.array(first), pa.array([x.tobytes() for x in raw], pa.binary())], names=["dim", "node", "weight", "first", "raw"]
                )

    return run


def _tiled(tile_bytes: int, axes: dict[int, np.ndarray]):
    """Rows in order of (dim, first), within one `range`, to tiles of about `tile_bytes` at most; k is a tile's number, in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            whole = b"".join(raw)
            turned = turned_to(axes.get(dim), np.frombuffer(whole, np.float64).reshape(-1, dim))
            lead, rest = turned[:, : STEPS[0]], turned[:, STEPS[0] :]
            values = [k, dim, np.array(nodes).tobytes(), np.array(weights).tobytes(), whole, lead.min(axis=0).tolist(), lead.max(axis=0).tolist(), float(np.sqrt((rest**2).sum(axis=1)).max())]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3, *[pa.list_(pa.float64())] * 2, pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[f.split()[0] for f in TILES.split(", ")])

        k, dim, nodes, weights, raw = None, None, [], [], []
        for rows in batches:
            for range_, of, node, weight, x in zip(*(rows.column(c).to_pylist() for c in ("range", "dim", "node", "weight", "raw")), strict=True):
                k = range_ << 32 if k is None else k
                if nodes and (of != dim or len(nodes) * dim * 8 >= tile_bytes):
                    yield flushed()
                    k, nodes, weights, raw = k + 1, [], [], []
                dim = of
                nodes.append(node)
                weights.append(weight)
                raw.append(x)
        if nodes:
            yield flushed()

    return run


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the tiles (k, dim, lo, hi, rest) that may hold a pair at `threshold`, a before b.

    Tiles stand in order of the first axis, so the partners of one begin where it does or after,
    and not farther from its end than a pair at `threshold` may be: each tile is dealt to
    the cells of the axis that its partners may begin in, and meets them there.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    width = max(reach / 16, 1e-3)
    spans = tiles.select("k", "dim", "lo", "hi", "rest")
    one = spans.select("dim", *[F.col(c).alias(f"{c}_a") for c in ("k", "lo", "hi", "rest")])
    one = one.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo_a")[0] / width), F.floor((F.col("hi_a")[0] + reach) / width))))
    two = spans.select("dim", *[F.col(c).alias(f"{c}_b") for c in ("k", "lo", "hi", "rest")], F.floor(F.col("lo")[0] / width).alias("cell"))
    sides = F.arrays_zip(*[F.col(f"{c}_{e}").alias(f"{c}_{e}") for e in "ab" for c in ("lo", "hi")])
    most = F.aggregate(sides, F.lit(0.0), lambda t, x: t + F.greatest(*[x[f"{p}_a"] * x[f"{q}_b"] for p in ("lo", "hi") for q in ("lo", "hi")]))
    near = (F.col("k_a") < F.col("k_b")) & (F.col("lo_b")[0] <= F.col("hi_a")[0] + reach)
    return one.join(two, ["dim", "cell"]).where(near & (most + F.col("rest_a") * F.col("rest_b") >= threshold - SLACK)).select(F.col("k_a").alias("a"), F.col("k_b").alias("b"))


def near_vectors(embeddings: DataFrame, threshold: float = 0.9, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Components of vectors (vec_id long, embedding array of numbers; other columns are left
    out) that link at cosine `threshold` (over 0) or above.

    Returns one row per input row: vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id that links reach, itself included), kept (vec_id =
    component_id). Vectors that are null, empty, all zero or hold null or non-finite
    components link with nothing, and neither do rows without a vec_id (component_id null,
    kept). Vectors of different lengths do not link. Equal vectors, repeated rows included,
    link with each other; rows that share a vec_id are vectors of their own, with links and
    component of their own. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    shipped(spark)

    # As lambdas' arguments the vector and its largest component are made once for a row.
    def scaled(v: Column) -> Column:
        sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull()
        return F.when(sound, F.transform(F.array(F.array_max(F.transform(v, F.abs))), lambda most: F.transform(v, lambda x: x / most + F.lit(0.0)))[0])

    vector = F.transform(F.array(F.col("embedding").cast("array<double>")), scaled)[0]
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v"))
    own = own.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    distinct = own.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    distinct, distinct_path = written(distinct.withColumns({"dim": F.size("v"), "node": F.monotonically_increasing_id()}), "vectors")
    trail = [distinct_path]

    axes: dict[int, np.ndarray] = {}
    dims = distinct.groupBy("dim").agg(F.count("*").alias("n"))
    for dim in [r.dim for r in dims.orderBy(F.desc("n"), "dim").limit(16).collect()]:  # rarer lengths stay on the axes they have
        rows = distinct.where(F.col("dim") == dim).orderBy("h1", "h2").limit(max(64, FIT_BYTES // (8 * dim))).select("v").collect()
        raw = np.array([r.v for r in rows])
        unit = raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
        axes[dim] = np.linalg.eigh(unit.T @ unit)[1][:, ::-1].copy()
    turned, path = written(distinct.select("dim", "node", "weight", "v").mapInArrow(lean(_turned(axes)), "dim int, node long, weight long, first double, raw binary"), "turned")
    trail.append(path)

    size = dims.agg(F.coalesce(F.sum(F.col("n") * F.col("dim") * 8), F.lit(0))).first()[0]
    ordered = turned.repartitionByRange(max(1, -(-size // tile_bytes)), "dim", "first", "node").sortWithinPartitions("dim", "first", "node").withColumn("range", F.spark_partition_id().cast("long"))
    tiles, path = written(ordered.mapInArrow(lean(_tiled(tile_bytes, axes)), TILES), "tiles")
    trail.append(path)
    pairs, path = written(tile_pairs(tiles, threshold), "pairs")
    trail.append(path)

    # Each tile once for every STREAM of its partners or so, ahead of them.
    streams = pairs.groupBy("a").agg(F.ceil(F.count("*") / STREAM).alias("n"))
    partners = pairs.join(streams, "a").select("a", F.pmod(F.xxhash64("b"), "n").alias("stream"), "b")
    columns = ("dim", "nodes", "weights", "raw")
    heads = tiles.join(streams, F.col("k") == F.col("a"), "left").select(F.col("k").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("n", F.lit(1)) - 1)).alias("stream"), F.lit(None).cast("long").alias("b"), *columns)
    rest = partners.join(tiles, F.col("b") == F.col("k")).select("a", "stream", "b", *columns)
    passing = heads.unionByName(rest).repartition("a", "stream").sortWithinPartitions("a", "stream", F.asc_nulls_first("b"))
    found, path = written(passing.mapInArrow(lean(_compared(threshold, axes)), "a long, b long, degree long"), "links")
    trail.append(path)

    degrees = found.groupBy(F.col("a").alias("node")).agg(F.sum("degree").alias("degree"))
    labels = with_components(found.where("a != b").select("a", "b"))
    least = labels.join(distinct.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    classes = distinct.select("h1", "h2", "node", "rep", "weight").join(degrees, "node", "left").join(labels.join(least, "component").select("node", "least"), "node", "left")
    classes = classes.select("h1", "h2", (F.coalesce("degree", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    classes, _ = written(classes, "classes")
    removed(spark, *trail)
    out = own.select("vec_id", "h1", "h2", F.col("v").isNotNull().alias("sound")).join(classes, ["h1", "h2"], "left")
    return out.select(
        "vec_id", F.when(F.col("sound"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
