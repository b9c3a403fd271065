"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

The corpus is cut into blocks of equal tokens, source by source, in a seeded order of the
documents. The blocks of the mix are given to the sources one by one, always to the one of
highest quotient target / (2 * blocks so far + 1): that is rounding target / divisor for the
divisor at which the counts add up, so the counts are found by rounding near it and then
moving the few seats that are too many or too few by their quotients. Seats go round the
output shards, which so get integer quotas of each source, before any block is chosen.

Blocks are chosen by these quotas. A keyed permutation of a source's blocks, the swap-or-not
shuffle, gives each block a number p of its own below their number n, so no block is sorted or
even listed; when a source is gone through for the k-th time, the block stands for seat k * n + p
of the source. Every `shards`-th seat is one shard's, so seat t is the shard's (t / shards)-th,
and is taken if the shard's quota of the source is larger than that. A document takes the words
of its blocks.

Words before a document in its source come from counts of hashed buckets, summed over the
buckets in two steps, and a window within each; no source is gathered into one task. Windows
without a key stand over the sources only, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import Door, quoted, removed, word_count, written

BLOCK = 32
SHARDS = 16
#: Documents that a bucket holds about.
BUCKET_ROWS = 2000
#: Rounds of the swap-or-not shuffle, and the prime its bits are hashed by.
SWAPS = 12
PRIME = (1 << 31) - 1


def swaps(source: Column, n: Column, seed: int) -> Column:
    """Keys of the rounds of a source's permutation of 0 to n - 1."""

    def number(digest: Column, at: int, digits: int) -> Column:
        return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")

    named = F.concat(F.coalesce(source.cast("string"), F.lit("")), F.when(source.isNull(), ":").otherwise(""))
    digests = F.transform(F.sequence(F.lit(1), F.lit(SWAPS)), lambda r: F.md5(F.concat(F.lit(f"{seed}:"), r.cast("string"), F.lit(":"), named)))
    return F.transform(digests, lambda d: F.struct((number(d, 1, 12) % n).alias("k"), (number(d, 13, 7) + 1).alias("a"), number(d, 20, 7).alias("c"), number(d, 27, 6).alias("b")))


def permuted(j: Column, keys: Column, n: Column) -> Column:
    """Where the permutation takes j: in each round it goes to (k - j) mod n and back or stays, as a bit of the pair says."""

    def moved(x: Column, r: Column) -> Column:
        to = (r["k"] - x + n) % n
        most = F.greatest(x, to)
        bit = (most % PRIME * r["a"] + F.floor(most / PRIME) * r["c"] + r["b"]) % PRIME % 2
        return F.when(bit == 1, to).otherwise(x)

    return F.aggregate(keys, j, moved)


def shares(sources: DataFrame, size: str, weights: list[float], limit: float) -> DataFrame:
    """`sources` (source, `size`) and its weight and target: the sum of sizes shared by weight,
    none above `limit` times its size, the excess reshared by weight until none is above.

    Weights repeat in order of the sources by code point, null last. The sources above their
    limit are those of least limit per weight, so one pass in that order settles all.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("most", F.col(size) * F.lit(limit))
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum(size).over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    # The first source within its limit sets the level of all after it.
    stays = F.col("most") / F.col("weight") >= F.col("level")
    ranked = ranked.withColumn("level", F.first(F.when(stays, F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.withColumn("target", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))).drop("level", "most")


def apportioned(targets: DataFrame, votes: str) -> DataFrame:
    """`targets` (source, target, `votes`: seats of all) and the quota of each source, by Sainte-Lague.

    Ties of quotients go by source. The rounding at the mean divisor is off by at most one
    seat for two sources; the seats moved are looked for among as many of each source as
    could change hands.
    """
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rounded = targets.withColumns({"sum": F.sum("target").over(whole), "seats": F.col(votes).cast("long")})
    rounded = rounded.withColumn("first", F.when(F.col("sum") > 0, F.floor(F.col("target") / F.col("sum") * F.col("seats") + 0.5)).otherwise(F.lit(0)).cast("long"))
    rounded = rounded.withColumn("lack", F.col("seats") - F.sum("first").over(whole)).withColumn("n", F.count("*").over(whole))
    rounded = rounded.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    moves = F.ceil(F.col("target") / F.col("sum") * (F.abs("lack") + F.col("n"))).cast("long") + 1
    up = F.sequence(F.col("first"), F.col("first") + moves - 1)  # seat numbers from 0: seat k has quotient target / (2k + 1)
    down = F.sequence(F.greatest(F.lit(0).cast("long"), F.col("first") - moves), F.col("first") - 1)
    none = F.array().cast("array<bigint>")
    seat = F.when((F.col("sum") > 0) & (F.col("lack") > 0) & (F.col("target") > 0), up).when((F.col("sum") > 0) & (F.col("lack") < 0) & (F.col("first") > 0), down).otherwise(none)
    listed = rounded.select("source", "place", "target", "lack", F.explode(seat).alias("seat"))
    quotient = F.col("target") / (2 * F.col("seat") + 1)
    # Seats are added from the highest quotient on and taken back from the lowest, in ties from the last source.
    toward = F.when(F.col("lack") > 0, F.lit(1)).otherwise(F.lit(-1))
    best = Window.orderBy(-toward * quotient, toward * F.col("place"), toward * F.col("seat"))
    moved = listed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.abs("lack")).groupBy("source").agg(F.sum(F.signum(F.col("lack").cast("double"))).cast("long").alias("moved"))
    joined = rounded.alias("r").join(moved.alias("m"), F.col("r.source").eqNullSafe(F.col("m.source")), "left")
    return joined.select("r.*", (F.col("first") + F.coalesce("moved", F.lit(0))).alias("quota")).drop("sum", "seats", "first", "lack", "n", "place")


def seated(plan: DataFrame) -> DataFrame:
    """`plan` and before: the seats of the sources before a source."""
    before = F.sum("quota").over(Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1))
    return plan.withColumn("before", F.coalesce(before, F.lit(0)).cast("long"))


def shard_quotas(plan: DataFrame, shards: int) -> DataFrame:
    """source, shard, quota: the seats of all sources, one after the other, dealt round the shards."""
    dealt = seated(plan).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    upto = lambda n: F.floor((n - F.col("shard") + shards - 1) / shards)  # noqa: E731  seats below n that this shard has
    return dealt.select("source", "shard", (upto(F.col("before") + F.col("quota")) - upto(F.col("before"))).cast("long").alias("quota"))


MADE = ("mix_size", "mix_source_size", "mix_target", "mix_rounds", "mix_spans", "mix_taken", "mix_dealt")


def mixed_sources(
    documents: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3, block: int = BLOCK, seed: int = 4, bucket_rows: int = BUCKET_ROWS, shards: int = SHARDS
) -> tuple[DataFrame, DataFrame]:
    """The mix of `documents` (doc_id, text, source; other columns stay) and its plan.

    The rows come back with mix_size (words; a null text has none), mix_source_size,
    mix_target (of the source), mix_rounds (how often the whole document is taken), mix_spans
    (the runs of words [s, e) taken once more), mix_taken (words the mix takes, repeats
    counted) and mix_dealt (the runs of words [s, e) taken, those of whole documents too, each
    with its block's seat, the shard whose quota it is of, and the turn of the source; a block
    that reaches over documents is in each). By `shard_quotas`, a shard holds as many seats of
    each source. The plan has, of each source: source, size, weight, target, quota (blocks).

    Words are runs of anything but ASCII white space. Sources stand in code point order, null
    last, and weigh `weights`, repeating. The mix is as large as the corpus, no source above
    `limit` times its size; a source's taken words differ from its target by a block, and by what
    its last block lacks of `block` words each time that is taken. Repeated rows each have a place
    of their own; places of rows of one doc_id and size are as good as each other. Where there
    are no words, targets are 0. No rows give none. A column that has one of the seven names
    comes back with `_input` added.
    """
    door = Door(documents, MADE)
    ids, text, source = (F.col(door.of(c)) for c in ("doc_id", "text", "source"))
    sized = door.rows.withColumns({"doc_id": ids, "source": source, "mix_size": word_count(text.cast("string")), "mix_key": F.md5(F.concat_ws(":", F.lit(str(seed)), ids.cast("string")))})
    light, light_path = written(sized.select("source", "mix_size", "mix_key"), "sizes")
    digits, n = 1, light.count()
    while 16**digits * bucket_rows < n:
        digits += 1
    bucket = F.substring("mix_key", 1, digits)
    counted, _ = written(light.groupBy("source", bucket.alias("bucket")).agg(F.sum("mix_size").alias("size")), "buckets")
    removed(door.spark, light_path)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plan = shares(counted.groupBy("source").agg(F.sum("size").alias("size")), "size", list(weights), limit)
    plan = plan.withColumn("votes", F.floor(F.sum("size").over(whole) / block + 0.5))
    plan = apportioned(plan, "votes").withColumn("n_blocks", F.ceil(F.col("size") / block).cast("long"))
    plan = plan.withColumn("quota", F.least("quota", F.floor(F.col("n_blocks") * limit))).drop("votes")
    plan, _ = written(plan, "plan")

    # What each shard is to hold of each source, before blocks are chosen.
    quotas = shard_quotas(plan, shards).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("q")).select(F.col("source").alias("qs"), F.col("q.quota").alias("quotas"))
    facts = seated(plan).where("n_blocks > 0").join(quotas, F.col("source").eqNullSafe(F.col("qs")))
    facts = facts.select(F.col("source").alias("ps"), "n_blocks", "before", F.floor(F.col("quota") / F.col("n_blocks")).cast("long").alias("rounds"), "quotas", swaps(F.col("source"), F.col("n_blocks"), seed).alias("keys"))
    sizes = plan.select(F.col("source").alias("zs"), F.col("size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    # Words before a bucket: those before its part of the source, and those before it there.
    coarse = F.substring("bucket", 1, (digits + 1) // 2)
    earlier = lambda *by: Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy("source", coarse.alias("at")).agg(F.sum("size").alias("size"))
    parts = parts.select(F.col("source").alias("cs"), F.col("at").alias("part"), F.coalesce(F.sum("size").over(earlier("source")), F.lit(0)).alias("part_ahead"))
    fine = counted.select("source", coarse.alias("own_part"), F.col("bucket").alias("at"), "size").withColumn("ahead", F.coalesce(F.sum("size").over(earlier("source", "own_part")), F.lit(0)))
    fine = fine.join(parts, F.col("source").eqNullSafe(F.col("cs")) & (F.col("own_part") == F.col("part")))
    offsets, _ = written(fine.select(F.col("source").alias("os"), F.col("at").alias("ob"), (F.col("ahead") + F.col("part_ahead")).alias("ahead")), "offsets")

    inner = Window.partitionBy("source", "mix_bucket").orderBy("mix_key", "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    # A number of partitions that stays, as what follows costs time and not bytes.
    dealt_out = sized.withColumn("mix_bucket", bucket).repartition(int(door.spark.conf.get("spark.sql.shuffle.partitions")), "source", "mix_bucket")
    placed = dealt_out.withColumn("mix_at", F.coalesce(F.sum("mix_size").over(inner), F.lit(0)))
    same = lambda other: F.col("source").eqNullSafe(F.col(other))
    placed = placed.join(offsets, same("os") & (F.col("mix_bucket") == F.col("ob")), "left").join(sizes, same("zs"), "left").join(facts, same("ps"), "left")
    at, size = F.col("mix_at") + F.col("ahead"), F.col("mix_size")
    blocks = F.when(size > 0, F.sequence(F.floor(at / block), F.floor((at + size - 1) / block))).otherwise(F.array().cast("array<bigint>"))

    def seats(j: Column, p: Column) -> Column:
        """The seats that block j, of number p, stands for and that its shard's quota takes."""
        run = (F.greatest(j * block - at, F.lit(0)).cast("int").alias("s"), F.least((j + 1) * block - at, size).cast("int").alias("e"))
        seat = lambda k: k * F.col("n_blocks") + p
        shard = lambda t: (F.col("before") + t) % shards
        taken = F.filter(F.sequence(F.lit(0).cast("long"), F.col("rounds")), lambda k: F.floor(seat(k) / shards) < F.element_at("quotas", (shard(seat(k)) + 1).cast("int")))
        return F.transform(taken, lambda k: F.struct(shard(seat(k)).cast("int").alias("shard"), (F.col("before") + seat(k)).alias("seat"), k.alias("turn"), *run))

    # As a lambda's argument a block's number is made once, not once for a turn.
    dealt = F.flatten(F.transform(blocks, lambda j: F.flatten(F.transform(F.array(permuted(j, F.col("keys"), F.col("n_blocks"))), lambda p: seats(j, p)))))
    placed = placed.withColumns({"mix_rounds": F.coalesce("rounds", F.lit(0)).cast("long"), "mix_dealt": dealt})
    spans = F.transform(F.filter("mix_dealt", lambda x: x["turn"] == F.col("mix_rounds")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    taken = F.aggregate("mix_dealt", F.lit(0).cast("long"), lambda t, x: t + x["e"] - x["s"])
    made = [F.col(c) for c in MADE[:4]]
    return door.out(placed, *made, spans.alias("mix_spans"), taken.alias("mix_taken"), F.col("mix_dealt")), plan.drop("n_blocks")


def copies(mix: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of the rows of `mixed_sources`, text among them: each document as often as it is taken whole, and once more the words of its spans."""
    pieces = F.regexp_extract_all(F.regexp_replace(F.col("text"), r"^[\x20\x09-\x0D]+", ""), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    # As a lambda's argument the pieces are made once for a row, not once for a span.
    part = F.transform(F.array(pieces), lambda p: F.array_join(F.flatten(F.transform("mix_spans", lambda x: F.slice(p, x["s"] + 1, x["e"] - x["s"]))), ""))[0]
    texts = F.concat(F.array_repeat("text", F.col("mix_rounds").cast("int")), F.when(F.size("mix_spans") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    made = mix.withColumn("mix_text", F.explode(texts))
    return made.select(*[F.col("mix_text").alias(c) if c == "text" else quoted(c) for c in columns])


def digested(mix: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of the rows of `mixed_sources`."""
    return mix.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))
