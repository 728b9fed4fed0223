"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

1. Weights become targets in words; a target stops at ``most`` times its source.
2. Each source's documents stand in a permuted order, cut into blocks of equally many
   words: unless ``block_words`` is given, a source has some 64 blocks a shard, and 1024 at
   least, however small or large it is. Whole passes take all blocks, the last pass takes
   the blocks up to the rest of the target. This fixes every source's quota of blocks.
3. A binary tree over the output shards splits the quotas: each node draws how many
   of every source's blocks go left, without replacement (multivariate
   hypergeometric), until a leaf holds one shard's count per source.
4. Shards draw disjoint runs of the permuted blocks, and rows are shuffled in the shard.
   A document is taken as often as a shard has drawn the block that it stands in.

Only one row per source and shard passes through the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions.running import running_total
from clauselake.session import discard, stored

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], most: int) -> DataFrame:
    """``source, source_size`` -> plus ``weight`` and ``target``.

    Weights repeat along the sources by code point, null last. Targets share the sum of
    all sizes; those above ``most`` times their source stop there and the excess goes to
    the others by weight. Sources stop in the order of size per weight, so the stopping
    ones are a prefix of that order: the first source that stays below its limit when
    all before it have stopped ends the prefix.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    named = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("long"))
    order = [F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    stood = named.select(
        "*",
        F.row_number().over(Window.orderBy(*order)).alias("_place"),
        (
            F.sum("source_size").over(whole)
            - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
        ).alias("_rest"),
        (
            F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
        ).alias("_open"),
    )
    stays = F.col("weight") * F.col("_rest") <= most * F.col("source_size") * F.col("_open")
    first = F.min(F.when(stays, F.col("_place"))).over(whole)
    at = stood.withColumn("_first", first)
    for c in ("_rest", "_open"):
        at = at.withColumn(
            c, F.max(F.when(F.col("_place") == F.col("_first"), F.col(c))).over(whole)
        )
    target = F.when(
        F.col("_place") < F.col("_first"), (most * F.col("source_size")).cast("double")
    ).otherwise((F.col("weight") * F.col("_rest")).cast("double") / F.col("_open"))
    return at.select("source", "source_size", "weight", target.alias("target"))


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard: shape (shards, sources), columns sum to quotas.

    Every draw is exact; more than a billion blocks in all are refused.
    """
    if sum(quotas) >= 1_000_000_000:
        raise ValueError("the sampler draws from up to a billion blocks: make them larger")
    counts = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(lo: int, hi: int, held: np.ndarray) -> None:
        if hi - lo == 1:
            counts[lo] = held
            return
        mid = (lo + hi) // 2
        name = hashlib.sha256(f"{seed}:{lo}:{hi}".encode()).digest()
        rng = np.random.Generator(np.random.PCG64(int.from_bytes(name[:8], "little")))
        total = int(held.sum())
        draws = total * (mid - lo) // (hi - lo)
        left = np.zeros_like(held)
        rest, open_ = draws, total
        for i, held_i in enumerate(held.tolist()):
            others = open_ - held_i  # a draw from source i against all later ones
            if rest and held_i:
                left[i] = rng.hypergeometric(held_i, others, rest)
            rest -= int(left[i])
            open_ = others
        split(lo, mid, left)
        split(mid, hi, held - left)

    split(0, shards, np.asarray(quotas, dtype=np.int64))
    return counts


def mix(
    docs: DataFrame,
    weights: list[int],
    most: int = 3,
    shards: int = 64,
    block_words: int | None = None,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, draws``.

    ``draws`` has an entry ``(pass, shard, shuffle_key)`` for each time the document is
    taken; it is empty for those left out. Sizes count words. A null text or one without
    words has size 0 and goes along with its block. A null source is a source of its own,
    null ids are kept, repeated rows are rows of their own (equal ones interchangeable).
    Other columns are not carried. An empty table gives an empty table.
    """
    if most < 1 or shards < 1 or min(weights) < 1 or (block_words is not None and block_words < 1):
        raise ValueError("most, shards, block_words and weights must be positive")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string"))).alias("perm"),
    )
    # the ranges sample their input first: counted words are stored, so texts are read once
    shelf: list[str] = []
    placed = running_total(
        stored(rows, "sizes", shelf), ["source"], ["perm", "doc_id", "size"], F.col("size"), "upto"
    ).withColumn("before", F.col("upto") - F.col("size"))
    discard(docs.sparkSession, shelf)  # the running total stands on its checkpoint
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, most).select(
        "*",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0)
        .cast("long")
        .alias("passes"),
    )
    plan = plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    each = F.lit(block_words) if block_words else F.ceil(F.col("source_size") / max(1024, 64 * shards))
    plan = plan.withColumn("words", F.greatest(F.lit(1), each).cast("long"))
    plan = plan.withColumns(
        {c: F.floor(F.col(of) / F.col("words")).cast("long") + 1 for c, of in (("blocks", "source_size"), ("last", "rest"))}
    )
    listed = plan.orderBy(F.col("source").isNull(), "source").collect()  # one row per source
    quotas = [r["passes"] * r["blocks"] + r["last"] for r in listed]
    spark = docs.sparkSession
    schema = (
        "source string, source_size long, target double, passes long, rest double, words long,"
        " blocks long, bounds array<long>"
    )
    ends = (
        np.cumsum(split_quotas(quotas, shards, seed), axis=0).T.tolist() if listed else []
    )
    per_source = spark.createDataFrame(
        [
            (*(r[c] for c in ("source", "source_size", "target", "passes", "rest", "words", "blocks")), end)
            for r, end in zip(listed, ends, strict=True)
        ],
        schema,
    ).withColumnRenamed("source", "_source")
    joined = placed.join(per_source, F.col("source").eqNullSafe(F.col("_source")))
    block = F.floor(F.col("before") / F.col("words")).cast("long")

    def draw(p: Column) -> Column:
        index = p * F.col("blocks") + block
        return F.struct(
            p.cast("int").alias("pass"),
            # the first shard whose draws reach beyond the block; none has drawn the blocks left out
            F.size(F.filter("bounds", lambda end: end <= index)).alias("shard"),
            F.xxhash64(F.lit(seed), "perm", p.cast("int")).alias("shuffle_key"),
        )

    # the last block of the last pass is taken up to the target
    reached = F.col("before") + F.col("size") / F.lit(2.0) <= F.col("rest")
    draws = F.filter(
        F.transform(F.sequence(F.lit(0).cast("long"), "passes"), draw),
        lambda d: (d["shard"] < shards) & ((d["pass"] < F.col("passes")) | reached),
    )
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", draws.alias("draws")
    )


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row per taken document, by shard in its local order."""
    taken = mixed.select("doc_id", "source", "size", F.explode("draws").alias("d"))
    return (
        taken.select("doc_id", "source", "size", "d.*")
        .repartitionByRange("shard", "shuffle_key")
        .sortWithinPartitions("shard", "shuffle_key")
    )
