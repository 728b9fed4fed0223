"""Near duplicates among vectors by sorted projection passes.

In each pass a vector gets a string of random-hyperplane bits, and the vectors of a
label are ordered by it. Neighbours in that order are compared in bounded windows: runs
of ``window`` places that overlap by ``halo``. Rows that share their first
``prefix_bits`` bits but lie in no single window are compared all the same, in pairs of
bounded blocks. Verified pairs of all passes are united into components. Links run
inside components only, so a second step counts every component's links exactly, again
in pairs of blocks: a component larger than the windows loses nothing.

Whatever the vectors, a pair at the threshold shares its first bits in one pass with a
known chance, which depends on its angle alone, and rows of equal prefix always meet; so
passes are added until the pair has met with probability ``recall``. Skewed vectors (a
cone) share prefixes in large numbers; pairs of blocks are made for those prefixes alone
that exceed a window. A label that fills no more than one window needs one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.functions.running import running_total
from clauselake.llm.groups import (
    block_pairs,
    components,
    dealt,
    matrix,
    spread_roots,
    streamed,
)
from clauselake.session import stored

BITS = 60


def usable(vector: F.Column) -> F.Column:
    """Not null, not empty, every component a finite number, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(
        vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def prefix_bits(rows: int, window: int) -> int:
    """Leading bits at which evenly split rows would fill a window at most."""
    return min(BITS, math.ceil(math.log2(max(1, rows / window))))


def passes_needed(rows: int, window: int, threshold: float, recall: float) -> int:
    """Passes until a pair at ``threshold`` has shared a prefix with probability ``recall``."""
    together = (1 - math.acos(min(1.0, threshold)) / math.pi) ** prefix_bits(rows, window)
    if together >= 1:
        return 1
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def projection_bits(x: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """A 60-bit word per row: the signs of random projections, the first bit highest."""
    rng = np.random.default_rng([seed, turn, x.shape[1]])
    signs = x @ rng.standard_normal((x.shape[1], BITS)) >= 0
    return signs @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` have a cosine of at least ``threshold``."""
    long_x, long_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    return (x @ y.T) / long_x[:, None] / long_y[None, :] >= threshold


def near_duplicates(
    vectors: DataFrame,
    threshold: float,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    window: int = 256,
    halo: int = 32,
    recall: float = 0.9999,
    block: int = 128,
    seed: int = 0,
) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Rows link when their labels are equal and not null, their vectors equally long and
    the cosine reaches ``threshold``. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing and stay their own component, as do rows
    with a null label. Repeated rows are rows of their own and link with each other. Null
    ids take part; a component without any id has a null ``component_id``. Other columns
    are not carried. An empty table gives an empty table.
    """
    named = vectors.select(
        F.col(vec_id).alias("vec_id"),
        F.col(label).alias("label"),
        F.col(embedding).cast("array<double>").alias("v"),
    )
    ids = running_total(named, [], ["vec_id", "label", "v"], F.lit(1), "rid")
    ids = stored(ids, "vectors")
    valid = ids.filter(F.col("label").isNotNull() & usable(F.col("v"))).select(
        "rid", F.xxhash64("label", F.size("v")).alias("part"), "v"
    )
    sizes = stored(valid.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    largest = sizes.agg(F.max("rows")).first()[0] or 0
    turns = passes_needed(largest, window, threshold, recall)
    shared = prefix_bits(largest, window)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for size in np.unique(sizes):
                some = batch.filter(pa.array(sizes == size))
                x = matrix(pa.chunked_array([some.column(2)]))
                for turn in range(turns):
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column(0),
                            some.column(1),
                            pa.array(np.full(len(x), turn, dtype=np.int32)),
                            pa.array(projection_bits(x, turn, seed)),
                        ],
                        names=["rid", "part", "turn", "bits"],
                    )

    hashed = valid.select("rid", "part", "v").mapInArrow(
        hashes, "rid long, part long, turn int, bits long"
    )
    # every pass orders a label of one window into that window
    order = hashed.join(sizes, "part").filter((F.col("turn") == 0) | (F.col("rows") > window)).drop("rows")
    placed = stored(
        running_total(order, ["turn", "part"], ["bits", "rid"], F.lit(1), "place").select(
            "rid", "part", "turn", "place", F.shiftright("bits", BITS - shared).alias("prefix")
        ),
        "places",
    )
    same = ["turn", "part", "prefix"]
    first, last = F.col("first") - 1, F.col("last") - 1
    in_window = first >= F.floor(last / window) * window - halo
    spans = placed.groupBy(*same).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    spans = stored(spans.filter(~in_window), "spans")
    own = F.floor((F.col("place") - 1) / window).cast("int")
    lead = (F.col("place") - 1) % window >= window - halo
    runs = placed.select(
        "rid", "part", "turn",
        F.explode(F.when(lead, F.array(own, own + 1)).otherwise(F.array(own))).alias("run"),
    )
    grouped = placed.join(spans.select(*same), same, "left_semi").select(*same, "rid")
    meetings = block_pairs(grouped, same, "rid", window)

    def united(rid: np.ndarray, links: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero(np.triu(links, 1))
        if len(i) > len(rid):  # a spanning forest is enough
            root = spread_roots(links)
            i = np.flatnonzero(root != np.arange(len(root)))
            j = root[i]
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(rid[i]), pa.array(rid[j])], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed(batches, ["turn", "part", "run"]):
            x = matrix(table["v"])
            yield from united(table["rid"].to_numpy(), linked(x, x, threshold))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed(batches, [*same, "lo", "hi"]):
            x, rid = matrix(table["v"]), table["rid"].to_numpy()
            lo = table["block"].to_numpy() == table["lo"].to_numpy()
            if lo.all():
                yield from united(rid, linked(x, x, threshold))
                continue
            both = linked(x[lo], x[~lo], threshold)
            if both.any():
                n = len(both)
                links = np.zeros((len(x), len(x)), dtype=bool)
                links[:n, n:], links[n:, :n] = both, both.T
                yield from united(np.concatenate([rid[lo], rid[~lo]]), links)

    edges = dealt(
        runs.join(valid.select("rid", "v"), "rid"), ["turn", "part", "run"], ["rid"]
    ).mapInArrow(compare, "a long, b long")
    edges = edges.union(
        dealt(
            meetings.join(valid.select("rid", "v"), "rid"), [*same, "lo", "hi"], ["block", "rid"]
        ).mapInArrow(meet, "a long, b long")
    )
    found = components(edges)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed(batches, ["component", "lo", "hi"]):
            x, rid = matrix(table["v"]), table["rid"].to_numpy()
            lo = table["block"].to_numpy() == table["lo"].to_numpy()
            hits = np.zeros(len(x), dtype=np.int64)
            if lo.all():
                hits = linked(x, x, threshold).sum(axis=1) - 1
            else:
                both = linked(x[lo], x[~lo], threshold)
                hits[lo], hits[~lo] = both.sum(axis=1), both.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(hits)], names=["rid", "n"])

    members = found.select(F.col("node").alias("rid"), "component")
    pairs = block_pairs(members, ["component"], "rid", block)
    counts = (
        dealt(pairs.join(valid.select("rid", "v"), "rid"), ["component", "lo", "hi"], ["block", "rid"])
        .mapInArrow(count, "rid long, n long")
        .groupBy("rid")
        .agg(F.sum("n").alias("n"))
    )
    kept = ids.select("rid", "vec_id").join(members, "rid", "left").join(counts, "rid", "left")
    least = (
        kept.filter(F.col("component").isNotNull())
        .groupBy("component")
        .agg(F.min("vec_id").alias("least"))
    )
    return kept.join(least, "component", "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("component").isNull(), F.col("vec_id"))
        .otherwise(F.col("least"))
        .alias("component_id"),
        F.coalesce(
            F.when(F.col("component").isNull(), F.lit(True)).otherwise(
                F.col("vec_id") == F.col("least")
            ),
            F.lit(False),
        ).alias("kept"),
    )
