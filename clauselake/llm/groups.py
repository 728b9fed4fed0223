"""Groups in bounded pieces: block pairs, connected components, sorted group streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.functions.running import running_total
from clauselake.session import stored

_ROUNDS = 60  # far more than any graph needs: each round at least halves the live nodes


def components(edges: DataFrame, shelf: list[str] | None = None) -> DataFrame:
    """``a, b`` -> ``node, component`` (the component's smallest node), for nodes with edges.

    Each round hooks every node to its smallest neighbour, shortens the pointers once
    and contracts the edges, so that groups shrink whatever their diameter. Minima
    combine before the shuffle; nothing is collected. Rows with a null are left out.
    What it stores, the result included, goes on the ``shelf``.
    """
    links = stored(
        edges.select("a", "b")
        .filter(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "links",
        shelf,
    )
    names = stored(
        links.select(F.col("a").alias("node"))
        .union(links.select("b"))
        .distinct()
        .withColumn("component", F.col("node")),
        "components",
        shelf,
    )
    for _ in range(_ROUNDS):
        if links.isEmpty():
            return names
        both = links.union(links.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("p"))
        hooks = hooks.select("a", F.least("a", "p").alias("p"))
        further = hooks.select(F.col("a").alias("p"), F.col("p").alias("q"))
        hooks = stored(
            hooks.join(further, "p", "left").select("a", F.coalesce("q", "p").alias("p")),
            "hooks",
            shelf,
        )
        over = hooks.select(F.col("a").alias("component"), "p")
        names = stored(
            names.join(over, "component", "left").select(
                "node", F.coalesce("p", "component").alias("component")
            ),
            "components",
            shelf,
        )
        left = hooks.select("a", F.col("p").alias("x"))
        right = hooks.select(F.col("a").alias("b"), F.col("p").alias("y"))
        links = stored(
            links.join(left, "a")
            .join(right, "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "links",
            shelf,
        )
    raise RuntimeError("components did not settle")


def block_pairs(rows: DataFrame, group: list[str], order: str, size: int) -> DataFrame:
    """Deal each group of two or more rows to pairs of blocks of ``size`` rows.

    ``rows`` has the columns ``group`` and ``order`` (unique in the group). The result
    adds ``lo``, ``hi`` and ``block``: a row of block ``i`` comes once for every other
    block, under the pair's smaller and larger number. Every pair of rows meets in
    exactly one ``(group, lo, hi)`` (for ``lo = hi`` both rows are of that block), which
    holds at most ``2 * size`` rows however large the group is.
    """
    many = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    numbered = running_total(rows.join(many, group), group, [order], F.lit(1), "_place")
    block = F.floor((F.col("_place") - 1) / size).cast("int")
    last = F.floor((F.col("_n") - 1) / size).cast("int")
    paired = numbered.select(
        *group, order, block.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("_o")
    )
    return paired.select(
        *group,
        order,
        "block",
        F.least("block", "_o").alias("lo"),
        F.greatest("block", "_o").alias("hi"),
    )


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a key together and in order, as ``streamed`` expects them."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def streamed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal keys (no nulls); holds one group and one batch at a time."""
    held: list[pa.RecordBatch] = []
    at: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [
            batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            for k in keys
        ]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[start] for c in columns)
            if at is not None and key != at:
                yield pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def spread_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric boolean matrix."""
    n = len(linked)
    root = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        low = np.where(reach, root[None, :], n).min(axis=1)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def matrix(column: pa.ChunkedArray, kind: str = "float64") -> np.ndarray:
    """A list column of equally long rows as a matrix."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False)
