"""Sharding by a Feistel permutation of the global row numbers.

Row ``i`` of ``n`` goes to place ``p = permute(i)``, hence to shard ``p % shards``
and slot ``p // shards``. Both directions are computable from ``n``, the number of
shards and the seed alone, so a reader can find any row without an index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.running import running_total

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words (two multiply and shift steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _half(n: int) -> int:
    """Side of the smallest square that holds ``n`` places."""
    side = int(n**0.5)
    while side * side < n:
        side += 1
    while side > 1 and (side - 1) * (side - 1) >= n:
        side -= 1
    return max(1, side)


def _turn(x: np.ndarray, side: int, seed: int, k: int) -> np.ndarray:
    offset = np.uint64((seed * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    return _mix(x + offset) % np.uint64(side)


def _network(x: np.ndarray, side: int, seed: int, back: bool) -> np.ndarray:
    s = np.uint64(side)
    left, right = x // s, x % s
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = (right + s - _turn(left, side, seed, k)) % s, left
        else:
            left, right = right, (left + _turn(right, side, seed, k)) % s
    return left * s + right


def permute(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Places of row numbers in 0..n-1 (or row numbers of places, with ``back``).

    The network permutes a square of at least ``n`` places; a value that leaves
    0..n-1 walks on along its cycle until it is inside again.
    """
    x = np.asarray(rows, dtype=np.uint64)
    if x.size == 0:
        return x.astype(np.int64)
    side = _half(n)
    with np.errstate(over="ignore"):
        out = _network(x, side, seed, back)
        while (outside := out >= np.uint64(n)).any():
            out[outside] = _network(out[outside], side, seed, back)
    return out.astype(np.int64)


def locate(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a row number."""
    place = int(permute(np.array([row]), n, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """Row number that stands in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def place_column(row: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(permute(rows.to_numpy(), n, seed))

    return place(row)


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Columns ``order`` plus ``row`` (from 0), ``shard`` and ``slot`` for every row.

    Rows are numbered in the order of ``order`` (nulls first); rows that agree in all
    of these columns are interchangeable, and each of them gets a number of its own.
    Shards differ by at most one row, slots of a shard run from 0 without gaps. Other
    columns are not carried. An empty table gives an empty table.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    slim = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    keys = slim.columns
    numbered = running_total(slim, [], keys, F.lit(1), "row")
    n = numbered.agg(F.max("row")).first()[0] or 0
    placed = numbered.withColumn("row", F.col("row") - 1).withColumn(
        "place", place_column(F.col("row"), n, seed)
    )
    return placed.select(
        *[F.col(k).alias(c) for k, c in zip(keys, order, strict=True)],
        "row",
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
    )
