"""Word shingles of UTF-8 text, hashed in whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PIECE = 1 << 18  # bytes of text hashed at once, with some 50 bytes of work each (a longer text is hashed alone)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let texts travel to Python in batches of about ``size`` bytes, however long they are.

    Spark's own bound counts rows. The setting holds for the session, as it is read when a
    query runs; one that the user has set stays.
    """
    if spark.conf.get(BATCH, None) in (None, "-1", str((1 << 63) - 1), f"{(1 << 63) - 1}b"):
        spark.conf.set(BATCH, str(size))


def scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and how many words each text has.

    Words are runs of bytes other than blank and 9 to 13; they never cross texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.ones(n, dtype=bool)
    first[1:] = blank[:-1]
    edges = offsets[1:-1]
    first[edges[edges < n]] = True
    starts = np.flatnonzero(first & ~blank)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    stop = np.ones(n, dtype=bool)
    stop[:-1] = blank[1:] | first[1:]
    ends = np.flatnonzero(stop & ~blank) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
        words = (sums[ends] - sums[starts]) * powers(BACK, n)[starts]
        words = scramble(words + (ends - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, offsets))
    return words, counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, ``width`` words each.

    A text of fewer words has one shingle of all of them, a text without words none.
    """
    for lo, hi in pieces(offsets):
        base = offsets[lo]
        local = offsets[lo : hi + 1] - base
        words, counts = word_hashes(data[base : offsets[hi]], local)
        at = 0
        with np.errstate(over="ignore"):
            for count in counts.tolist():
                own = words[at : at + count]
                at += count
                take = min(width, count)
                if not take:
                    yield np.zeros(0, np.uint64)
                    continue
                mixed = np.zeros(count - take + 1, dtype=np.uint64)
                for k in range(take):
                    mixed = mixed * BASE + own[k : count - take + 1 + k]
                yield np.unique(scramble(mixed + np.uint64(take)))


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PIECE`` bytes together."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, side="right")) - 1)
        yield lo, hi
        lo = hi


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    whole = pa.concat_arrays([column.fill_null("")]).cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)
    offsets = offsets[whole.offset : whole.offset + len(whole) + 1]
    held = whole.buffers()[2]
    return (np.frombuffer(held, dtype=np.uint8) if held else np.zeros(0, np.uint8)), offsets
