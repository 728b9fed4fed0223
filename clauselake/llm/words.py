"""Words of letters, digits and characters beyond ASCII, cut in whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from clauselake.llm.shingles import text_bytes

STRETCH = 8 << 20  # bytes of text cut at once; a longer text is cut between words


def _alphabet() -> np.ndarray:
    """What each byte becomes: A-Z are lower-cased, 0 stands for all that ends a word."""
    out = np.arange(256, dtype=np.uint8)
    out[:128] = 0
    for first, last, shift in ((b"0", b"9", 0), (b"a", b"z", 0), (b"A", b"Z", 32)):
        codes = np.arange(first[0], last[0] + 1)
        out[codes] = codes + shift
    return out


ALPHABET = _alphabet()


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of several texts in order, and how many each text has; none crosses texts."""
    rows = len(offsets) - 1
    kept = ALPHABET[data]
    inside = kept != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(rows, np.int64)
    # a word ends before the next separator or the next word's start
    gaps = np.add.reduceat(inside, starts, dtype=np.int64)
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(gaps, out=places[1:])
    letters = kept[inside]
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(letters)]
    )
    return words, np.diff(np.searchsorted(starts, offsets))


def word_stretches(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """``first row, words, words of each row`` for stretches of about ``STRETCH`` bytes.

    A longer text comes as several stretches of one row, cut at separators, so that what is
    held beside the column does not grow with the longest text.
    """
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + STRETCH, side="right")) - 1
        if end > row:
            base, stop = offsets[row], offsets[end]
            words, counts = cut_words(data[base:stop], offsets[row : end + 1] - base)
            yield row, words, counts
            row = end
            continue
        at, stop = int(offsets[row]), int(offsets[row + 1])
        while at < stop:
            to = min(at + STRETCH, stop)
            while to < stop and ALPHABET[data[to]]:
                to += 1
            words, counts = cut_words(data[at:to], np.array([0, to - at]))
            yield row, words, counts
            at = to
        row += 1


def numbers(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Place of each word in the vocabulary, from 1; 0 where it is not there."""
    found = pc.index_in(words, value_set=vocabulary)
    return pc.add(pc.fill_null(found, -1), 1).to_numpy(zero_copy_only=False).astype(np.int32)
