"""Benchmark passages in training documents, found in suffix arrays of the documents' words.

Every task sorts the suffixes of its documents' words, a shard of places at a time, and
binary-searches every suffix of the benchmark's items in it, word by word. Words are
numbers in the benchmark's vocabulary (0 for any other word, which no item holds), so a
comparison is exact. Suffixes are sorted by as many words as a window has; where a whole
window agrees, each place in the range is followed on to its longest verbatim match.

Documents stay where they are: nothing is shuffled, and a passage that a third of them
hold is found in each by its own task. The benchmark is the query set. It comes through
the driver in blocks of ``BLOCK`` words, one pass over the documents for each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clauselake.llm.shingles import small_batches
from clauselake.llm.words import numbers, word_stretches
from clauselake.session import stored

WINDOW = 10
SHARD = 1 << 20  # suffixes sorted at once
BLOCK = 1 << 20  # benchmark words searched for in one pass
FOLLOWED = 1 << 21  # places followed at once


@dataclass
class Block:
    """Items that are searched for together; equal items are one, under all their ids."""

    vocabulary: pa.Array
    words: np.ndarray  # numbers of the items' words, a 0 after each item
    whole: np.ndarray  # for each place, whether an item of fewer words than a window starts here
    left: np.ndarray  # words from each place to its item's end
    start: np.ndarray  # place within the item
    item: np.ndarray  # number of the item
    ids: list[list]  # item_ids by number


def make_block(items: list[tuple[object, int, pa.Array]], window: int = WINDOW) -> Block:
    """A block of ``(item_id, place of the first word, words)``."""
    merged: dict[tuple, list] = {}
    for item_id, base, words in items:
        if len(words):
            merged.setdefault((base, tuple(words.to_pylist())), []).append(item_id)
    held = pa.array([w for _, own in merged for w in own], pa.large_binary())
    vocabulary = pc.unique(held)
    coded = numbers(held, vocabulary)
    sizes = np.array([len(own) for _, own in merged], np.int64)
    bases = np.array([base for base, _ in merged], np.int64)
    item = np.repeat(np.arange(len(sizes)), sizes + 1)
    inside = np.arange(len(item)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    left = np.repeat(sizes, sizes + 1) - inside
    words = np.zeros(len(item), np.int32)
    words[left > 0] = coded
    start = inside + np.repeat(bases, sizes + 1)
    whole = (start == 0) & (left < window) & (left > 0)
    return Block(vocabulary, words, whole, left, start, item, [list(v) for v in merged.values()])


def blocks(benchmark: DataFrame, window: int) -> Iterator[Block]:
    """All items, in blocks of at most ``BLOCK`` words; at least one, maybe empty, block.

    An item of more words is cut into pieces that share ``window - 1`` words, so that each
    window lies in one of them.
    """
    held: list[tuple[object, int, pa.Array]] = []
    n, given = 0, False
    for row in benchmark.toLocalIterator():
        parts = [w for _, w, _ in word_stretches(pa.array([row[1]], pa.string()))]
        words = pa.concat_arrays(parts) if parts else pa.array([], pa.large_binary())
        for at in range(0, max(1, len(words) - window + 1), BLOCK - window + 1):
            piece = words.slice(at, BLOCK)
            if held and n + len(piece) > BLOCK:
                yield make_block(held, window)
                held, n, given = [], 0, True
            held.append((row[0], at, piece))
            n += len(piece)
    if held or not given:
        yield make_block(held, window)


def suffix_array(words: np.ndarray, lo: int, hi: int, depth: int, top: int) -> np.ndarray:
    """Places ``lo`` to ``hi - 1`` that hold a known word, sorted by their first ``depth`` words.

    As many words as fit are packed into one integer; ranks of those are then paired until
    ``depth`` words count. Places from ``hi`` on are looked at, not sorted.
    """
    bits = max(1, int(top).bit_length())
    have = min(63 // bits, depth)
    n = hi - lo + depth
    ahead = np.zeros(n + have, np.int64)
    given = words[lo : lo + len(ahead)]
    ahead[: len(given)] = given
    key = np.zeros(n, np.int64)
    for k in range(have):
        key = (key << bits) | ahead[k : k + n]
    while have < depth:
        step = min(have, depth - have)
        found, rank = np.unique(key, return_inverse=True)
        key = rank[:-step] * len(found) + rank[step:]
        have += step
    known = np.flatnonzero(words[lo:hi])
    return known[np.argsort(key[known], kind="stable")] + lo


def _bound(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, word: np.ndarray, after: bool):
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        middle = np.minimum((lo + hi) >> 1, len(column) - 1)
        met = column[middle]
        right = open_ & ((met <= word) if after else (met < word))
        lo = np.where(right, middle + 1, lo)
        hi = np.where(open_ & ~right, middle, hi)
    return lo


def search(order: np.ndarray, words: np.ndarray, block: Block, window: int) -> tuple[np.ndarray, ...]:
    """``test place, first, last``: ranges of ``order`` whose places hold a whole window."""
    active = np.flatnonzero(block.left > 0)
    lo, hi = np.zeros(len(active), np.int64), np.full(len(active), len(order), np.int64)
    tests, firsts, lasts = [], [], []
    for depth in range(window):
        if not len(active):
            break
        column = words[np.minimum(order + depth, len(words) - 1)]
        word = block.words[active + depth]
        first = _bound(column, lo, hi, word, after=False)
        last = _bound(column, first, hi, word, after=True)
        met = first < last
        active, lo, hi = active[met], first[met], last[met]
        done = (block.left[active] == depth + 1) & block.whole[active]
        if depth + 1 == window:
            done |= block.left[active] >= window
        for out, values in zip((tests, firsts, lasts), (active, lo, hi), strict=True):
            out.append(values[done])
        on = block.left[active] > depth + 1
        active, lo, hi = active[on], lo[on], hi[on]
    return tuple(np.concatenate([np.zeros(0, np.int64), *out]) for out in (tests, firsts, lasts))


def matches(words: np.ndarray, block: Block, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """``place, test place, length`` of all matches of a window or more that grow no further.

    ``words`` are the numbers of the documents' words with a 0 before and after each document.
    """
    out = [(np.zeros(0, np.int64),) * 3]
    top = len(block.vocabulary)
    for lo in range(0, len(words) if top else 0, SHARD):
        order = suffix_array(words, lo, min(lo + SHARD, len(words)), window, top)
        tests, firsts, lasts = search(order, words, block, window)
        sizes = lasts - firsts
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), FOLLOWED), side="right")
        for a, b in itertools.pairwise([*np.unique(cuts).tolist(), len(tests)]):
            test = np.repeat(tests[a:b], sizes[a:b])
            skip = np.arange(len(test)) - np.repeat(np.cumsum(sizes[a:b]) - sizes[a:b], sizes[a:b])
            place = order[np.repeat(firsts[a:b], sizes[a:b]) + skip]
            # what goes on to the left is part of the match that starts there
            before = np.where(block.start[test] > 0, block.words[test - 1], 0)
            own = (before == 0) | (before != words[place - 1])
            place, test = place[own], test[own]
            length = np.minimum(window, block.left[test])
            growing = np.arange(len(place))
            while len(growing):
                following = block.words[test[growing] + length[growing]]
                same = (following > 0) & (following == words[place[growing] + length[growing]])
                growing = growing[same]
                length[growing] += 1
            out.append((place, test, length))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _numbered(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all rows, a 0 before and after each, and words of each row."""
    counts = np.zeros(len(column), np.int64)
    parts = [np.zeros(1, np.int32)]
    at = 0
    for row, words, own in word_stretches(column):
        coded = numbers(words, vocabulary)
        parts.append(np.zeros(row - at, np.int32))  # rows since the last stretch have ended
        parts.append(np.insert(coded, np.cumsum(own[:-1]), 0))
        counts[row : row + len(own)] += own
        at = row + len(own) - 1
    parts.append(np.zeros(len(column) - at, np.int32))
    return np.concatenate(parts), counts


def _search(df: DataFrame, block: Block, window: int, item_kind: pa.DataType) -> DataFrame:
    """Add the block's matches to ``matches`` and count the words of ``text``."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids = pa.array([i for ids in block.ids for i in ids], item_kind)
        many = np.array([len(ids) for ids in block.ids], np.int64)
        for batch in batches:
            n = batch.num_rows
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            words, counts = _numbered(column["text"], block.vocabulary)
            starts = np.zeros(n + 1, np.int64)
            np.cumsum(counts + 1, out=starts[1:])
            starts += 1  # place of each row's first word
            place, test, length = matches(words, block, window)
            row = np.searchsorted(starts, place, side="right") - 1
            item = block.item[test]
            times = many[item]  # every id of equal items
            first = (np.cumsum(many) - many)[item]
            pick = np.repeat(np.arange(len(place)), times)
            nth = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
            found = pa.StructArray.from_arrays(
                [
                    item_ids.take(pa.array(first[pick] + nth)),
                    pa.array(block.start[test][pick]),
                    pa.array((place - starts[row])[pick]),
                    pa.array(length[pick]),
                ],
                names=["item_id", "item_start", "doc_start", "n_words"],
            )
            earlier = column["matches"]
            rows = np.concatenate([np.repeat(np.arange(n), pc.list_value_length(earlier).to_numpy()), row[pick]])
            every = pa.concat_arrays([earlier.flatten().cast(found.type), found])
            order = np.lexsort((np.arange(len(rows)), rows))
            ends = np.searchsorted(rows[order], np.arange(n + 1)).astype(np.int32)
            column["matches"] = pa.ListArray.from_arrays(pa.array(ends), every.take(pa.array(order)))
            column["n_words"] = pa.array(counts)
            yield pa.RecordBatch.from_arrays(list(column.values()), names=list(column))

    return df.mapInArrow(run, schema)


def _covered(matches: Column) -> Column:
    """How many words lie in at least one match."""
    spans = F.array_sort(
        F.transform(
            matches, lambda m: F.struct(m["doc_start"].alias("a"), (m["doc_start"] + m["n_words"]).alias("b"))
        )
    )
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        spans,
        F.struct(zero.alias("upto"), zero.alias("n")),
        lambda seen, s: F.struct(
            F.greatest(seen["upto"], s["b"]).alias("upto"),
            (seen["n"] + F.greatest(zero, s["b"] - F.greatest(s["a"], seen["upto"]))).alias("n"),
        ),
        lambda seen: seen["n"],
    )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per row: ``doc_id``, carried columns, ``n_words, n_hit, items, matches``.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A match
    is a run of words of the document that stands word for word in an item, ``window`` words
    or more, or the whole of an item that has fewer, and grows no further on either side:
    ``item_id, item_start, doc_start, n_words``, counted in words from 0. ``n_hit`` counts
    the document's words inside any match, ``items`` holds the distinct ids as strings,
    sorted, without null. A null text, of either table, has no words; an item without words
    matches nothing. Rows with equal or null ids are rows of their own, items that share an
    id count once. Empty tables give no rows, or rows without matches. Columns named in
    ``carry`` come along unchanged, whatever their names.
    """
    small_batches(docs.sparkSession)
    carry = carry or []
    asked = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    none = f"array<struct<item_id:{kind},item_start:bigint,doc_start:bigint,n_words:bigint>>"
    found = docs.select(
        F.col(doc_id).alias("doc_id"),
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)],
        F.col(text).cast("string").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast(none).alias("matches"),
    )
    item_kind = to_arrow_type(asked.schema["item_id"].dataType)
    for i, block in enumerate(blocks(asked, window)):
        found = _search(stored(found, "leaks") if i else found, block, window, item_kind)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    return found.select(
        "doc_id",
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)],
        "n_words",
        _covered(F.col("matches")).alias("n_hit"),
        F.filter(items, lambda i: i.isNotNull()).alias("items"),
        "matches",
    )


def longest_matches(leaks: DataFrame) -> DataFrame:
    """Of every item found: its longest match and where, ties to the smallest document.

    ``item_id, n_words, doc_id, doc_start, item_start``, from rows of ``find_leaks``.
    """
    each = leaks.select("doc_id", F.explode("matches").alias("m"))
    best = F.min(
        F.struct((-F.col("m.n_words")).alias("less"), "doc_id", "m.doc_start", "m.item_start")
    ).alias("b")
    return each.groupBy("m.item_id").agg(best).select(
        "item_id",
        (-F.col("b.less")).alias("n_words"),
        *[F.col(f"b.{c}") for c in ("doc_id", "doc_start", "item_start")],
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The rows whose text holds no window of the benchmark, with all their columns."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for n, c in zip(names, docs.columns, strict=True)],
        F.lit(0).alias("_row"),
    )
    column = names[docs.columns.index(text)]
    found = find_leaks(rows, benchmark, window, doc_id="_row", text=column, carry=names)
    return found.filter(F.size("matches") == 0).select(
        *[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    )
