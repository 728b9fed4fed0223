"""Ranked lexical search: tiles of items' terms times tiles of documents' impacts.

A document is scored for an item by one dot product: over the item's terms, the term's
weight times the document's impact for it. Both factors are whole numbers, so the product
of two matrices in float64 is exact as long as no partial sum reaches 2^53; the number of
terms multiplied at once follows from the greatest weight, and the sums of the pieces are
added as 64-bit integers.

1. Every task counts its documents' terms and keeps, per document, the terms that any
   item has, as numbers in the items' vocabulary, with their counts. That slim table is
   stored; counts over all documents (``N``, ``L``, ``df``) are sums over it.
2. Every task multiplies its documents, a tile at a time, with each tile of items over that
   tile's own compact vocabulary, and keeps of each item the best so far. A document that
   equals the last one kept is looked at again, so that ties go to the smaller id whatever
   the order.
3. What the tasks keep, ``k`` rows an item each, is ranked in Spark.

The items are the query set: they come through the driver in blocks of ``BLOCK`` terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from clauselake.llm.shingles import small_batches
from clauselake.llm.words import numbers, word_stretches
from clauselake.session import stored

BLOCK = 1 << 20  # items' terms looked for in one pass over the documents
ITEMS = 128  # items of a tile
TERMS = 2048  # terms multiplied at once, at most
DOCS = 512  # documents of a tile
EXACT = 1 << 53
SCALE = 1_000_000_000  # of the impact, which is at most SCALE / 1000
FLAT, SLOPE = 10, 90  # a document's m: FLAT, and SLOPE for a document of average length


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, set[bytes]]]]:
    """``item_id`` and distinct terms of all items, in blocks of at most ``BLOCK`` terms.

    A block holds one item at least; an item without terms is left out.
    """
    held: list[tuple[object, set[bytes]]] = []
    n = 0
    for row in benchmark.toLocalIterator():
        terms: set[bytes] = set()
        for _, words, _ in word_stretches(pa.array([row[1]], pa.string())):
            terms.update(pc.unique(words).to_pylist())
        if held and n + len(terms) > BLOCK:
            yield held
            held, n = [], 0
        if terms:
            held.append((row[0], terms))
            n += len(terms)
    if held:
        yield held


def _term_counts(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """``doc_id, n, terms, counts`` of each document with a term; ``terms`` are numbers from 0."""
    width = len(vocabulary) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n = np.zeros(rows, np.int64)
            keys, times = [], []
            for first, words, own in word_stretches(batch.column(1)):
                n[first : first + len(own)] += own
                coded = numbers(words, vocabulary)
                at = np.repeat(np.arange(first, first + len(own)), own)
                key, many = np.unique((at * width + coded)[coded > 0], return_counts=True)
                keys.append(key)
                times.append(many)
            key = np.concatenate([np.zeros(0, np.int64), *keys])
            many = np.concatenate([np.zeros(0, np.int64), *times])
            if len(keys) > 1:  # pieces of one text may share terms
                key, where = np.unique(key, return_inverse=True)
                many = np.bincount(where, many, len(key)).astype(np.int64)
            ends = np.searchsorted(key, np.arange(rows + 1) * width).astype(np.int32)
            terms = pa.array((key % width - 1).astype(np.int32))
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(ends), terms),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(many)),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )
            yield out.filter(pa.array(n > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, counts array<long>")


def _statistics(postings: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms with repeats, and for each term the documents that hold it."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms + 2, np.int64)
        for batch in batches:
            df[:terms] += np.bincount(batch.column(1).flatten().to_numpy(), minlength=terms)
            df[terms] += batch.num_rows
            df[terms + 1] += pc.sum(batch.column(0)).as_py() or 0
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["what", "many"])

    found = postings.select("n", "terms").mapInArrow(sums, "what long, many long")
    df = np.zeros(terms + 2, np.int64)
    for r in found.groupBy("what").agg(F.sum("many").alias("many")).collect():  # the vocabulary's size
        df[r["what"]] = r["many"]
    return int(df[terms]), int(df[terms + 1]), df[:terms]


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def lengths(n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """``m`` of documents of ``n`` terms, in whole numbers of any size."""
    if len(n) and int(n.max()) * SLOPE * n_docs < 1 << 63:
        return FLAT + n * (SLOPE * n_docs) // all_terms
    return np.array([FLAT + SLOPE * int(k) * n_docs // all_terms for k in n], np.int64)


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    if len(counts) and int(counts.max()) >= (1 << 63) // SCALE:
        return np.array([SCALE * int(c) // (1000 * int(c) + 8 * int(k)) for c, k in zip(counts, m, strict=True)], np.int64)
    return SCALE * counts // (1000 * counts + 8 * m)


def tiles(items: list[np.ndarray], weight: np.ndarray) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """``first item, pieces`` of each tile; a piece is some terms and their weights by item.

    The terms of a tile are those of its items; a piece has as many as keep every partial
    sum below 2^53.
    """
    most = (SCALE // 1000) * max(1, int(weight.max(initial=1)))
    width = max(1, min(TERMS, (EXACT - 1) // most))
    for first in range(0, len(items), ITEMS):
        own = items[first : first + ITEMS]
        compact = np.unique(np.concatenate(own))
        pieces = []
        for at in range(0, len(compact), width):
            terms = compact[at : at + width]
            factor = np.zeros((len(terms), len(own)))
            for column, held in enumerate(own):
                mine = held[(held >= terms[0]) & (held <= terms[-1])]
                factor[np.searchsorted(terms, mine), column] = weight[mine]
            pieces.append((terms, factor))
        yield first, pieces


class Best:
    """The ``k`` best documents of each item, ties to the smaller id, a null id last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)  # a lower score cannot enter any more
        self.held: list[list[tuple[int, bool, object]]] = [[] for _ in range(items)]

    def add(self, first: int, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores of a tile, documents by items; ``first`` is the tile's first item."""
        least = self.least[first : first + scores.shape[1]]
        for column in np.flatnonzero(scores.max(axis=0, initial=0) >= least).tolist():
            item, own = first + column, scores[:, column]
            at = np.flatnonzero(own >= least[column])
            if len(at) > self.k:  # all that tie with the k-th stay
                at = at[own[at] >= np.partition(own[at], len(at) - self.k)[len(at) - self.k]]
            named = zip(own[at].tolist(), ids.take(pa.array(at)).to_pylist(), strict=True)
            held = self.held[item] + [(-s, i is None, i if i is not None else 0) for s, i in named]
            held.sort()
            self.held[item] = held[: self.k]
            if len(held) >= self.k:
                self.least[item] = -held[self.k - 1][0]


def score_tile(documents: tuple, pieces: list, place: np.ndarray) -> np.ndarray:
    """Exact scores, documents by items.

    ``documents`` are their number and the rows, terms and impacts of their entries;
    ``place`` is -1 for every term, and so it is again afterwards.
    """
    n_rows, rows, terms, impact = documents
    total = np.zeros((n_rows, pieces[0][1].shape[1]), np.int64)
    for own, factor in pieces:
        place[own] = np.arange(len(own))
        at = place[terms]
        met = at >= 0
        left = np.zeros((n_rows, len(own)))
        left[rows[met], at[met]] = impact[met]
        total += (left @ factor).astype(np.int64)
        place[own] = -1
    return total


def _best_rows(postings: DataFrame, block: list, owned: list, weight: np.ndarray, n_docs: int, all_terms: int,
               k: int, item_type: T.DataType) -> DataFrame:
    """The ``k`` best of each task, as ``item, item_id, doc_id, score``."""
    names = [name for name, _ in block]
    item_kind = to_arrow_type(item_type)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), k)
        place = np.full(len(weight), -1, np.int32)
        id_kind = None
        for batch in batches:
            id_kind = batch.schema.field(0).type
            parts = []
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                many = pc.list_value_length(part.column(2)).to_numpy()
                rows = np.repeat(np.arange(part.num_rows), many)
                m = lengths(part.column(1).to_numpy(), n_docs, all_terms)
                impact = impacts(part.column(3).flatten().to_numpy(), m[rows])
                terms = part.column(2).flatten().to_numpy()
                parts.append((part.column(0), (part.num_rows, rows, terms, impact)))
            for first, pieces in tiles(owned, weight):
                for ids, documents in parts:
                    best.add(first, score_tile(documents, pieces, place), ids)
        found = [(item, -s, None if null else i) for item, held in enumerate(best.held) for s, null, i in held]
        if found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.int32()),
                    pa.array([names[f[0]] for f in found], item_kind),
                    pa.array([f[2] for f in found], id_kind),
                    pa.array([f[1] for f in found], pa.int64()),
                ],
                names=["item", "item_id", "doc_id", "score"],
            )

    kind = postings.schema["doc_id"].dataType.simpleString()
    return postings.mapInArrow(rank, f"item int, item_id {item_type.simpleString()}, doc_id {kind}, score long")


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest scores above 0 of every item.

    Terms are runs of digits, letters and characters beyond ASCII of the whole text, A-Z
    lower-cased; a null text has none. ``N`` documents have a term, ``L`` is all their terms
    with repeats. A term that ``df`` documents hold weighs
    ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``; a document of ``n`` terms has
    ``m = 10 + 90 * n * N div L``; its score sums, over the item's distinct terms, the weight
    times ``1000000000 * tf div (1000 * tf + 8 * m)``. Equal scores rank by ascending id, a
    null id last; rows of one id are documents of their own, and rows of one ``item_id`` are
    items of their own, each with ranks from 1. Items without terms and empty tables give
    no rows; other columns play no part.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    spark, item_type = docs.sparkSession, asked.schema["item_id"].dataType
    kind = rows.schema["doc_id"].dataType.simpleString()
    ranked = None
    for block in item_blocks(asked):
        vocabulary = pa.array(sorted(set().union(*(terms for _, terms in block))), pa.large_binary())
        owned = [
            np.sort(numbers(pa.array(list(terms), pa.large_binary()), vocabulary) - 1) for _, terms in block
        ]
        postings = stored(_term_counts(rows, vocabulary), "postings")
        n_docs, all_terms, df = _statistics(postings, len(vocabulary))
        weight = weights(n_docs, df)
        best = _best_rows(postings, block, owned, weight, n_docs, all_terms, k, item_type)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        part = (
            best.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score")
        )
        ranked = part if ranked is None else ranked.union(part)
    if ranked is None:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {kind}, score long")
    return ranked
