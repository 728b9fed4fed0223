"""Nearest neighbours by inner product along shifted Hilbert curves.

Vectors are brought to equal length (one more coordinate takes up the difference), so the
largest inner product is the nearest point. Every ordering projects the points at random
to a few coordinates, shifts the grid and orders the points by their place on a Hilbert
curve; Spark ranges the keys, and each point gets its rank. A query is compared with all
rows whose rank in some ordering lies within a half-window of its own; the results of all
orderings are merged and ranked by the exact product.

The half-window is measured, not chosen: for a bounded sample of queries the true
neighbours are found against every row, and the window is the distance in rank that holds
the wanted share of them. On vectors without structure it is a large part of the table,
on clustered ones a small one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions.running import running_total
from clauselake.llm.groups import matrix
from clauselake.llm.sorted_passes import usable
from clauselake.session import stored

AXES, BITS = 8, 7  # coordinates of a curve, and bits of each
LEAST = 256  # places of a chunk, at least
QUERIES = 2048  # queries held at once, about


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells in 0..2**bits-1.

    Works down the levels of the cube: a set bit reflects the first axis below that
    level, an unset one swaps the differing lower bits of both axes; the reflected Gray
    code of what is left is read off level by level.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _bell(x: np.ndarray) -> np.ndarray:
    """Share of a bell curve below x (logistic form, monotone)."""
    return 1 / (1 + np.exp(-1.702 * np.clip(x, -20, 20)))


class Curves:
    """The projections, grids and shifts of all orderings for vectors of one length."""

    def __init__(self, sample: np.ndarray, norm: float, turns: int, seed: int):
        self.norm = norm
        self.shapes = []
        lifted = self.lift(sample)
        for turn in range(turns):
            rng = np.random.default_rng([seed, turn, lifted.shape[1]])
            axes = rng.standard_normal((lifted.shape[1], AXES))
            axes = np.linalg.qr(axes)[0] if len(axes) >= AXES else axes
            seen = lifted @ axes
            self.shapes.append((axes, seen.mean(axis=0), seen.std(axis=0) + 1e-9, rng.random(AXES)))

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
        return np.hstack([x, rest[:, None]])

    def query(self, q: np.ndarray) -> np.ndarray:
        q = q / np.linalg.norm(q, axis=1)[:, None]
        return np.hstack([q, np.zeros((len(q), 1))])

    def keys(self, lifted: np.ndarray, turn: int) -> np.ndarray:
        axes, mean, std, shift = self.shapes[turn]
        at = (_bell((lifted @ axes - mean) / std) + shift) / 2
        return hilbert_keys(np.minimum((at * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


class Best:
    """The k best rows so far of each query; ties go to the smaller id."""

    def __init__(self, rids: np.ndarray, queries: np.ndarray, k: int):
        self.rids, self.q, self.k = rids, queries, k
        self.score = np.full((len(rids), k), -np.inf)
        self.vec = np.full((len(rids), k), np.iinfo(np.int64).max)
        self.rid = np.full((len(rids), k), -1)

    def add(self, rids: np.ndarray, vecs: np.ndarray, x: np.ndarray) -> None:
        for i in range(0, len(rids), 2048):
            for j in range(0, len(self.rids), 1024):
                self._add(slice(j, j + 1024), rids[i : i + 2048], vecs[i : i + 2048], x[i : i + 2048])

    def _add(self, part: slice, rids: np.ndarray, vecs: np.ndarray, x: np.ndarray) -> None:
        q = self.q[part]
        near = q @ x.T
        near[self.rids[part][:, None] == rids[None, :]] = -np.inf
        width = min(self.k + 8, len(rids))
        pick = np.argpartition(-near, width - 1, axis=1)[:, :width]
        # a product is summed in one fixed order here, so that equal vectors score alike
        exact = (q[:, None, :] * x[pick]).sum(axis=2)
        exact[np.isneginf(np.take_along_axis(near, pick, axis=1))] = -np.inf
        self._merge(part, exact, vecs[pick], rids[pick])
        if width < len(rids):  # more rows as good as the last one picked: ties
            edge = np.take_along_axis(near, pick, axis=1).min(axis=1)
            tied = (near >= (edge - 1e-9 * np.maximum(1, np.abs(edge)))[:, None]).sum(axis=1) > width
            still = tied & (edge >= self.score[part][:, -1] - 1e-9)
            for j in np.flatnonzero(still):
                all_ = np.flatnonzero(near[j] >= edge[j] - 1e-9 * max(1, abs(edge[j])))
                one = slice(part.start + j, part.start + j + 1)
                known = set(self.rid[one][0].tolist())
                all_ = all_[[r not in known for r in rids[all_].tolist()]]
                if len(all_):
                    exact = (q[j][None, :] * x[all_]).sum(axis=1)
                    self._merge(one, exact[None], vecs[all_][None], rids[all_][None])

    def _merge(self, part: slice, score: np.ndarray, vec: np.ndarray, rid: np.ndarray) -> None:
        score = np.hstack([self.score[part], score])
        vec = np.hstack([self.vec[part], vec])
        rid = np.hstack([self.rid[part], rid])
        order = np.lexsort((vec, -score), axis=1)[:, : self.k]
        self.score[part] = np.take_along_axis(score, order, axis=1)
        self.vec[part] = np.take_along_axis(vec, order, axis=1)
        self.rid[part] = np.take_along_axis(rid, order, axis=1)

    def rows(self) -> pa.RecordBatch:
        kept = self.score > -np.inf
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.rids, kept.sum(axis=1))),
                pa.array(self.rid[kept]),
                pa.array(self.vec[kept]),
                pa.array(self.score[kept]),
            ],
            names=["qrid", "rid", "vec_id", "score"],
        )


FOUND = "qrid long, rid long, vec_id long, score double"


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best distinct rows of each query."""
    once = rows.groupBy("qrid", "rid", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qrid").orderBy(F.desc("score"), "vec_id", "rid")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    turns: int = 3,
    recall: float = 0.97,
    sample_queries: int = 64,
    sample_rows: int = 10_000,
    chunk: int = 10_240,
    seed: int = 0,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each query row.

    ``is_query`` is a condition on the id column. Queries are compared with vectors of
    their own length. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do rows with a null id; a query never finds its own row,
    but finds rows that repeat it. Ties go to the smaller id. An empty table gives an
    empty table. ``sample_rows`` vectors fit the grids, ``sample_queries`` the window.
    """
    named = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.col(embedding).cast("array<double>").alias("v"),
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = running_total(named, [], ["vec_id", "v"], F.lit(1), "rid")
    rows = stored(rows.withColumn("dim", F.size("v")), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    curves = {}
    for r in rows.groupBy("dim").agg(F.max(norm).alias("norm")).collect():  # one row per length
        drawn = rows.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64("rid", F.lit(seed)))
        seen = np.array([x[0] for x in drawn.select("v").limit(sample_rows).collect()])
        curves[r["dim"]] = Curves(seen, r["norm"], turns, seed)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                for kind in (0, 1):
                    asks = batch.column(1).to_numpy(zero_copy_only=False)
                    some = batch.filter(pa.array((dims == dim) & (asks if kind else True)))
                    if not some.num_rows:
                        continue
                    x, own = matrix(pa.chunked_array([some.column(2)])), curves[int(dim)]
                    lifted = own.query(x) if kind else own.lift(x)
                    for turn in range(turns):
                        n = len(x)
                        yield pa.RecordBatch.from_arrays(
                            [
                                some.column(0),
                                some.column(3),
                                pa.array(np.full(n, turn, np.int32)),
                                pa.array(np.full(n, kind, np.int32)),
                                pa.array(own.keys(lifted, turn)),
                            ],
                            names=["rid", "dim", "turn", "kind", "key"],
                        )

    keys = rows.select("rid", "asks", "v", "dim").mapInArrow(
        places, "rid long, dim int, turn int, kind int, key long"
    )
    ranked = stored(
        running_total(
            keys, ["turn", "dim"], ["key", "rid", "kind"], F.lit(1) - F.col("kind"), "place"
        ).select("rid", "dim", "turn", "kind", "place"),
        "places",
    )
    half = _half_window(rows, ranked, k, recall, sample_queries, seed)
    chunk = max(LEAST, min(chunk, half))

    at = F.floor((F.col("place") - F.lit(1)) / chunk)
    last = ranked.groupBy("turn", "dim").agg(F.floor((F.max("place")) / chunk).alias("last"))
    data = (
        ranked.filter("kind = 0")
        .join(last, ["turn", "dim"])
        .select(
            "rid", "dim", "turn", "kind",
            F.explode(
                F.sequence(
                    F.greatest(F.lit(0), F.floor((F.col("place") - half) / chunk)),
                    F.least("last", F.floor((F.col("place") + half) / chunk)),
                )
            ).alias("chunk"),
        )
    )
    asked = ranked.filter("kind = 1").select(
        "rid", "dim", "turn", "kind", F.greatest(F.lit(0), at).alias("chunk")
    )
    # queries that crowd into a chunk are dealt to sub-blocks, for each of which its rows come
    # again; rows of chunks that nobody asks for go nowhere
    place = ["turn", "dim", "chunk"]
    subs = asked.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("subs"))
    subs = stored(subs, "subs")
    every = F.explode(F.sequence(F.lit(0), F.col("subs") - 1))
    data = data.join(subs, place).select("rid", "dim", "turn", "kind", "chunk", every.alias("sub"))
    one = F.pmod(F.xxhash64("rid", F.lit(seed)), F.col("subs")).cast("int")
    asked = asked.join(subs, place).select("rid", "dim", "turn", "kind", "chunk", one.alias("sub"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # queries of a chunk come first; then its rows stream by, whatever their number
        key, best, held = None, None, []
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(5)]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                group, kind = tuple(c[start] for c in columns[:4]), columns[4][start]
                if group != key:
                    if best is not None:
                        yield best.rows()
                    key, best, held = group, None, []
                part = batch.slice(start, end - start)
                rids, vecs = part.column(5).to_numpy(), part.column(6).to_numpy()
                x = matrix(pa.chunked_array([part.column(7)]))
                if kind == 1:
                    held.append((rids, x))
                elif held:
                    if best is None:
                        best = Best(
                            np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k
                        )
                    best.add(rids, vecs, x)
        if best is not None:
            yield best.rows()

    dealt = (
        data.union(asked)
        .join(rows.select("rid", "vec_id", "v"), "rid")
        .select("turn", "dim", "chunk", "sub", "kind", "rid", "vec_id", "v")
        .repartition("turn", "dim", "chunk", "sub")
        .sortWithinPartitions("turn", "dim", "chunk", "sub", F.desc("kind"))
    )
    found = _best(dealt.mapInArrow(compare, FOUND), k)
    return found.join(
        rows.select(F.col("rid").alias("qrid"), F.col("vec_id").alias("query_id")), "qrid"
    ).select("query_id", "rank", "vec_id", "score")


def _half_window(
    rows: DataFrame, ranked: DataFrame, k: int, recall: float, sample: int, seed: int
) -> int:
    """Ranks on either side that hold the share ``recall`` of a sample's true neighbours."""
    drawn = (
        rows.filter("asks").orderBy(F.xxhash64("rid", F.lit(seed)), "rid").limit(sample).collect()
    )
    if not drawn:
        return 1
    asked: dict[int, tuple[list[int], list[list[float]]]] = {}
    for r in drawn:
        own = asked.setdefault(r["dim"], ([], []))
        own[0].append(r["rid"])
        own[1].append(r["v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Best(np.array(a), np.array(b), k) for dim, (a, b) in asked.items()}
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in best:
                some = batch.filter(pa.array(dims == dim))
                if some.num_rows:
                    x = matrix(pa.chunked_array([some.column(2)]))
                    best[dim].add(some.column(0).to_numpy(), some.column(1).to_numpy(), x)
        for b in best.values():
            yield b.rows()

    true = _best(rows.select("rid", "vec_id", "v", "dim").mapInArrow(search, FOUND), k)
    near = ranked.filter("kind = 0").select("rid", "turn", F.col("place").alias("there"))
    own = ranked.filter("kind = 1").select(F.col("rid").alias("qrid"), "turn", "place")
    away = (
        true.join(near, "rid")
        .join(own, ["qrid", "turn"])
        .groupBy("qrid", "rid")
        .agg(F.min(F.abs(F.col("there") - F.col("place"))).alias("away"))
    )
    distances = sorted(r[0] for r in away.select("away").collect())  # sample * k at most
    if not distances:
        return 1
    return max(1, distances[min(len(distances) - 1, math.ceil(recall * len(distances)))])
