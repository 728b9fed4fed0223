"""Whitening by eigenvectors that are found in float32 and refined to more than float64.

1. Entries become whole numbers. Their count, sums and products around a whole pivot are
   exact sums over all rows, whatever the order of tasks; ``n * n * V`` is a matrix of
   whole numbers, and only its entries come to the driver: the vectors' length squared.
2. ``numpy`` finds eigenvectors of the covariance in float32. Ogita and Aishima's iteration
   (``R = I - X'X``, ``S = X'VX``, ``X <- X + XE``) corrects them by matrix products in
   extended precision, the error squaring with each step. Eigenvalues that lie closer than
   the step can tell apart form a cluster: there the vectors are turned by the eigenvectors
   of the cluster's own small matrix, shifted by its mean, and the iteration goes on.
3. Rows are projected, and the covariance of what comes out is measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.session import stored

STEP = 1024  # of the whole numbers
SHIFT = 100_000
LARGEST = float(1 << 51)  # an entry beyond it has no whole number in 64 bits
STEPS = 40
WIDE = np.longdouble


def whole_vectors(embeddings: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, x`` of the rows without null or non-finite entries."""
    rows = embeddings.select(
        F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
    ).filter(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < LARGEST)))
    # a NaN is greater than any number, so the comparison leaves it out too
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * STEP) + SHIFT).alias("x"))


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy()
    return flat.reshape(batch.num_rows, dims)


def _exact_sum(values: np.ndarray) -> np.ndarray:
    """Sums of columns as Python integers."""
    if not len(values) or int(np.abs(values).max()) < (1 << 62) // len(values):
        return values.sum(axis=0).astype(object)
    return values.astype(object).sum(axis=0)


def exact_products(y: np.ndarray) -> np.ndarray:
    """``y'y`` as Python integers, by float64 products whose sums stay below 2^53."""
    dims = y.shape[1]
    total = np.zeros((dims, dims), object)
    most = int(np.abs(y).max(initial=0))
    rows = (1 << 53) // max(1, most * most)
    if not rows:
        exact = y.astype(object)
        return exact.T @ exact
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _added(df: DataFrame, of) -> dict[int, list[int]]:
    """Sums of rows of whole numbers over all tasks, by their place; ``of`` gives a batch's."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of(batch)
                total = own if total is None else total + own
        if total is not None:
            yield from written(enumerate(total))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.array([int(v) for v in values], object)
                totals[place] = totals[place] + own if place in totals else own
        yield from written(totals.items())

    def written(rows) -> Iterator[pa.RecordBatch]:
        rows = list(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([[str(v) for v in r[1]] for r in rows], pa.list_(pa.string())),
            ],
            names=["place", "values"],
        )

    schema = "place int, values array<string>"  # whole numbers of any size
    found = df.mapInArrow(partial, schema).repartition("place").mapInArrow(added, schema).collect()
    return {r["place"]: [int(v) for v in r["values"]] for r in found}


def covariance(x: DataFrame, n: int, dims: int) -> tuple[list[int], list[int], list[list[int]]]:
    """Pivot, ``S - n * pivot`` and ``n * n * V``, all exact."""
    sums = _added(x.select("x"), lambda batch: _exact_sum(_rows(batch, dims))[None, :])[0]
    pivot = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, pivot, strict=True)]
    held = np.array(pivot, np.int64)
    products = _added(x.select("x"), lambda batch: exact_products(_rows(batch, dims) - held))
    # what the pivot misses of the mean is taken off in whole numbers
    return pivot, rest, [
        [n * products[i][j] - rest[i] * rest[j] for j in range(dims)] for i in range(dims)
    ]


def _wide(numerator: int, denominator: int) -> np.longdouble:
    """A fraction to the precision of two float64."""
    high = numerator / denominator
    low = Fraction(numerator, denominator) - Fraction(high)
    return WIDE(high) + WIDE(float(low))


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Places of values that lie no further than ``apart`` from the next, if two or more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refined_eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    ``a`` is in extended precision, and so are the results. Each sign is such that the
    entry of largest size is positive.
    """
    dims = len(a)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(dims, WIDE), np.eye(dims, dtype=WIDE)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    one, norm = np.eye(dims, dtype=WIDE), np.sqrt((a * a).sum())
    floor = 8 * dims * np.finfo(WIDE).eps
    for _ in range(STEPS):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        apart = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        gaps = values[None, :] - values[:, None]
        far = np.abs(gaps) > apart
        # (s + value * r) / gap, split into its even half r / 2 and a part that is exactly odd,
        # so that rounding over a small gap turns vectors and does not bend them
        sums = (values[None, :] + values[:, None]) / 2
        e = r / 2 + np.where(far, (s + sums * r) / np.where(far, gaps, 1), 0)
        x = x + x @ e
        for places in _clusters(values, apart):
            own = x[:, places]
            middle = values[places].mean()
            small = own.T @ (a @ own - middle * own)
            size = np.abs(small).max()
            if size:
                turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1]
                x[:, places] = own @ turn.astype(WIDE)
        if np.abs(r).max() <= floor and np.abs(off).max() <= floor * norm:
            break
    x = x + x @ (one - x.T @ x) / 2
    values = np.diag(x.T @ (a @ x)) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x * x).sum(axis=0))[order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(dims)] < 0, -1, 1)
    return values[order] * scale, x


def _deviations(y: np.ndarray, n: int, rest: list[int]) -> pa.Array:
    """Exact sums of ``(n * y - rest)^2``; null beyond 64 bits."""
    most = n * int(np.abs(y).max(initial=0)) + max((abs(r) for r in rest), default=0)
    if most * most * max(1, y.shape[1]) < 1 << 63:
        away = n * y - np.array(rest, np.int64)
        return pa.array((away * away).sum(axis=1))
    away = n * y.astype(object) - np.array(rest, object)
    sums = (away * away).sum(axis=1).tolist()
    return pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())


def whiten(
    embeddings: DataFrame, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``.

    One row per vector and component, up to ``components`` or the vectors' length. An entry
    ``c`` counts as ``x = floor(1024 * c) + 100000``. Rows whose vector is null or holds a
    null, a non-finite entry or one beyond 2^51 are left out; so are vectors of another
    length than most have (the longer length, if as many), and empty ones. ``n`` is the number of the rest,
    ``deviation`` the exact sum over dimensions of ``(n * x - S)^2``, null if it does not
    fit 64 bits. ``whitened`` is the centred ``x`` along the unit eigenvector of the
    covariance (divisor ``n``) over the root of its eigenvalue; ``explained`` is that
    eigenvalue's share. A component without variance, to extended precision, has a null
    ``whitened``. ``identity_error`` is measured: the largest entry of the covariance of
    ``whitened`` minus the identity, over components with variance, null without any. Signs
    and results do not depend on the order of rows. Repeated and null ids are rows of their
    own; an empty table gives none; other columns play no part.
    """
    spark = embeddings.sparkSession
    every = stored(whole_vectors(embeddings, vec_id, vector).filter(F.size("x") > 0), "whole")
    kind = every.schema["vec_id"].dataType.simpleString()
    common = every.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    first = common.orderBy(F.desc("n"), F.desc("dims")).head()
    if first is None:
        return spark.createDataFrame(
            [],
            f"vec_id {kind}, component int, n long, deviation long, whitened double, "
            "explained double, identity_error double",
        )
    dims, n = first["dims"], first["n"]
    x = every.filter(F.size("x") == dims)
    pivot, rest, numerators = covariance(x, n, dims)
    values, vectors = refined_eigenvectors(
        np.array([[_wide(v, n * n) for v in row] for row in numerators], WIDE)
    )
    take = min(components, dims)
    trace = sum(numerators[i][i] for i in range(dims))
    explained = [float(v / _wide(trace, n * n)) if trace else None for v in values[:take]]
    least = values[0] * dims * np.finfo(WIDE).eps * 64
    live = [i for i in range(take) if values[i] > least]
    axes = (vectors[:, live] / np.sqrt(values[live])).astype(np.float64)
    held, mean = np.array(pivot, np.int64), np.array([float(Fraction(r, n)) for r in rest])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _rows(batch, dims) - held
            z = (y - mean) @ axes
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(live)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    _deviations(y, n, rest),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel())),
                ],
                names=["vec_id", "deviation", "z"],
            )

    placed = stored(
        x.mapInArrow(project, f"vec_id {kind}, deviation long, z array<double>"), "whitened"
    )
    error = _identity_error(placed, len(live))
    place = {component: F.col("z")[k] for k, component in enumerate(live)}
    rows = [
        F.struct(
            F.lit(i + 1).alias("component"),
            place.get(i, F.lit(None).cast("double")).alias("whitened"),
            F.lit(explained[i]).cast("double").alias("explained"),
        )
        for i in range(take)
    ]
    return placed.select("vec_id", "deviation", F.explode(F.array(*rows)).alias("c")).select(
        "vec_id",
        "c.component",
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "c.whitened",
        "c.explained",
        F.lit(error).cast("double").alias("identity_error"),
    )


def _identity_error(placed: DataFrame, live: int) -> float | None:
    """Largest entry of the covariance of ``z`` minus the identity, centred, then multiplied."""
    if not live:
        return None
    z = [F.col("z")[i] for i in range(live)]
    means = placed.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(z)]).head()
    pairs = [(i, j) for i in range(live) for j in range(i, live)]
    found = placed.agg(
        *[F.avg((z[i] - means[i]) * (z[j] - means[j])).alias(f"v{i}_{j}") for i, j in pairs]
    ).head()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))
