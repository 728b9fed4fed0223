"""Ranked search and whitening against plain forms."""

import collections
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from clauselake.llm import queries, ranked_search, whitening

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SCHEMA = "doc_id long, text string, n int, terms int, item int, score int"


def terms(text):
    return [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in WORD.findall((text or "").encode())]


def brute_ranks(docs, items, k):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, all_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item_id, item in items:
        scored = []
        for i, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // all_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms(item))
                if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0))
        out += [(item_id, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def awkward():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "X9"]
    draw = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, draw(rng.randint(1, 80))) for i in rng.sample(range(1000), 150)]
    docs += [(2000 + i, docs[3][1]) for i in range(40)]  # ties beyond a tile's k
    docs += [(5, docs[3][1]), (5, docs[3][1]), (None, docs[3][1]), (3000, None), (3001, ""), (3002, " - ")]
    docs.append((3003, " ".join(f"w{i % 60}" for i in range(30_000))))
    items = [(i, draw(rng.randint(1, 30))) for i in range(30)]
    items += [(None, docs[3][1]), (50, None), (51, ""), (52, "unseen words"), (53, docs[3][1]), (53, "w1 w1 W1")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_ranks(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ranked_search, "BLOCK", 40)
    docs, items = awkward()
    table = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs], SCHEMA)
    asked = spark.createDataFrame(items, "item_id int, text string")
    got = ranked_search.search(table, asked, k=10).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == brute_ranks(docs, items, 10)
    if not small:
        assert ranked_search.search(table.limit(0), asked).count() == 0
        none = ranked_search.search(table, asked.limit(0))
        assert none.count() == 0 and none.dtypes == ranked_search.search(table, asked).dtypes


@pytest.mark.parametrize(("items", "width"), [(128, 2048), (3, 5), (1, 1)])
def test_tiles_of_any_size_give_the_same_scores(monkeypatch, items, width):
    monkeypatch.setattr(ranked_search, "ITEMS", items)
    monkeypatch.setattr(ranked_search, "TERMS", width)
    rng = np.random.default_rng(2)
    weight = rng.integers(0, 30_000, 40)
    owned = [np.sort(rng.choice(40, rng.integers(1, 30), replace=False)) for _ in range(10)]
    impact = rng.integers(0, 10**6, (20, 40))
    rows, held = np.nonzero(impact)
    place = np.full(40, -1, np.int32)
    got = np.zeros((20, 10), np.int64)
    for first, pieces in ranked_search.tiles(owned, weight):
        scores = ranked_search.score_tile((20, rows, held, impact[rows, held]), pieces, place)
        got[:, first : first + scores.shape[1]] = scores
    want = np.array([[sum(int(weight[t]) * int(impact[d, t]) for t in own) for own in owned] for d in range(20)])
    assert (got == want).all() and (place == -1).all()


def test_partial_sums_stay_exact():
    """Weights so great that one piece may hold only a few terms."""
    weight = np.full(64, 3 * 10**9)
    ((_, pieces),) = ranked_search.tiles([np.arange(64)], weight)
    assert all(len(t) * 3 * 10**9 * 10**6 < 1 << 53 for t, _ in pieces) and len(pieces) == 22


def test_best_keeps_ties_by_id():
    rng = np.random.default_rng(4)
    best, every = ranked_search.Best(3, 4), [[], [], []]
    for _ in range(30):
        scores, ids = rng.integers(0, 4, (7, 3)), rng.integers(0, 500, 7).tolist()
        best.add(0, scores, pa.array(ids))
        for i in range(3):
            every[i] += [(-int(s), False, d) for s, d in zip(scores[:, i], ids, strict=True) if s]
    assert [h for h in best.held] == [sorted(e)[:4] for e in every]


def test_large_numbers():
    n = np.array([5, 2**40])
    assert ranked_search.lengths(n, 10**10, 10**13).tolist() == [10 + 90 * int(k) * 10**10 // 10**13 for k in n]
    counts, m = np.array([3, 10**12]), np.array([10, 10**6])
    assert ranked_search.impacts(counts, m).tolist() == [
        10**9 * int(c) // (1000 * int(c) + 8 * int(k)) for c, k in zip(counts, m, strict=True)
    ]


VECTORS = "vec_id long, embedding array<float>, x int, z int, place int, component int"


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS)


def brute_whitening(rows, take):
    """Exact sums in fractions, eigenvectors by float64 ``eigh`` of the exact covariance."""
    x = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows]
    n, dims = len(x), len(x[0][1])
    sums = [sum(v[d] for _, v in x) for d in range(dims)]
    away = [[n * c - s for c, s in zip(v, sums, strict=True)] for _, v in x]
    exact = [[Fraction(sum(a[i] * a[j] for a in away), n**3) for j in range(dims)] for i in range(dims)]
    values, vectors = np.linalg.eigh(np.array(exact, float))
    values, vectors = values[::-1], vectors[:, ::-1]
    z = (np.array([[float(Fraction(c, n)) for c in a] for a in away]) @ vectors)[:, :take] / np.sqrt(values[:take])
    return n, [sum(c * c for c in a) for a in away], z, values[:take] / float(sum(exact[i][i] for i in range(dims)))


def test_whitening(spark):
    rng = np.random.default_rng(6)
    good = [(i, (rng.standard_normal(12) * np.arange(1, 13) / 12).tolist()) for i in range(300)]
    good += [good[4], (None, good[9][1]), (900, [0.0] * 12)]
    bad = [
        (1, None), (2, []), (3, [None, *[1.0] * 11]), (4, [float("nan")] * 12), (5, [float("-inf")] + [0.0] * 11),
        (6, [1.0, 2.0]), (7, [3e30] * 12),
    ]
    got = whitening.whiten(vector_table(spark, [*bad, *good]), 8).collect()
    n, deviation, z, explained = brute_whitening(good, 8)
    assert len(got) == 8 * len(good) and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-12 and len({r.identity_error for r in got}) == 1
    by = collections.defaultdict(list)
    for r in got:
        by[r.component].append((repr(r.vec_id), r.deviation, r.whitened, r.explained))
    for c, rows in by.items():
        rows.sort()
        want = sorted((repr(i), d, float(v)) for (i, _), d, v in zip(good, deviation, z[:, c - 1], strict=True))
        assert [r[:2] for r in rows] == [w[:2] for w in want]
        mine, theirs = np.array([r[2] for r in rows]), np.array([w[2] for w in want])
        assert min(np.abs(np.sort(mine) - np.sort(s * theirs)).max() for s in (1, -1)) < 1e-9
        assert all(math.isclose(r[3], explained[c - 1], rel_tol=1e-12) for r in rows)


def test_whitening_without_variance(spark):
    flat = vector_table(spark, [(i, [float(i % 2), 1.0, 2.0]) for i in range(10)])
    got = whitening.whiten(flat).collect()
    assert len(got) == 30 and {r.whitened is None for r in got if r.component > 1} == {True}
    assert all(math.isclose(abs(r.whitened), 1) for r in got if r.component == 1)
    one = whitening.whiten(vector_table(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [(None, None, None, 0)] * 2
    assert whitening.whiten(flat.limit(0)).count() == 0
    assert whitening.whiten(flat).schema.names == whitening.whiten(flat.limit(0)).schema.names


def test_exact_sums_of_large_numbers():
    rng = np.random.default_rng(8)
    for most in (10, 1 << 27, 1 << 45):
        y = rng.integers(-most, most, (50, 4))
        want = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(4)] for i in range(4)]
        assert whitening.exact_products(y).tolist() == want
        assert whitening._exact_sum(y * 8).tolist() == [8 * sum(int(v) for v in y[:, i]) for i in range(4)]
    y = np.array([[1 << 28, 5]])
    want = [sum((10 * int(v) - r) ** 2 for v, r in zip(y[0], (3, 4), strict=True))]
    assert whitening._deviations(y, 10, [3, 4]).to_pylist() == [want[0] if want[0] < 1 << 63 else None]
    assert whitening._deviations(y * 1024, 10, [3, 4]).to_pylist() == [None]


@pytest.mark.parametrize(
    "spectrum",
    [
        np.arange(1, 31),
        [1e6, 1e6 + 1e-3, 1e6 + 2e-3, *np.linspace(1, 2, 27)],  # closer than float32 can tell
        [5, 5, 5, 5, 1, 1, 1, *np.linspace(0.1, 0.2, 23)],  # multiple
        [1e9, 1e3, 1e-3, *np.geomspace(1e-5, 1e-4, 27)],
        [0] * 10 + [1] * 10 + [1 + 1e-9] * 10,
    ],
)
def test_refined_eigenvectors(spectrum):
    rng = np.random.default_rng(7)
    spectrum = np.array(spectrum, np.longdouble)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to extended precision
        q = q @ (1.5 * np.eye(30, dtype=np.longdouble) - 0.5 * (q.T @ q))
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    values, x = whitening.refined_eigenvectors(a)
    most = np.abs(spectrum).max()
    assert np.abs(values - np.sort(spectrum)[::-1]).max() < 1e-17 * most
    assert np.abs(x.T @ x - np.eye(30)).max() < 1e-16
    assert np.abs(a @ x - x * values).max() < 1e-16 * most
    # simple eigenvalues: the vector itself, to double precision
    gaps = np.array([min(abs(v - w) for j, w in enumerate(spectrum) if j != i) for i, v in enumerate(spectrum)])
    for i in np.flatnonzero(gaps > 1e-4 * most):
        assert 1 - np.abs(q[:, i] @ x).max() < 1e-16


def test_query_on_the_table(spark, sf_dir):
    got = queries.op12_refined_whitening(spark, sf_dir).collect()
    z = collections.defaultdict(dict)
    for r in got:
        z[r.component][r.vec_id] = r.whitened
    m = np.array([[z[c][i] for c in range(1, 9)] for i in sorted(z[1])])
    assert np.abs(np.cov(m.T, bias=True) - np.eye(8)).max() < 1e-10
    assert all(r.identity_error < 1e-10 for r in got)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    n, deviation, brute, explained = brute_whitening([(r.vec_id, r.embedding) for r in table], 8)
    for k, r in enumerate(table):
        mine = np.array([z[c][r.vec_id] for c in range(1, 9)])
        assert np.abs(np.abs(mine) - np.abs(brute[k])).max() < 1e-8
    assert {(r.vec_id, r.deviation) for r in got} == {(r.vec_id, d) for r, d in zip(table, deviation, strict=True)}
    assert all(math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-10) and r.n == n for r in got)
