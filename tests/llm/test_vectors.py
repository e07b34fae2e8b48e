"""Operators 11 and 12 against brute force in whole numbers and dense linear algebra, and on edge cases."""

import hashlib
import itertools
import math
from fractions import Fraction

import numpy as np
import pytest

from linkrisk.llm import clustering, whitening
from linkrisk.llm.vectors import held, whole

NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    """Columns named like those of the results, too."""
    return spark.createDataFrame([(i, v, 7, 8, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, n int, ids string")


def brute_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept))[:k]
    centroids = [v for _, _, v in start]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in set(own):
            mine = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            centroids[j] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = {j: sum(d for _, d, c in found if c == j) for j in range(len(centroids))}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, held(d), held(sums[j]), held(sum(sums.values())), digests[j]) for i, d, j in found), key=str)


def run_clusters(spark, rows, **options):
    return sorted((tuple(r) for r in clustering.cluster(frame(spark, rows), **options)[0].collect()), key=str)


def test_hilbert_curve_visits_each_cell_once_and_moves_one_step():
    for dims, bits in ((2, 3), (3, 2), (4, 2), (1, 4), (5, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        order = sorted(range(len(cells)), key=clustering.hilbert(cells, bits).__getitem__)
        path = cells[order]
        assert len(set(clustering.hilbert(cells, bits))) == len(cells)
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_boxes_bound_the_candidates():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.normal(size=(20, 6)) * rng.choice([0.01, 0.3, 5]) + rng.normal(size=6)
        near = clustering.Nearest([[int(v) for v in c] for c in rng.integers(-100, 100, (9, 6))], 64)
        some = near.candidates(x.min(axis=0), x.max(axis=0))
        values = whole(x, 64)
        everything = near.of(values, np.arange(9))
        assert set(everything[0]) <= set(some.tolist())
        assert all((a == b).all() for a, b in zip(everything, near.of(values, some), strict=True))


@pytest.mark.parametrize("block", [1, 7, 128])
def test_clusters_with_ties_copies_and_bad_vectors(spark, block):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(60)]
    rows += [(i, [0.5] * 64) for i in range(60, 160)] + [(7, [0.25] * 64)] * 5 + [(7, [0.75] * 64), (None, [0.1] * 64), (None, [0.5] * 64)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [NAN] + [0.0] * 63), (904, [INF] + [0.0] * 63), (905, [None] + [0.0] * 63)]
    assert run_clusters(spark, rows, block=block) == brute_clusters(rows)


@pytest.mark.parametrize("scale", [1e5, 1e12, 1e30, 1e306])
def test_clusters_of_large_components(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=64) * scale).tolist()) for i in range(40)]
    assert run_clusters(spark, rows) == brute_clusters(rows)


def test_few_or_no_vectors(spark):
    rows = [(i, [i / 10] * 64) for i in range(5)]
    assert run_clusters(spark, rows) == brute_clusters(rows)
    assert run_clusters(spark, []) == [] and run_clusters(spark, [(1, None)]) == []
    assert sorted(r[2] for r in run_clusters(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.5])], dims=2, k=1, rounds=0)) == [0, 32**2]


def run_whitening(spark, rows, **options):
    df, values, q = whitening.whiten(frame(spark, rows), **options)
    return df.toPandas(), values, q


def checked_whitening(rows, found, values, q, k):
    """``found`` against dense eigenvectors and whole-number deviations; rows have ids 0, 1, ..."""
    x = [[math.floor(64 * Fraction(c)) + 1000000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in x])
    values_there, vectors = np.linalg.eigh(centred.T @ centred / n)
    values_there, vectors = values_there[::-1], vectors[:, ::-1]
    assert len(values) == k and np.allclose(values, values_there[:k], rtol=1e-9)
    signs = np.sign((q * vectors[:, :k]).sum(axis=0))
    whitened = centred @ vectors[:, :k] / np.sqrt(values_there[:k]) * signs
    got = found.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    assert np.abs(got - whitened).max() < 1e-7
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    assert found[found.component == 1].set_index("vec_id").deviation.loc[[i for i, _ in rows]].tolist() == [held(d) for d in deviations]
    assert np.allclose(found[found.vec_id == rows[0][0]].sort_values("component").explained, values_there[:k] / values_there.sum(), rtol=1e-6)
    assert found.identity_error.max() <= 1e-6 and found.n.unique().tolist() == [n]


@pytest.mark.parametrize("dims,k,spread", [(64, 32, 1.0), (40, 32, 1.02), (100, 5, 1.5), (12, 12, 1.1), (3, 2, 30.0)])
def test_whitening_against_dense_eigenvectors(spark, dims, k, spread):
    rng = np.random.default_rng(dims)
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    x = rng.normal(size=(300, dims)) * spread ** -np.arange(dims) * 3 @ turn + rng.normal(size=dims)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    found, values, q = run_whitening(spark, rows, components=k, block=64)
    checked_whitening(rows, found, values, q, k)


def test_whitening_of_large_entries(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(50, 6)) * 1e7).tolist())]
    found, values, q = run_whitening(spark, rows, components=6)
    checked_whitening(rows, found, values, q, 6)
    # beyond a long: held, and no error
    found, _, _ = run_whitening(spark, [(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)])
    assert found.deviation.tolist() and (found.deviation == held(10**30)).all()


def test_whitening_finds_a_direction_that_the_block_has_missed(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 30)) * np.r_[9, np.ones(29)]
    v = whitening.Covariance(whitening.packed(frame(spark, [(i, r) for i, r in enumerate(x.tolist())]).selectExpr("vec_id", "embedding v"), 30, 64, 64), 30, None)
    exact = np.floor(64 * x)
    v.centre = whitening.Centre(400, [int(s) for s in exact.sum(axis=0)], 64 * 64)
    dense = np.cov(exact.T, bias=True)
    q = np.linalg.eigh(dense)[1][:, :-1][:, ::-1][:, :6]
    values, directions = whitening.complement(v, q)
    assert np.isclose(values[0], np.linalg.eigvalsh(dense)[-1]) and np.allclose(dense @ directions[:, 0], values[0] * directions[:, 0], rtol=1e-8, atol=1e-6)


def test_whitening_without_spread_and_with_bad_vectors(spark):
    flat = [(i, [1.0, 2.0, 3.0]) for i in range(4)]
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], flat):
        found, values, _ = run_whitening(spark, rows)
        assert len(found) == 0 and list(found.columns) == [c.split()[0] for c in whitening.WHITENED.split(", ")]
    # one direction only; repeated rows, null ids, other lengths and bad vectors
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(5)] + [(3, [3.0, 6.0, 5.0]), (None, [9.0, 18.0, 5.0]), (50, [1.0]), (51, None), (52, [NAN, 1.0, 1.0]), (53, [1.0, None, 2.0])]
    found, values, _ = run_whitening(spark, rows)
    assert len(found) == 7 and set(found.component) == {1} and found.vec_id.isna().sum() == 1 and (found.n == 7).all()
    assert abs((found.whitened**2).mean() - 1) < 1e-9 and np.allclose(found.explained, 1)
