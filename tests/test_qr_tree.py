"""Orthonormalisation through the QR tree, where a Gram matrix cannot tell."""

import numpy as np
import pytest

from tridelta.functions.linalg import mgs_of_triangle, mgs_transform
from tridelta.operators import factors as fo


def column_mgs(a):
    q = a.astype(np.longdouble)
    for c in range(q.shape[1]):
        q[:, c] /= np.sqrt((q[:, c] ** 2).sum())
        for b in range(c + 1, q.shape[1]):
            q[:, b] -= (q[:, c] * q[:, b]).sum() * q[:, c]
    return q.astype(float)


def frame(spark, a, parts):
    rows = [(i + 1, *map(float, x)) for i, x in enumerate(a)]
    return spark.createDataFrame(rows, "idx long, " + ", ".join(f"c{q} double" for q in range(a.shape[1]))).repartition(parts)


def near_dependent(n, remainder, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, 3))
    a[:, 2] = a[:, 0] - 2 * a[:, 1] + remainder * rng.normal(size=n)
    return a * np.array([1.0, 1e6, 1e-3])


@pytest.mark.parametrize("remainder", [1e-3, 1e-8, 1e-10])
def test_small_remainders_are_kept(spark, remainder):
    a = near_dependent(500, remainder)
    q, t, g, deficient = fo.orthonormalize(frame(spark, a, 7), 3)
    got = np.array([[r.c0, r.c1, r.c2] for r in sorted(q.collect(), key=lambda r: r.idx)])
    assert not deficient
    assert np.allclose(got.T @ got, np.eye(3), atol=1e-12) and np.allclose(g, np.eye(3), atol=1e-12)
    assert np.abs(got - column_mgs(a)).max() < (1e-6 if remainder >= 1e-8 else 1e-4)
    if remainder <= 1e-8:  # from the products of columns it would have been lost
        assert mgs_transform(a.T @ a)[1]


def test_dependent_and_zero_columns_become_zero(spark):
    a = near_dependent(200, 0.0)
    a[:, 1] = 0.0
    a[:, 2] = 3 * a[:, 0]
    wide = np.column_stack([a, np.random.default_rng(1).normal(size=200)])
    q, _, g, deficient = fo.orthonormalize(frame(spark, wide, 4), 4)
    got = np.array([[r.c0, r.c1, r.c2, r.c3] for r in sorted(q.collect(), key=lambda r: r.idx)])
    want = column_mgs(wide[:, [0, 3]])
    assert deficient and not got[:, 1:3].any()
    assert np.allclose(got[:, [0, 3]], want, atol=1e-10) and np.allclose(np.diag(g), [1, 0, 0, 1], atol=1e-12)


def test_tree_of_many_partitions_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(fo, "FAN_IN", 3)
    a = near_dependent(40, 1e-5)
    r = fo.r_factor(frame(spark, a, 30), 3)
    assert np.allclose(r.T @ r, a.T @ a, rtol=1e-12)
    assert not fo.r_factor(frame(spark, a[:0], 2), 3).any()
    one = fo.r_factor(frame(spark, a[:1], 5), 3)
    assert np.allclose(one.T @ one, np.outer(a[0], a[0]))


def test_values_that_are_not_finite_fail(spark):
    a = near_dependent(20, 1e-8)
    a[3, 1] = np.nan
    with pytest.raises(Exception, match="non-finite"):
        fo.r_factor(frame(spark, a, 3), 3)
    with pytest.raises(ValueError):
        mgs_of_triangle(np.full((3, 3), np.inf))
