"""The whole update against a dense NumPy statement of the algorithm."""

import numpy as np
import pytest

from conftest import SF0001
from tridelta.functions import linalg as la
from tridelta.functions.fixed import PUBLISHED_CORE_WEIGHTS
from tridelta.plans.job import start_model
from tridelta.plans.update import incremental_update
from tridelta.operators.tensor import tensor_stats
from tridelta.sources.tables import activity_tensor, default_pre_dims

OTHER = {0: (1, 2), 1: (0, 2), 2: (0, 1)}


def mgs(a):
    a = a.copy()
    before = np.linalg.norm(a, axis=0)
    for c in range(a.shape[1]):
        norm = np.linalg.norm(a[:, c])
        if norm <= 1e-6 * before[c]:  # dependent on the columns before it
            a[:, c] = 0
            continue
        a[:, c] /= norm
        for d in range(c + 1, a.shape[1]):
            a[:, d] -= (a[:, c] @ a[:, d]) * a[:, c]
    return a


def region_mask(shape, pre, code):
    masks = []
    for m in range(3):
        idx = np.arange(1, shape[m] + 1)
        masks.append(idx > pre[m] if code[m] == "1" else idx <= pre[m])
    return masks[0][:, None, None] & masks[1][None, :, None] & masks[2][None, None, :]


def dense_update(x, pre, old, g, mu, schedule):
    dims = x.shape
    new = {m: np.zeros((dims[m] - pre[m], g.shape[m])) for m in range(3)}

    def full(m):
        return np.vstack([old[m], new[m]])

    def step(m, code, blend):
        xr = np.where(region_mask(dims, pre, code), x, 0.0)
        a, b = OTHER[m]
        t = np.einsum("ijk,jq,kr->ijk"[:0] + {0: "ijk,jq,kr->iqr", 1: "ijk,iq,kr->jqr", 2: "ijk,iq,jr->kqr"}[m],
                      xr, full(a), full(b))
        t = t.reshape(t.shape[0], -1, order="F")
        upd = t @ la.core_pinv(g, m)
        touched = np.abs(xr).sum(axis=tuple(x for x in range(3) if x != m)) > 0
        rows = touched[pre[m]:]
        cur = new[m].copy()
        cur[rows] = upd[pre[m]:][rows]
        new[m] = mgs(mu * new[m] + (1 - mu) * cur if blend else cur)

    for m in range(3):
        step(m, "".join("1" if k == m else "0" for k in range(3)), False)
    for m in range(3):
        a, b = OTHER[m]
        for code in ("".join("1" if k in (m, b) else "0" for k in range(3)),
                     "".join("1" if k in (m, a) else "0" for k in range(3))):
            step(m, code, True)
    for m in range(3):
        step(m, "111", True)
    final, core = {}, g.copy()
    for m in range(3):
        f = mgs(full(m))
        core = la.mode_product(core, f[: pre[m]].T @ old[m], m)
        final[m] = f
    weights = {"once": {r: 1 for r in ("100", "010", "001", "011", "101", "110", "111")},
               "as_published": PUBLISHED_CORE_WEIGHTS}[schedule]
    for code, w in weights.items():
        xr = np.where(region_mask(dims, pre, code), x, 0.0)
        core += w * np.einsum("ijk,ip,jq,kr->pqr", xr, final[0], final[1], final[2])
    return final, core


@pytest.mark.parametrize("schedule", ["once", "as_published"])
def test_update_matches_dense_model(spark, schedule):
    cells = activity_tensor(spark, SF0001)
    dims = tensor_stats(cells).dims
    pre = default_pre_dims(dims)
    ranks = (3, 3, 3)
    blocks, grams, core = start_model(spark, pre, ranks)
    res = incremental_update(cells, blocks, core, pre, ranks, partition="bucket", core_schedule=schedule,
                             gram_old=grams)
    x = np.zeros(dims)
    for r in cells.collect():
        x[r["i"] - 1, r["j"] - 1, r["k"] - 1] += r["val"]
    old = {}
    for m in range(3):
        rows = sorted(blocks[m].collect(), key=lambda r: r["idx"])
        old[m] = np.array([[r[f"c{q}"] for q in range(3)] for r in rows])
    final, g = dense_update(x, pre, old, core, 0.8, schedule)
    assert np.allclose(res.core_array, g, rtol=1e-8, atol=1e-8)
    got = {(r["mode"], r["idx"]): [r["c0"], r["c1"], r["c2"]] for r in res.factors.collect()}
    for m in range(3):
        for i in range(dims[m]):
            want = final[m][i]
            have = got.get((m, i + 1), [0.0, 0.0, 0.0])
            assert np.allclose(have, want, atol=1e-8), (m, i + 1)


def test_schedule_once_equals_full_projection(spark):
    """If the old model reproduces region 000 exactly, the 'once' core is the
    projection of the whole tensor onto the final factors."""
    cells = activity_tensor(spark, SF0001)
    dims = tensor_stats(cells).dims
    pre = default_pre_dims(dims)
    blocks, grams, core = start_model(spark, pre, (3, 3, 3))
    old = {}
    for m in range(3):
        rows = sorted(blocks[m].collect(), key=lambda r: r["idx"])
        old[m] = np.array([[r[f"c{q}"] for q in range(3)] for r in rows])
    x = np.zeros(dims)
    for r in cells.collect():
        x[r["i"] - 1, r["j"] - 1, r["k"] - 1] += r["val"]
    x000 = np.einsum("pqr,ip,jq,kr->ijk", core, old[0], old[1], old[2])
    x[: pre[0], : pre[1], : pre[2]] = x000
    res = incremental_update(cells, blocks, core, pre, (3, 3, 3), partition=None, gram_old=grams)
    f = {m: np.zeros((dims[m], 3)) for m in range(3)}
    for r in res.factors.collect():
        f[r["mode"]][r["idx"] - 1] = [r["c0"], r["c1"], r["c2"]]
    proj = np.einsum("ijk,ip,jq,kr->pqr", x, f[0], f[1], f[2])
    assert np.allclose(res.core_array, proj, rtol=1e-9, atol=1e-7)
    published = incremental_update(cells, blocks, core, pre, (3, 3, 3), partition=None, gram_old=grams,
                                   core_schedule="as_published")
    assert not np.allclose(published.core_array, proj, rtol=1e-6, atol=1e-6)


def test_mixed_ranks_match_dense_model(spark):
    cells = activity_tensor(spark, SF0001)
    dims = tensor_stats(cells).dims
    pre = default_pre_dims(dims)
    ranks = (2, 3, 2)
    blocks, grams, core = start_model(spark, pre, ranks)
    res = incremental_update(cells, blocks, core, pre, ranks, partition="greedy", gram_old=grams)
    x = np.zeros(dims)
    for r in cells.collect():
        x[r["i"] - 1, r["j"] - 1, r["k"] - 1] += r["val"]
    old = {}
    for m in range(3):
        rows = sorted(blocks[m].collect(), key=lambda r: r["idx"])
        old[m] = np.array([[r[f"c{q}"] for q in range(ranks[m])] for r in rows])
    final, g = dense_update(x, pre, old, core, 0.8, "once")
    assert res.core_array.shape == ranks
    assert np.allclose(res.core_array, g, rtol=1e-8, atol=1e-8)
    got = {(r["mode"], r["idx"]): [r[f"c{q}"] for q in range(ranks[r["mode"]])] for r in res.factors.collect()}
    for m in range(3):
        for i in range(dims[m]):
            assert np.allclose(got.get((m, i + 1), [0.0] * ranks[m]), final[m][i], atol=1e-8)


def test_mode_without_growth(spark):
    """pre_dims equal to dims in mode 2: its new block stays empty, the
    regions needing it are skipped, and the rest still matches the model."""
    import warnings

    cells = activity_tensor(spark, SF0001)
    dims = tensor_stats(cells).dims
    pre = (dims[0] * 4 // 5, dims[1] * 4 // 5, dims[2])
    blocks, grams, core = start_model(spark, pre, (3, 3, 3))
    res = incremental_update(cells, blocks, core, pre, (3, 3, 3), partition="bucket", gram_old=grams)
    names = {(r["name"], r["region"], r["mode"]) for r in res.metrics.collect()}
    assert ("empty_region", "001", 2) in names
    x = np.zeros(dims)
    for r in cells.collect():
        x[r["i"] - 1, r["j"] - 1, r["k"] - 1] += r["val"]
    old = {}
    for m in range(3):
        rows = sorted(blocks[m].collect(), key=lambda r: r["idx"])
        old[m] = np.array([[r[f"c{q}"] for q in range(3)] for r in rows])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        final, g = dense_update(x, pre, old, core, 0.8, "once")
    assert np.allclose(res.core_array, g, rtol=1e-8, atol=1e-8)
    got = {(r["mode"], r["idx"]): [r["c0"], r["c1"], r["c2"]] for r in res.factors.collect()}
    assert max(idx for m, idx in got if m == 2) == dims[2]
    for m in range(3):
        for i in range(dims[m]):
            assert np.allclose(got.get((m, i + 1), [0.0] * 3), final[m][i], atol=1e-8)


def frame(spark, x):
    rows = [(int(i) + 1, int(j) + 1, int(k) + 1, float(x[i, j, k])) for i, j, k in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, "i long, j long, k long, val double")


def check_against_dense(spark, x, pre, ranks, tol=1e-9, **options):
    """One update of ``x`` against the dense model; returns the result."""
    blocks, grams, core = start_model(spark, pre, ranks)
    res = incremental_update(frame(spark, x), blocks, core, pre, ranks, gram_old=grams, **options)
    old = {}
    for m in range(3):
        rows = sorted(blocks[m].collect(), key=lambda r: r["idx"])
        old[m] = np.array([[r[f"c{q}"] for q in range(ranks[m])] for r in rows])
    final, g = dense_update(x, pre, old, core, options.get("mu", 0.8), "once")
    scale = max(1.0, np.abs(g).max())
    assert np.abs(res.core_array - g).max() <= tol * scale
    got = {(r["mode"], r["idx"]): [r[f"c{q}"] for q in range(ranks[r["mode"]])] for r in res.factors.collect()}
    for m in range(3):
        for i in range(x.shape[m]):
            assert np.allclose(got.get((m, i + 1), [0.0] * ranks[m]), final[m][i], rtol=0, atol=tol), (m, i + 1)
    return res


def test_row_whose_cells_all_meet_zero_rows_is_blended(spark):
    """A new j without a cell in region 010 is a zero row until its C2 step; a
    new i whose only 110 cells stand there has cells, and a zero update."""
    x = np.random.default_rng(3).integers(1, 9, size=(8, 8, 8)).astype(float)
    pre = (5, 5, 5)
    x[:5, 7, :5] = 0      # j = 8: nothing in region 010
    x[7, 5:7, :5] = 0     # i = 8: in region 110 only at j = 8
    check_against_dense(spark, x, pre, (2, 2, 2), partition=None)


def test_sparse_tensor(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(1, 9, size=(30, 28, 26)).astype(float) * (rng.random((30, 28, 26)) < 0.02)
    check_against_dense(spark, x, (20, 19, 18), (2, 2, 2), partition="bucket")


def test_rank_ten(spark):
    x = np.random.default_rng(5).integers(0, 9, size=(28, 26, 24)).astype(float)
    check_against_dense(spark, x, (16, 15, 13), (10, 10, 10), tol=1e-7, partition=None)


@pytest.mark.parametrize("scale", [1e-9, 1e9])
def test_scale_of_the_values_does_not_matter(spark, scale):
    x = np.random.default_rng(7).integers(1, 9, size=(8, 8, 8)).astype(float)
    res = check_against_dense(spark, x * scale, (5, 5, 5), (2, 2, 2), partition=None)
    assert not res.metrics.where("name = 'rank_deficient'").count()


def test_non_finite_values_fail(spark):
    x = np.ones((4, 4, 4))
    for bad in (float("nan"), float("inf")):
        x[3, 3, 3] = bad
        blocks, grams, core = start_model(spark, (3, 3, 3), (1, 1, 1))
        with pytest.raises(ValueError, match="not finite"):
            incremental_update(frame(spark, x), blocks, core, (3, 3, 3), (1, 1, 1), gram_old=grams)


def test_orthonormalisation_is_free_of_scale():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(50, 4))
    q = mgs(a)
    for s in (1e-12, 1.0, 1e12):
        t, deficient = la.mgs_transform((s * a).T @ (s * a))
        assert not deficient and np.allclose(s * a @ t, q, atol=1e-9)
    b = a * np.array([1.0, 1e-8, 1.0, 1e5])
    t, deficient = la.mgs_transform(b.T @ b)
    assert not deficient and np.allclose(b @ t, q, atol=1e-9)
    c = a.copy()
    c[:, 2] = c[:, 0] - 2 * c[:, 1]
    t, deficient = la.mgs_transform(c.T @ c)
    assert deficient and np.allclose(t[:, 2], 0)
    with pytest.raises(ValueError):
        la.mgs_transform(np.array([[np.nan]]))


def test_chained_updates_read_one_table(spark):
    """The factors of an update are one stored table, however many came before."""
    rng = np.random.default_rng(2)
    dims, ranks = (6, 6, 6), (2, 2, 2)
    factors, grams, core = start_model(spark, dims, ranks)
    sizes = []
    for _ in range(4):
        pre, dims = dims, tuple(d + 3 for d in dims)
        x = rng.integers(1, 9, size=dims).astype(float)
        x[:pre[0], :pre[1], :pre[2]] = 0
        res = incremental_update(frame(spark, x), factors, core, pre, ranks, partition=None, gram_old=grams)
        res.release()
        factors, core, grams = res.factors, res.core_array, None
        sizes.append(len(factors._jdf.queryExecution().optimizedPlan().toString()))
        assert factors.count() == sum(dims)
    assert max(sizes) <= min(sizes) + 40  # digits of the paths and ids
