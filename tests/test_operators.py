"""Operator properties on data derived from the given tables."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF0001
from tridelta.functions import linalg as la
from tridelta.functions.index import REGIONS
from tridelta.operators import core as co
from tridelta.operators import factors as fo
from tridelta.operators import kernel as ke
from tridelta.operators import tensor as te
from tridelta.sources.tables import activity_tensor, default_pre_dims, sales_tensor


def test_fold_matricize_identity(spark):
    ranks = (2, 3, 4)
    core = co.init_core(spark, ranks)
    base = sorted(tuple(r) for r in core.collect())
    for m in range(3):
        back = co.fold(co.matricize(core, m, ranks), m, ranks)
        assert sorted(tuple(r) for r in back.collect()) == base
    arr = np.random.default_rng(1).random(ranks)
    for m in range(3):
        assert np.allclose(la.fold(la.unfold(arr, m), m, ranks), arr)


def test_regions_partition_cells(spark):
    cells = sales_tensor(spark, SF0001)
    st = te.tensor_stats(cells)
    pre = default_pre_dims(st.dims)
    st2 = te.tensor_stats(cells, pre)
    assert sum(st2.region_cells.values()) == st.cells
    lab = te.cut_regions(cells, pre)
    counts = {r["region"]: r["count"] for r in lab.groupBy("region").count().collect()}
    assert set(counts) <= set(REGIONS)
    assert all(counts[r] == st2.region_cells[r] for r in counts)


def test_orthonormalize_gives_identity_gram(spark):
    f = fo.init_factor(spark, 0, 1, 500, 3)
    q, t, g_q, deficient = fo.orthonormalize(f, 3)
    assert not deficient
    assert np.allclose(fo.gram(q, 3), np.eye(3), atol=1e-12)
    a = np.array([[r["c0"], r["c1"], r["c2"]] for r in f.orderBy("idx").collect()])
    qn, rn = np.linalg.qr(a)
    qn = qn * np.sign(np.diag(rn))
    got = np.array([[r["c0"], r["c1"], r["c2"]] for r in q.orderBy("idx").collect()])
    assert np.allclose(got, qn, atol=1e-12)


def test_orthonormalize_flags_dependent_columns(spark):
    f = spark.range(1, 50).selectExpr("id AS idx", "CAST(id AS DOUBLE) AS c0", "CAST(2 * id AS DOUBLE) AS c1")
    q, _, _, deficient = fo.orthonormalize(f, 2)
    assert deficient
    assert np.isfinite([r["c1"] for r in q.collect()]).all()


def test_gram_update_equals_pinv_update_on_orthonormal_blocks(spark):
    cells = activity_tensor(spark, SF0001)
    pre = default_pre_dims(te.tensor_stats(cells).dims)
    region = te.cut_regions(cells, pre).where("region = '100'")
    a, _, _, _ = fo.orthonormalize(fo.init_factor(spark, 1, 1, pre[1], 3), 3)
    b, _, _, _ = fo.orthonormalize(fo.init_factor(spark, 2, 1, pre[2], 3), 3)
    dims = te.tensor_stats(cells).dims
    core = co.start_core_array((3, 3, 3))
    u1 = ke.update_factor(region, 0, core, a, 3, pre[1], b, 3, pre[2])
    u2 = ke.update_factor_gram(region, 0, core, a, 3, pre[1], b, 3, pre[2], pre, dims)
    x = {r["idx"]: np.array(r[1:]) for r in u1.collect()}
    y = {r["idx"]: np.array(r[1:]) for r in u2.collect()}
    assert x.keys() == y.keys()
    assert all(np.allclose(x[k], y[k], rtol=1e-9, atol=1e-9) for k in x)


def test_core_contribution_same_from_every_mode(spark):
    cells = activity_tensor(spark, SF0001)
    dims = te.tensor_stats(cells).dims
    blocks = {m: fo.init_factor(spark, m, 1, dims[m], 3) for m in range(3)}
    whole = ke.contract_all(cells, blocks, (3, 3, 3), dict(enumerate(dims)))
    for m in (1, 2):
        a, b = [x for x in range(3) if x != m]
        t = ke.ttm_chain(cells, m, blocks[a], 3, dims[a], blocks[b], 3, dims[b])
        j = t.join(fo.rename_cols(blocks[m], 3, "idx", "u"), "idx")
        row = j.agg(*[F.expr(f"sum(u{p} * t{c}) AS m{p}_{c}") for p in range(3) for c in range(9)]).collect()[0]
        mat = np.array([[row[f"m{p}_{c}"] for c in range(9)] for p in range(3)])
        assert np.allclose(la.fold(mat, m, (3, 3, 3)), whole, rtol=1e-12)


def test_blend_without_new_cells_is_identity(spark):
    prev = fo.init_factor(spark, 0, 1, 20, 3)
    empty = spark.createDataFrame([], "idx long, c0 double, c1 double, c2 double")
    out = fo.blend_factor(prev, empty, 3, 0.8)
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in prev.collect())


def test_factor_layout_round_trip(spark):
    f = fo.combine({0: (fo.init_factor(spark, 0, 1, 7, 3), 3), 1: (fo.init_factor(spark, 1, 2, 5, 3), 3)}, 3)
    back = fo.to_wide(fo.to_long(f, 3), 3, dims={0: 7, 1: 5})
    rows = {(r["mode"], r["idx"]): tuple(r[2:]) for r in back.collect()}
    assert rows[(1, 1)] == (0.0, 0.0, 0.0)
    assert all(rows[(r["mode"], r["idx"])] == tuple(r[2:]) for r in f.collect())


def test_random_start_model_is_orthonormal(spark):
    from tridelta.plans.job import start_model

    blocks, grams, core = start_model(spark, (50, 20, 10), (3, 3, 3), kind="random", seed=5)
    assert core.shape == (3, 3, 3)
    for m in range(3):
        assert np.allclose(fo.gram(blocks[m], 3), np.eye(3), atol=1e-10)
        assert np.allclose(grams[m], np.eye(3), atol=1e-10)


def test_fused_update_and_blend_equals_update_then_blend(spark):
    cells = activity_tensor(spark, SF0001)
    dims = te.tensor_stats(cells).dims
    pre = default_pre_dims(dims)
    region = te.cut_regions(cells, pre).where("region = '110'")
    core = co.start_core_array((3, 3, 3))
    a = fo.init_factor(spark, 1, 1, dims[1], 3)
    b = fo.init_factor(spark, 2, 1, pre[2], 3)
    prev = fo.init_factor(spark, 0, pre[0] + 1, dims[0] - 1, 3)   # one new row has no previous value
    two = fo.blend_factor(prev, ke.update_factor(region, 0, core, a, 3, dims[1], b, 3, pre[2]), 3, 0.8)
    one = ke.update_and_blend(region, 0, core, a, 3, dims[1], b, 3, pre[2], prev, 3, 0.8)
    x = {r["idx"]: np.array(r[1:]) for r in two.collect()}
    y = {r["idx"]: np.array(r[1:]) for r in one.collect()}
    assert x.keys() == y.keys()
    assert all(np.allclose(x[k], y[k], rtol=1e-12, atol=1e-12) for k in x)


def test_blocks_equal_columns_at_high_rank(spark, monkeypatch):
    """The segment reduction against a column per entry, cells at absent rows
    (which count as zero) and an empty region included, in blocks of a few cells."""
    cells = activity_tensor(spark, SF0001)
    dims = te.tensor_stats(cells).dims
    rng = np.random.default_rng(3)
    right = rng.normal(size=(90, 4))
    a = fo.init_factor(spark, 1, 1, dims[1], 9).where("idx % 3 > 0")
    b = fo.init_factor(spark, 2, 1, dims[2], 10)
    args = a, 9, dims[1], b, 10, dims[2]
    for keep in (False, True):
        monkeypatch.setattr(ke, "BLOCK_VALUES", 90 * 37)
        got = {r["idx"]: np.array(r[1:]) for r in ke.project_by_blocks(cells, 0, right, *args, keep_cells=keep).collect()}
        t = ke.ttm_chain(cells, 0, *args, layout="wide", keep_cells=keep)
        want = {r["idx"]: np.array([r[f"t{c}"] for c in range(90)]) @ right for r in t.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)
    assert ke.project_by_blocks(cells.where("i < 0"), 0, right, *args).count() == 0


def test_core_by_slabs_equals_columns(spark, monkeypatch):
    cells = activity_tensor(spark, SF0001)
    dims = te.tensor_stats(cells).dims
    blocks = {m: fo.init_factor(spark, m, 1, dims[m], 3) for m in range(3)}
    blocks[0] = blocks[0].where("idx % 4 > 0")
    want = ke.contract_all(cells, blocks, (3, 3, 3), dict(enumerate(dims)))
    monkeypatch.setattr(ke, "SUM_LIMIT", 1)
    assert np.array_equal(ke.contract_all(cells, blocks, (3, 3, 3), dict(enumerate(dims))), want)
    frame = {(r["p"], r["q"], r["r"]): r["g"] for r in ke.contract_frame(cells, blocks, (3, 3, 3), dict(enumerate(dims))).collect()}
    assert frame == {(p + 1, q + 1, r + 1): want[p, q, r] for p in range(3) for q in range(3) for r in range(3)}
    assert not ke.contract_all(cells.where("i < 0"), blocks, (3, 3, 3), dict(enumerate(dims))).any()
