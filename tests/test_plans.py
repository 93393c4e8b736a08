"""Physical plan shape of the hot paths."""

import numpy as np

from conftest import SF0001
from tridelta.operators import factors as fo
from tridelta.operators import kernel as ke
from tridelta.operators import tensor as te
from tridelta.session import stash
from tridelta.sources.tables import default_pre_dims, sales_tensor


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kernel_plan_one_exchange_broadcast_factors(spark):
    cells = sales_tensor(spark, SF0001)
    pre = default_pre_dims(te.tensor_stats(cells).dims)
    lab = stash(te.cut_regions(cells, pre), "plan-cells", partition_by=["region"])
    a = fo.init_factor(spark, 1, 1, pre[1], 2)
    b = fo.init_factor(spark, 2, 1, pre[2], 2)
    t = ke.ttm_chain(lab.where("region = '100'"), 0, a, 2, pre[1], b, 2, pre[2])
    plan = _plan(t)
    assert plan.count("BroadcastHashJoin") == 2
    assert "SortMergeJoin" not in plan
    # partial + final aggregation around a single shuffle of the cells side
    assert plan.count("HashAggregate") == 2
    assert plan.count(" Exchange hashpartitioning(") == 1 and plan.count("BroadcastExchange") == 2
    assert "PartitionFilters: [isnotnull(region" in plan


def test_blend_is_one_exchange_at_small_ranks(spark):
    cells = stash(spark.createDataFrame([(1, 1, 1, 1.0)], "i long, j long, k long, val double"), "plan-cells3")
    a, b, prev = (fo.init_factor(spark, m, 1, 4, 2) for m in range(3))
    core = np.arange(8.0).reshape(2, 2, 2)
    plan = _plan(ke.update_and_blend(cells, 0, core, a, 2, 4, b, 2, 4, prev, 2, 0.8))
    assert plan.count(" Exchange hashpartitioning(") == 1
    assert plan.count("LeftOuter") == 2  # cells at absent rows stay


def test_grouped_cells_take_one_exchange(spark):
    from tridelta.operators import partition as po

    cells = stash(spark.createDataFrame([("100", 0, 1, 2)], "region string, mode int, i long, part_id int"), "plan-cells4")
    plan = _plan(po.group_by_part(cells, 12))
    assert plan.count("Exchange ") == 1


def test_large_factor_is_not_hinted_without_pruning(spark):
    cells = spark.createDataFrame([(1, 1, 1, 1.0)], "i long, j long, k long, val double")
    a = fo.init_factor(spark, 1, 1, 10, 2)
    j = fo.factor_lookup(cells, a, "j", 2, "a", 10 ** 9)  # bound above the limit
    assert "ResolvedHint" not in j._jdf.queryExecution().analyzed().toString()


def test_region_filter_reaches_scan(spark):
    cells = sales_tensor(spark, SF0001)
    pre = default_pre_dims(te.tensor_stats(cells).dims)
    lab = stash(te.cut_regions(cells, pre), "plan-cells2", partition_by=["region"])
    plan = _plan(lab.where("region = '111'").select("i", "val"))
    assert "PartitionFilters" in plan and "111" in plan
    assert "ReadSchema: struct<i:bigint,val:double>" in plan


def _all_plans(df):
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString() + qe.optimizedPlan().toString()


def test_no_single_partition_funnel(spark):
    """Partition maps and the kernel never gather a group into one task:
    no SinglePartition exchange and no window without partition keys."""
    from tridelta.operators import partition as po

    cells = sales_tensor(spark, SF0001)
    pre = default_pre_dims(te.tensor_stats(cells).dims)
    hist = te.slice_nnz(te.cut_regions(cells, pre))
    plans = [
        po.bucket_map(hist, 12, 200),
        po.prefix_sums(hist, 200),
        po.partition_cv(po.bucket_loads(po.bucket_runs(hist, 12))),
    ]
    for df in plans:
        text = _all_plans(df)
        assert "SinglePartition" not in text
        windows = [ln for ln in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in ln]
        assert all(", [], [" not in ln for ln in windows)


def test_oversized_factor_is_pruned_to_touched_rows(spark, monkeypatch):
    """A block whose bound is over the limit is cut to the rows that the
    region's cells touch; they are stored and counted once for all steps, and
    the plan builder itself runs nothing."""
    from tridelta.operators import factors as fo2
    from tridelta.plans import update as up

    cells = spark.createDataFrame([(11, 3, 1, 2.0), (12, 5, 1, 1.0)], "i long, j long, k long, val double")
    ctx = up.prepare(cells, (10, 1000, 1), (2, 2, 2))
    old = {m: up.Block(fo2.init_factor(spark, m, 1, ctx.pre_dims[m], 2), ctx.pre_dims[m], np.eye(2)) for m in range(3)}
    monkeypatch.setattr(fo2, "DEFAULT_BROADCAST_LIMIT", 10_000)  # 1000 rows x 40 B is over, 2 rows are under
    block, rank, bound = up._lookup(ctx, "100", 1, old, {})
    assert bound == 2 and sorted(r.idx for r in block.collect()) == [3, 5]
    again = up._lookup(ctx, "100", 1, old, {})[0]
    assert len(ctx.touched_rows) == 1 and again.count() == 2
    t = ke.ttm_chain(ctx.region("100"), 0, block, rank, bound, old[2].df, 2, 1)
    full = ke.ttm_chain(ctx.region("100"), 0, old[1].df, 2, 10, old[2].df, 2, 1)
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, full.collect()))
