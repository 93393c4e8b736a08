"""Cells stored by bin: where they lie, what the kernel exchanges, what it returns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from tridelta.functions.index import MODES, other_modes
from tridelta.operators import kernel as ke
from tridelta.operators import partition as po
from tridelta.operators.core import start_core_array
from tridelta.operators.tensor import tensor_stats
from tridelta.plans import update as up
from tridelta.plans.catalog import TASKS, Setup
from tridelta.plans.job import start_model
from tridelta.sources.tables import default_pre_dims, sales_tensor


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.split("\n") if "Exchange" in x]
    return sum("BroadcastExchange" not in x for x in lines)


def stored_tables(spark):
    return [r["tableName"] for r in spark.sql("SHOW TABLES").collect() if r["tableName"].startswith("tridelta_")]


@pytest.fixture(scope="module")
def staged(spark):
    s = Setup(spark, SF0001)
    ctx = up.prepare(s.cells, s.pre, (2, 2, 2))
    part_map, _, _ = up.partition_stage(ctx, 5, "bucket")
    return s, ctx, part_map


def test_one_task_per_bin(spark, staged):
    s, ctx, part_map = staged
    rows = ctx.by_bin.whole.groupBy("bin_key", "region", "mode", "part_id").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("task", F.spark_partition_id()).collect()
    assert all(r["task"] == r["part_id"] - 1 for r in rows)
    want = {(r["region"], r["mode"], r["part_id"]): r["load"] for r in po.partition_loads(part_map).collect()}
    assert {(r["region"], r["mode"], r["part_id"]): r["n"] for r in rows} == want


@pytest.mark.parametrize("n", [1, 5, 12, 100])
def test_bin_keys_hit_their_bucket(spark, n):
    keys = po.bin_keys(spark, n)
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select(F.pmod(F.hash("k"), F.lit(n)).alias("b")).collect()
    assert [r["b"] for r in rows] == list(range(n))


def test_the_kernel_exchanges_nothing(staged):
    s, ctx, _ = staged
    for region, mode in TASKS:
        a, b = other_modes(mode)
        blocks = *s.block(region, a), *s.block(region, b)
        in_place = ke.update_by_bin(*ctx.by_bin.cells(region, mode), mode, start_core_array((3, 3, 3)), *blocks)
        usual = ke.update_factor(ctx.region(region), mode, start_core_array((3, 3, 3)), *blocks)
        assert (exchanges(in_place), exchanges(usual)) == (0, 1)
        key = lambda df: sorted(tuple(r) for r in df.collect())
        assert np.allclose(key(in_place), key(usual), rtol=1e-12)


def test_a_heavy_bin_is_split(spark, staged):
    """One slice with most of the cells: its bin is summed over an exchange, the
    others stay in place."""
    s, ctx, _ = staged
    hot = ctx.cells.where("region = '100'").limit(1).head()["i"]
    cells = ctx.cells.selectExpr("region", f"CASE WHEN region = '100' AND (j + k) % 2 = 0 THEN {hot} ELSE i END AS i", "j", "k", "val")
    from tridelta.operators.tensor import slice_nnz

    part_map = po.bucket_map(slice_nnz(cells), 5, 1000)
    loads = {(r["region"], r["mode"], r["part_id"]): r["load"] for r in po.partition_loads(part_map).collect()}
    layout = po.store_by_bin(cells, part_map, 5, 1000, loads, heavy=2.0, least=50)
    assert [g[:2] for g in layout.split_bins].count(("100", 0)) == 1
    blocks = *s.block("100", 1), *s.block("100", 2)
    whole, split = layout.cells("100", 0)
    rows = ke.ttm_by_bin(whole, split, 0, *blocks)
    assert exchanges(rows) == 1
    want = ke.ttm_chain(cells.where("region = '100'"), 0, *blocks)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))
    assert whole.count() + split.count() == cells.where("region = '100'").count()


def test_the_update_is_the_same_with_and_without_bins(spark):
    cells = sales_tensor(spark, SF0001)
    pre = default_pre_dims(tensor_stats(cells).dims)
    blocks, grams, core = start_model(spark, pre, (2, 2, 2))
    found = {}
    for partition in (None, "bucket", "greedy"):
        res = up.incremental_update(cells, blocks, core, pre, (2, 2, 2), partition=partition, cut_num=5, gram_old=grams)
        found[partition] = res.core_array, np.array(sorted(tuple(r) for r in res.factors.collect()))
        named = stored_tables(spark)
        res.release(results=True)
        assert len(named) - len(stored_tables(spark)) == (partition is not None)
    for core_array, factors in found.values():
        assert np.allclose(core_array, found[None][0], rtol=1e-9)
        assert np.allclose(factors, found[None][1], atol=1e-9)
