"""A third of the cells on one index of every mode (derived from the
activity tensor): partitioners and the whole update stay exact."""

import numpy as np
from pyspark.sql import functions as F

from brute import greedy_labels, lpt_labels
from conftest import SF0001
from test_model import dense_update
from tridelta.operators import partition as po
from tridelta.operators import tensor as te
from tridelta.plans.job import start_model
from tridelta.plans.update import incremental_update
from tridelta.sources.tables import activity_tensor, default_pre_dims


def _skewed(spark):
    cells = activity_tensor(spark, SF0001)
    dims = te.tensor_stats(cells).dims
    hot = F.abs(F.hash("i", "j", "k")) % 3 == 0   # about a third of the cells
    out = cells.select(
        F.when(hot, F.lit(dims[0])).otherwise(F.col("i")).alias("i"),
        F.when(hot, F.lit(dims[1])).otherwise(F.col("j")).alias("j"),
        F.when(hot, F.lit(dims[2])).otherwise(F.col("k")).alias("k"),
        "val",
    )
    return out.groupBy("i", "j", "k").agg(F.sum("val").alias("val"))


def test_partitioners_with_a_hot_slice(spark):
    cells = _skewed(spark)
    dims = te.tensor_stats(cells).dims
    pre = default_pre_dims(dims)
    hist = te.slice_nnz(te.cut_regions(cells, pre))
    rows = hist.collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["region"], r["mode"]), {})[r["slice"]] = r["nnz"]
    top = max(max(g.values()) / sum(g.values()) for g in groups.values())
    assert top > 0.2  # a hot slice really is there
    greedy = {(r["region"], r["mode"], r["slice"]): r["part_id"]
              for r in po.greedy_map(hist, 12, dict(enumerate(dims))).collect()}
    bucket = {(r["region"], r["mode"], r["slice"]): r["part_id"]
              for r in po.bucket_map(hist, 12, max(dims)).collect()}
    for (region, mode), g in groups.items():
        dense = [g.get(s, 0) for s in range(dims[mode] + 1)]
        want_g = greedy_labels(dense, 12)
        want_b = lpt_labels(dense, 12)
        for s in g:
            assert greedy[(region, mode, s)] == want_g[s]
            assert bucket[(region, mode, s)] == want_b[s]


def test_update_with_hot_indices_matches_dense_model(spark):
    cells = _skewed(spark)
    dims = te.tensor_stats(cells).dims
    pre = default_pre_dims(dims)
    blocks, grams, core = start_model(spark, pre, (3, 3, 3))
    res = incremental_update(cells, blocks, core, pre, (3, 3, 3), partition="greedy", gram_old=grams)
    x = np.zeros(dims)
    for r in cells.collect():
        x[r["i"] - 1, r["j"] - 1, r["k"] - 1] += r["val"]
    old = {}
    for m in range(3):
        rows = sorted(blocks[m].collect(), key=lambda r: r["idx"])
        old[m] = np.array([[r[f"c{q}"] for q in range(3)] for r in rows])
    final, g = dense_update(x, pre, old, core, 0.8, "once")
    assert np.allclose(res.core_array, g, rtol=1e-8, atol=1e-8)
    got = {(r["mode"], r["idx"]): [r["c0"], r["c1"], r["c2"]] for r in res.factors.collect()}
    for m in range(3):
        for i in range(dims[m]):
            assert np.allclose(got.get((m, i + 1), [0.0] * 3), final[m][i], atol=1e-8)


def test_a_hot_bin_can_be_spread(spark):
    rows = [("100", 0, 5, j, k, 1.0, 2) for j in range(40) for k in range(25)] + [("100", 0, 6, 1, 1, 1.0, 1)]
    cells = spark.createDataFrame(rows, "region string, mode int, i long, j long, k long, val double, part_id int")
    one = po.group_by_part(cells, 3).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert {r["p"]: r["count"] for r in one} == {0: 1, 1: 1000}
    four = {r["p"]: r["count"] for r in po.group_by_part(cells, 3, spread=4).groupBy(F.spark_partition_id().alias("p")).count().collect()}
    hot = [four.get(p, 0) for p in range(4, 8)]
    assert sum(hot) == 1000 and max(hot) < 400 and sum(four.values()) == 1001
