"""Index sets as bitmaps: the same sets, and the same factor rows, as without."""

import pytest
from pyspark.sql import functions as F

from tridelta.operators import factors as fo, tensor as te

DIMS = (70_000, 40, 32_769)
CELLS = [(1, 1, 1, 1.0), (32_768, 2, 32_768, 1.0), (32_769, 40, 32_769, 1.0), (65_536, 9, 8, 1.0), (65_537, 10, 9, 1.0),
         (70_000, 16, 17, 1.0), (70_001, 41, 32_770, 1.0), (1, 1, 1, 2.0)]  # edges of buckets and bytes, beyond dims, repeated
SCHEMA = "i bigint, j bigint, k bigint, val double"


def combined(spark):
    return fo.combine({m: (fo.init_factor(spark, m, 1, DIMS[m], 2), 2) for m in range(3)}, 2)


@pytest.mark.parametrize("cells", [CELLS, [], CELLS[-2:-1]])
def test_same_rows_as_by_sets(spark, cells):
    tensor = spark.createDataFrame(cells, SCHEMA)
    want = fo.filter_factors(combined(spark), te.line_sets(tensor, DIMS))
    got = fo.filter_factors_bitmap(combined(spark), te.line_bitmaps(tensor, DIMS), DIMS)
    assert got.columns == combined(spark).columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_all_regions_from_one_aggregation(spark):
    labelled = te.cut_regions(spark.createDataFrame(CELLS, SCHEMA), (40_000, 20, 100))
    bits = te.line_bitmaps(labelled, (10**6,) * 3, by=("region",))
    got = {(r.region, r["mode"]): r.n for r in bits.groupBy("region", "mode").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()}
    want = {}
    for r in labelled.collect():
        for m, c in enumerate("ijk"):
            want.setdefault((r.region, m), set()).add(r[c])
    assert got == {key: len(idx) for key, idx in want.items()} and len({r for r, _ in got}) > 2
    assert bits._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_factors_are_not_exchanged(spark):
    got = fo.filter_factors_bitmap(combined(spark), te.line_bitmaps(spark.createDataFrame(CELLS, SCHEMA), DIMS), DIMS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
