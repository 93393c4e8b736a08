"""What one task holds or reads does not grow with the tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from tridelta.operators import tensor as te
from tridelta.plans import catalog as cat
from tridelta.plans import update as up
from tridelta.sources import tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    day = datetime.date(1995, 1, 15)
    rows = [(k % 40, k % 7, day + datetime.timedelta(days=k % 150), float(k % 9)) for k in range(900)]
    rows += [(3, 2, day, 1.0)] * 200 + [(None, 1, day, 1.0), (1, None, day, 1.0), (1, 1, None, 1.0), (1, 1, day, None)]
    schema = "l_partkey long, l_suppkey long, l_shipdate date, l_quantity double"
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/lineitem.parquet")
    return at


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tasks_that_sum_cells_follow_the_rows(spark, folder, monkeypatch):
    want = rows(tables.sales_tensor(spark, folder))
    monkeypatch.setattr(tables, "TASK_ROWS", 64)
    many = tables.sales_tensor(spark, folder)
    assert rows(many) == want
    held = many.groupBy(F.spark_partition_id()).count().collect()
    assert many.rdd.getNumPartitions() == -(-1104 // 64) and len(held) > 8


def test_cells_are_summed_once(spark, folder):
    s = cat.Setup(spark, folder)
    assert s.dims == te.tensor_stats(tables.sales_tensor(spark, folder)).dims
    assert rows(s.cells) == rows(tables.sales_tensor(spark, folder))
    assert "Exchange" not in cat.q_unfold_index(spark, folder)._jdf.queryExecution().executedPlan().toString()


def test_cells_are_sorted_for_bitmaps_by_tasks_of_bounded_size(spark, folder, monkeypatch):
    want = rows(cat.q_filter_factors_bitmap(spark, folder)), rows(cat.q_line_bitmaps(spark, folder))
    monkeypatch.setattr(tables, "TASK_ROWS", 64)
    for made, same in zip((cat.q_filter_factors_bitmap(spark, folder), cat.q_line_bitmaps(spark, folder)), want):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert f", {-(-1104 // 64)}), REPARTITION_BY_NUM" in plan and rows(made) == same


def test_a_file_of_cells_has_a_bounded_number_of_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(up, "FILE_CELLS", 50)
    s = cat.Setup(spark, folder)
    ctx = up.prepare(s.cells, s.pre, (2, 2, 2))
    sizes = [r["count"] for r in ctx.cells.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == sum(n for r, n in ctx.region_cells.items() if r != "000") > 100 and max(sizes) <= 50
