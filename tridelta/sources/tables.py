"""Sparse three-way tensors derived from the driver's parquet tables.

``sales``: part x supplier x month, summed quantity (from ``lineitem``).
``purchases``: customer x part x order day, summed quantity (from ``orders``
and ``lineitem``).
``activity``: user x hour x day of month, event count (from ``events``).
Keys in the tables start at 0, tensor indices at 1.

A large table's rows are dealt by cell into as many tasks as their number asks
for, so that what a task holds to sum them does not grow with the table; the rows
of a small one are summed in the session's own number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL_SCHEMA = "i long, j long, k long, val double"
CELL = ("i", "j", "k")
# Rows that a task is to sum to cells, at most (in the mean).
TASK_ROWS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sum_cells(rows: DataFrame, value: Column, n_rows: int) -> DataFrame:
    """One cell per distinct ``(i, j, k)`` of ``rows``; ``n_rows``: how many there are."""
    tasks = -(-n_rows // TASK_ROWS)
    if tasks > rows.sparkSession.sparkContext.defaultParallelism:
        rows = rows.repartition(tasks, *CELL)
    return rows.groupBy(*CELL).agg(value.alias("val"))


def sales_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.where(
        F.col("l_partkey").isNotNull() & F.col("l_suppkey").isNotNull() & F.col("l_shipdate").isNotNull()
    ).select(
        (F.col("l_partkey") + 1).alias("i"),
        (F.col("l_suppkey") + 1).alias("j"),
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).cast("long").alias("k"),
        "l_quantity",
    )
    return sum_cells(rows, F.sum("l_quantity"), li.count())


def activity_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    rows = ev.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select(
        (F.col("user_id") + 1).alias("i"),
        (F.hour("ts") + 1).cast("long").alias("j"),
        F.dayofmonth("ts").cast("long").alias("k"),
    )
    return sum_cells(rows, F.count(F.lit(1)).cast("double"), ev.count())


def purchases_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer x part x order day, summed quantity: hardly any index pair
    occurs twice."""
    li, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = li.join(orders, li["l_orderkey"] == orders["o_orderkey"])
    rows = rows.where(
        F.col("o_custkey").isNotNull() & F.col("l_partkey").isNotNull() & F.col("o_orderdate").isNotNull()
    ).select(
        (F.col("o_custkey") + 1).alias("i"),
        (F.col("l_partkey") + 1).alias("j"),
        (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) + 1).cast("long").alias("k"),
        "l_quantity",
    )
    return sum_cells(rows, F.sum("l_quantity"), li.count())


TENSORS = {"sales": sales_tensor, "activity": activity_tensor, "purchases": purchases_tensor}


def tensor(spark: SparkSession, sf_dir: str, name: str = "sales") -> DataFrame:
    return TENSORS[name](spark, sf_dir)


def default_pre_dims(dims) -> tuple[int, int, int]:
    """The split used by the fixtures: the first 4/5 of every mode is 'old'."""
    return tuple(int(d) * 4 // 5 for d in dims)


# SQL (DuckDB dialect) for the same tensors, used by the oracles.
SALES_SQL = """
SELECT l_partkey + 1 AS i, l_suppkey + 1 AS j,
       CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS BIGINT) AS k,
       sum(l_quantity) AS val
FROM lineitem
WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL
GROUP BY 1, 2, 3
"""

ACTIVITY_SQL = """
SELECT user_id + 1 AS i, CAST(hour(ts) + 1 AS BIGINT) AS j, CAST(day(ts) AS BIGINT) AS k,
       CAST(count(*) AS DOUBLE) AS val
FROM events
WHERE user_id IS NOT NULL AND ts IS NOT NULL
GROUP BY 1, 2, 3
"""

PURCHASES_SQL = """
SELECT o_custkey + 1 AS i, l_partkey + 1 AS j,
       CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 1 AS BIGINT) AS k, sum(l_quantity) AS val
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_custkey IS NOT NULL AND l_partkey IS NOT NULL AND o_orderdate IS NOT NULL
GROUP BY 1, 2, 3
"""
