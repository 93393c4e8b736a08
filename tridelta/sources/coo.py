"""Coordinate text format: one cell per line, ``i,j,k,value``, no header,
1-based indices. Indices may be written as doubles; they are truncated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_SCHEMA = "i double, j double, k double, val double, bad_line string"


def read_coo(spark: SparkSession, path: str) -> DataFrame:
    """Read cells; a malformed line, or one without all four numbers, fails the
    job (no silent skipping).

    Spark parses only the columns that a query needs, and FAILFAST then sees
    only those. The filter below needs all of them, so every line is parsed
    whole and looked at, even to count the lines."""
    raw = (spark.read.schema(RAW_SCHEMA).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "bad_line").csv(path))
    whole = F.col("bad_line").isNull()
    for name in ("i", "j", "k", "val"):
        whole = whole & F.col(name).isNotNull()
    problem = F.concat(F.lit("malformed line: "), F.coalesce("bad_line", F.lit("a number is missing")))
    raw = raw.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(problem).cast("boolean")))
    return raw.select(
        F.col("i").cast("long").alias("i"),
        F.col("j").cast("long").alias("j"),
        F.col("k").cast("long").alias("k"),
        F.col("val"),
    )


def write_coo(cells: DataFrame, path: str) -> None:
    cells.select("i", "j", "k", "val").write.mode("overwrite").csv(path)
