"""Core-tensor operators on the long table ``(p, q, r, g)`` (1-based).

The core has r0*r1*r2 entries (a model parameter, not data), so the update
keeps it as a NumPy array on the driver; these DataFrame forms
work on long tables of any size and are what the SQL checks compare."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import CORE_MOD, CORE_P, CORE_Q, CORE_R
from ..functions.index import other_modes

CORE_COLS = ("p", "q", "r")


def init_core(spark: SparkSession, ranks, kind: str = "formula", seed: int | None = None) -> DataFrame:
    """All coordinates of an r0 x r1 x r2 core with a start value; one
    ``range`` split by div/mod (row-major: r fastest)."""
    r0, r1, r2 = (int(x) for x in ranks)
    n = F.col("id")
    p = (n / F.lit(r1 * r2)).cast("long") + 1
    q = ((n / F.lit(r2)).cast("long") % F.lit(r1)) + 1
    r = (n % F.lit(r2)) + 1
    base = spark.range(r0 * r1 * r2).select(p.cast("int").alias("p"), q.cast("int").alias("q"), r.cast("int").alias("r"))
    if kind == "formula":
        g = ((F.col("p") * CORE_P + F.col("q") * CORE_Q + F.col("r") * CORE_R) % CORE_MOD + 1).cast("double")
    else:
        g = F.rand(0 if seed is None else int(seed))
    return base.select("p", "q", "r", g.alias("g"))


def start_core_array(ranks) -> np.ndarray:
    r0, r1, r2 = (int(x) for x in ranks)
    p, q, r = np.meshgrid(np.arange(1, r0 + 1), np.arange(1, r1 + 1), np.arange(1, r2 + 1), indexing="ij")
    return ((p * CORE_P + q * CORE_Q + r * CORE_R) % CORE_MOD + 1).astype(float)


def core_to_array(core: DataFrame, ranks) -> np.ndarray:
    """Collect a core (rank-sized by construction) into a dense array."""
    arr = np.zeros(tuple(int(x) for x in ranks))
    for row in core.select("p", "q", "r", "g").collect():
        arr[row["p"] - 1, row["q"] - 1, row["r"] - 1] = row["g"]
    return arr


def array_to_core(spark: SparkSession, arr: np.ndarray) -> DataFrame:
    rows = [(int(p + 1), int(q + 1), int(r + 1), float(arr[p, q, r]))
            for p in range(arr.shape[0]) for q in range(arr.shape[1]) for r in range(arr.shape[2])]
    return spark.createDataFrame(rows, "p int, q int, r int, g double")


def matricize(core: DataFrame, mode: int, ranks) -> DataFrame:
    """Mode unfolding: ``row = x_mode-1``, ``col = (x_a-1) + (x_b-1)*r_a``."""
    a, b = other_modes(mode)
    xs = [F.col(c) for c in CORE_COLS]
    return core.select(
        (xs[mode] - 1).cast("int").alias("row"),
        ((xs[a] - 1) + (xs[b] - 1) * F.lit(int(ranks[a]))).cast("int").alias("col"),
        "g",
    )


def fold(mat: DataFrame, mode: int, ranks) -> DataFrame:
    """Inverse of :func:`matricize` (overwrites: one value per coordinate)."""
    a, b = other_modes(mode)
    coord = {mode: F.col("row") + 1,
             a: (F.col("col") % F.lit(int(ranks[a]))) + 1,
             b: (F.col("col") / F.lit(int(ranks[a]))).cast("int") + 1}
    return mat.select(*[coord[m].cast("int").alias(CORE_COLS[m]) for m in range(3)], "g")


def core_add(core: DataFrame, mat: DataFrame, mode: int, ranks) -> DataFrame:
    """``core + fold(mat)``: union then one aggregation per coordinate."""
    return (
        core.select("p", "q", "r", "g").unionByName(fold(mat, mode, ranks))
        .groupBy("p", "q", "r").agg(F.sum("g").alias("g"))
    )


def core_mode_product(core: DataFrame, m: DataFrame, mode: int) -> DataFrame:
    """``core x_mode M`` with ``M`` as ``(a, b, v)`` = M[a, b] (0-based):
    new entry at x_mode = a+1 sums ``M[a, x_mode-1] * g``."""
    x = CORE_COLS[mode]
    joined = core.join(m, core[x] - 1 == m["b"], "inner")
    keys = [((F.col("a") + 1).cast("int").alias(c) if c == x else F.col(c)) for c in CORE_COLS]
    return joined.groupBy(*keys).agg(F.sum(F.col("g") * F.col("v")).alias("g"))


def matrix_frame(spark: SparkSession, mat: np.ndarray) -> DataFrame:
    rows = [(int(a), int(b), float(mat[a, b])) for a in range(mat.shape[0]) for b in range(mat.shape[1])]
    return spark.createDataFrame(rows, "a int, b int, v double")
