"""Operators on the cell table ``(i, j, k, val)``: region cut, dimensions,
slice histograms, skew, index sets. All are single-pass DataFrame plans;
aggregations run partial (map-side) then final, so a hot index costs one
row per task before the shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.index import COORD, MODES, REGIONS, coord, local_index, region_expr


def cut_regions(cells: DataFrame, pre_dims, keep_old: bool = False) -> DataFrame:
    """Label each cell with its region code; drop region ``000`` (already in
    the old model) unless ``keep_old``. On a stored tensor the disjunction on
    raw coordinates reaches the scan; the update validates every row first and
    so reads them all."""
    out = cells
    if not keep_old:
        out = out.where(
            (F.col("i") > F.lit(int(pre_dims[0]))) | (F.col("j") > F.lit(int(pre_dims[1])))
            | (F.col("k") > F.lit(int(pre_dims[2])))
        )
    return out.withColumn("region", region_expr(pre_dims))


def mode_dims(cells: DataFrame) -> DataFrame:
    """One row: the largest index per mode (dims are inferred from data)."""
    return cells.agg(*[F.max(c).alias(f"dim{m}") for m, c in enumerate(COORD)])


def cell_count(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count(F.lit(1)).alias("cells"))


@dataclass(frozen=True)
class TensorStats:
    dims: tuple[int, int, int]
    cells: int
    region_cells: dict


def stats_aggs(pre_dims=None) -> list:
    """Aggregates of :func:`tensor_stats` (also usable as observed metrics)."""
    aggs = [F.expr("count(1) AS n")]
    for m, c in enumerate(COORD):
        aggs += [F.expr(f"max({c}) AS max{m}"), F.expr(f"min({c}) AS min{m}")]
    aggs.append(F.expr("sum(CASE WHEN i IS NULL OR j IS NULL OR k IS NULL OR val IS NULL THEN 1 ELSE 0 END) AS nulls"))
    aggs.append(F.expr("sum(CASE WHEN isnan(val) OR abs(val) = double('Infinity') THEN 1 ELSE 0 END) AS not_finite"))
    if pre_dims is not None:
        p0, p1, p2 = (int(x) for x in pre_dims)
        code = (f"concat(CAST(CAST(i > {p0} AS INT) AS STRING), CAST(CAST(j > {p1} AS INT) AS STRING), "
                f"CAST(CAST(k > {p2} AS INT) AS STRING))")
        for r in ("000",) + REGIONS:
            aggs.append(F.expr(f"sum(CASE WHEN {code} = '{r}' THEN 1 ELSE 0 END) AS r{r}"))
    return aggs


def tensor_stats(cells: DataFrame, pre_dims=None) -> TensorStats:
    """Dims, validation and (with ``pre_dims``) cells per region in one job.
    Indices below 1, nulls and values that are not finite fail with a message
    instead of dropping rows."""
    return stats_from_row(cells.agg(*stats_aggs(pre_dims)).collect()[0].asDict(), pre_dims)


def stats_from_row(row: dict, pre_dims=None) -> TensorStats:
    n = int(row["n"] or 0)
    if n and (row["nulls"] or 0) > 0:
        raise ValueError(f"tensor has {row['nulls']} cells with a null coordinate or value")
    if n and (row["not_finite"] or 0) > 0:
        raise ValueError(f"tensor has {row['not_finite']} cells with a value that is not finite")
    if n and min(int(row[f"min{m}"]) for m in MODES) < 1:
        raise ValueError("tensor indices are 1-based; found an index below 1")
    dims = tuple(int(row[f"max{m}"] or 0) for m in MODES)
    regions = {}
    if pre_dims is not None:
        regions = {r: int(row[f"r{r}"] or 0) for r in ("000",) + REGIONS}
    return TensorStats(dims=dims, cells=n, region_cells=regions)


def region_mode_slices(labelled: DataFrame) -> DataFrame:
    """``(region, mode, slice)`` for every (cell, mode new in its region):
    the slices the partitioner balances. Each cell yields popcount(region)
    rows, 12 (region, mode) groups in all."""
    cand = F.array(*[
        F.when(F.substring("region", m + 1, 1) == F.lit("1"),
               F.struct(F.lit(m).alias("mode"), coord(m).alias("slice")))
        for m in MODES
    ])
    return labelled.select("region", F.inline(F.filter(cand, lambda x: x.isNotNull())))


def slice_nnz(labelled: DataFrame) -> DataFrame:
    """Rows per slice for every (region, mode) group in one aggregation:
    ``(region, mode, slice, nnz)``; absent slices have no row."""
    return region_mode_slices(labelled).groupBy("region", "mode", "slice").agg(F.count(F.lit(1)).alias("nnz"))


def mode_slices(cells: DataFrame) -> DataFrame:
    """``(mode, slice)`` for every cell and every mode (whole tensor)."""
    return cells.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("mode"), coord(m).alias("slice")) for m in MODES
    ])))


def slice_skew(cells: DataFrame) -> DataFrame:
    """Input skew: per mode the population CV of cells per occupied slice,
    and the mean over modes. One row: ``cv0, cv1, cv2, slice_skew``."""
    per_slice = mode_slices(cells).groupBy("mode", "slice").agg(F.count(F.lit(1)).alias("nnz"))
    per_mode = per_slice.groupBy("mode").agg((F.stddev_pop("nnz") / F.avg("nnz")).alias("cv"))
    return per_mode.agg(
        *[F.max(F.when(F.col("mode") == m, F.col("cv"))).alias(f"cv{m}") for m in MODES],
        F.avg("cv").alias("slice_skew"),
    )


def line_sets(cells: DataFrame, dims) -> DataFrame:
    """Which indices of each mode occur (up to ``dims``), as sparse rows
    ``(mode, idx)`` instead of 0/1 arrays."""
    return (
        mode_slices(cells)
        .withColumnRenamed("slice", "idx")
        .where(F.col("idx") <= F.element_at(F.array(*[F.lit(int(d)) for d in dims]), F.col("mode") + 1))
        .distinct()
    )


def line_bitmaps(cells: DataFrame, dims, by: tuple[str, ...] = ()) -> DataFrame:
    """The index sets of :func:`line_sets` as bitmaps: ``(*by, mode, bucket,
    bits)``, one row for every 32,768 indices with a touched one among them.
    With ``by=("region",)`` one aggregation gives the sets of all regions.
    Partial bitmaps are built before the shuffle, so a hot index costs at most
    one 4 KB row a task and bucket."""
    bound = F.element_at(F.array(*[F.lit(int(d)) for d in dims]), F.col("mode") + 1)
    touched = cells.select(*by, F.inline(F.array(*[
        F.struct(F.lit(m).alias("mode"), coord(m).cast("long").alias("idx")) for m in MODES
    ]))).where(F.col("idx") <= bound)
    return touched.groupBy(*by, "mode", F.bitmap_bucket_number("idx").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("idx")).alias("bits"))


def with_local_indices(cells: DataFrame, pre_dims) -> DataFrame:
    """Adds 0-based block-local indices ``li, lj, lk``."""
    return cells.select(
        "*", *[local_index(coord(m), pre_dims[m]).alias("l" + COORD[m]) for m in MODES]
    )
