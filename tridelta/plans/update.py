"""The incremental Tucker update as a sequence of DataFrame stages.

``(old factor blocks, core, pre_dims, increment) -> (factors, core, metrics)``

1. one validation/dims job; the increment is labelled with its region and
   written once, partitioned by region (``000`` is never read again);
2. partition stage: slice histogram of the 12 (region, mode) groups in one
   aggregation, bin maps and balance metrics; the cells are stored by bin;
3. factor stage: new-row blocks of every mode, C1 -> C2 -> C3 (Gauss-Seidel
   order), contracted bin by bin where the cells lie, blended with forgetting
   weight ``mu`` and orthonormalised;
4. core stage: old over new block orthonormalised (Gram algebra only), the
   old core rotated into the new basis, and every region's contribution
   added in one pass over the labelled increment.

Only r x r Grams and the r0*r1*r2 core reach the driver."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_CUT_NUM, DEFAULT_MU, DEFAULT_RANKS, PUBLISHED_CORE_WEIGHTS
from ..functions.index import C1_REGION, C3_REGION, COORD, MODES, REGIONS, c2_regions, other_modes
from ..functions.linalg import mgs_transform, mode_product
from ..operators import factors as fo
from ..operators import partition as po
from ..operators.core import array_to_core, core_to_array
from ..operators.kernel import contract_all, update_and_blend, update_by_bin, update_factor
from ..operators.tensor import cut_regions, slice_nnz, stats_aggs, stats_from_row
from ..session import configure, delete_paths, owned_tables, stash

# Cells in a file of the increment, at most: a file of one row group is read by one task.
FILE_CELLS = 1 << 19

# Core contribution weight of each region. "once": every new region once.
# "as_published": the published schedule (110 left out, 011 twice, 111 three times).
CORE_SCHEDULES = {
    "once": {r: 1 for r in REGIONS},
    "as_published": dict(PUBLISHED_CORE_WEIGHTS),
}


@dataclass
class Context:
    cells: DataFrame                 # labelled, non-000 cells (stored by region)
    pre_dims: tuple
    dims: tuple
    ranks: tuple
    region_cells: dict
    metrics: list = field(default_factory=list)
    touched_rows: dict = field(default_factory=dict)
    by_bin: po.BinLayout | None = None   # the cells grouped by bin, if bins were assigned

    def region(self, r: str) -> DataFrame:
        return self.cells.where(f"region = '{r}'")

    def new_rows(self, m: int) -> int:
        return self.dims[m] - self.pre_dims[m]

    def touched(self, r: str, m: int) -> tuple[DataFrame, int]:
        """The mode-``m`` indices of a region's cells and their number: stored
        and counted when first asked for, then shared by all steps."""
        if (r, m) not in self.touched_rows:
            stored = stash(self.region(r).select(F.col(COORD[m]).alias("idx")).distinct(), f"touched-{r}-{m}")
            self.touched_rows[r, m] = stored, stored.count()
        return self.touched_rows[r, m]


@dataclass
class UpdateResult:
    factors: DataFrame
    core: DataFrame
    metrics: DataFrame
    core_array: np.ndarray
    blocks: dict
    part_map: DataFrame | None
    labelled_cells: DataFrame | None
    info: dict
    scratch: list = field(default_factory=list)
    kept: list = field(default_factory=list)

    def release(self, results: bool = False) -> int:
        """Delete the intermediate tables this update (and no other) stored
        under ``spark.checkpoint.dir``. ``factors`` and ``part_map`` stay
        readable; ``labelled_cells`` and ``blocks`` do not. With ``results``
        the stored results go, too: call that only once they are written."""
        paths = self.scratch + (self.kept if results else [])
        n = delete_paths(self.core.sparkSession, paths)
        self.scratch = []
        if results:
            self.kept = []
        return n


def _validate(ranks, mu, cut_num, partition, core_schedule):
    if len(ranks) != 3 or min(ranks) < 1:
        raise ValueError("three positive ranks are required")
    if not (0.0 < float(mu) <= 1.0):
        raise ValueError(f"mu must be in (0, 1], got {mu}")
    if int(cut_num) < 1:
        raise ValueError(f"cut_num must be positive, got {cut_num}")
    if partition not in ("bucket", "greedy", None):
        raise ValueError("partition must be 'bucket', 'greedy' or None")
    if core_schedule not in CORE_SCHEDULES:
        raise ValueError(f"core_schedule must be one of {sorted(CORE_SCHEDULES)}")


def prepare(cells: DataFrame, pre_dims, ranks) -> Context:
    """One pass: the labelled increment is written once (partitioned by
    region, 000 left out) while dims, validation counts and cells per
    region are observed over all input rows in the same job."""
    from pyspark.sql import Observation

    pre_dims = tuple(int(x) for x in pre_dims)
    obs = Observation("increment-stats")
    observed = cells.observe(obs, *stats_aggs(pre_dims))
    # rebalanced, so that a region is a few files of even size and not one per input task
    labelled = stash(cut_regions(observed, pre_dims).select("region", "i", "j", "k", "val").hint("rebalance", "region"),
                     "cells", partition_by=["region"], file_rows=FILE_CELLS)
    stats = stats_from_row(obs.get, pre_dims)
    dims = tuple(max(p, d) for p, d in zip(pre_dims, stats.dims))
    ctx = Context(cells=labelled, pre_dims=pre_dims, dims=dims, ranks=tuple(int(r) for r in ranks),
                  region_cells=stats.region_cells)
    for r, n in stats.region_cells.items():
        ctx.metrics.append(("cells", r, None, float(n)))
    for m in MODES:
        ctx.metrics.append(("dim", None, m, float(dims[m])))
        ctx.metrics.append(("pre_dim", None, m, float(pre_dims[m])))
    return ctx


def partition_stage(ctx: Context, cut_num: int, method: str):
    """Histogram (one aggregation for all 12 groups, stored), every slice's bin
    (stored), the balance of the bins, and the cells grouped by bin
    (``ctx.by_bin``), on which the factor stage runs. ``partition_seconds`` covers
    the first three, ``grouping_seconds`` the last."""
    t0 = time.time()
    hist = stash(slice_nnz(ctx.cells), "histogram")
    dims = {m: ctx.dims[m] for m in MODES}
    if method == "bucket":
        runs = stash(po.bucket_runs(hist, cut_num), "lpt-runs", partition_by=["kind"])
        part_map = po.bucket_map(hist, cut_num, max(ctx.dims), runs=runs)
    else:
        # a cell of region r adds one row to each group (r, m) with m new in r
        totals = {(r, m): n for r, n in ctx.region_cells.items() if r != "000" and n > 0
                  for m in MODES if r[m] == "1"}
        part_map = po.greedy_map(hist, cut_num, dims, totals=totals)
    part_map = stash(part_map, "part-map")
    loads = po.partition_loads(part_map)
    cv = po.partition_cv(loads).collect()
    seconds = time.time() - t0
    groups = [(r["region"], int(r["mode"]), float(r["cv"]), float(r["cv_exact"])) for r in cv]
    mean_cv = float(np.mean([g[2] for g in groups])) if groups else float("nan")
    ctx.metrics.append(("partition_seconds", None, None, seconds))
    ctx.metrics.append(("partition_cv", None, None, mean_cv))
    for region, mode, value, exact in groups:
        ctx.metrics.append(("partition_cv", region, mode, value))
        ctx.metrics.append(("partition_cv_exact", region, mode, exact))
    t1 = time.time()
    held = {(r["region"], int(r["mode"]), int(r["part_id"])): int(r["load"]) for r in loads.collect()}  # 12 * cut_num at most
    ctx.by_bin = po.store_by_bin(ctx.cells, part_map, cut_num, 4 * sum(ctx.new_rows(m) for m in MODES), held)
    ctx.metrics.append(("grouping_seconds", None, None, time.time() - t1))
    return part_map, mean_cv, seconds


@dataclass
class Block:
    df: DataFrame
    rows: int            # proven upper bound on the row count
    gram: np.ndarray     # Gram of this block (r x r)


def _lookup(ctx: Context, region: str, mode: int, old: dict, new: dict) -> tuple[DataFrame, int, int]:
    """(factor rows, rank, bound on the rows) of ``mode`` for cells of
    ``region``. A block too large to broadcast is cut to the rows that the
    region touches, if those are known to fit."""
    blk = new[mode] if region[mode] == "1" else old[mode]
    rank = ctx.ranks[mode]
    if not fo.fits_broadcast(blk.df, rank, blk.rows):
        touched, n = ctx.touched(region, mode)
        if fo.fits_broadcast(blk.df, rank, n):
            return blk.df.join(touched, "idx", "left_semi"), rank, n
    return blk.df, rank, blk.rows


def _update_rows(ctx: Context, mode: int, region: str, core: np.ndarray, old: dict, new: dict) -> DataFrame:
    """Kernel + pseudo-inverse for ``mode`` from the cells of ``region``;
    other modes use their old or new block by the region's bits."""
    a, b = other_modes(mode)
    blocks = *_lookup(ctx, region, a, old, new), *_lookup(ctx, region, b, old, new)
    if _in_place(ctx, blocks):
        return update_by_bin(*ctx.by_bin.cells(region, mode), mode, core, *blocks)
    return update_factor(ctx.region(region), mode, core, *blocks)


def _in_place(ctx: Context, blocks: tuple) -> bool:
    """Whether cells grouped by bin can be contracted where they lie: factor
    rows come to them only if both blocks are broadcast. Otherwise cells travel
    to factor rows anyway, and the layout would be lost."""
    return ctx.by_bin is not None and all(fo.fits_broadcast(blocks[k], blocks[k + 1], blocks[k + 2]) for k in (0, 3))


def _orthonormal_block(ctx: Context, stored: DataFrame, g: np.ndarray, mode: int, region: str) -> Block:
    q, _, g_q, deficient = fo.orthonormalize(stored, ctx.ranks[mode], gram_in=g)
    if deficient:
        ctx.metrics.append(("rank_deficient", region, mode, 1.0))
    return Block(q, ctx.new_rows(mode), g_q)


def _blend_step(ctx: Context, mode: int, region: str, core: np.ndarray, old: dict, new: dict,
                mu: float, name: str) -> None:
    """C2/C3 step: update, blend with the current block, orthonormalise.
    One write per step; its Gram comes from the same job."""
    if ctx.region_cells.get(region, 0) == 0:
        return
    a, b = other_modes(mode)
    blocks = *_lookup(ctx, region, a, old, new), *_lookup(ctx, region, b, old, new)
    if _in_place(ctx, blocks):
        rows = update_by_bin(*ctx.by_bin.cells(region, mode), mode, core, *blocks, keep_cells=True)
        cur = fo.blend_factor(new[mode].df, rows, ctx.ranks[mode], mu)
    else:
        cur = update_and_blend(ctx.region(region), mode, core, *blocks, new[mode].df, ctx.ranks[mode], mu)
    stored, grams, _ = fo.stash_with_grams(cur, f"{name}-m{mode}-{region}", {mode: ctx.ranks[mode]})
    new[mode] = _orthonormal_block(ctx, stored, grams[mode], mode, region)


def factor_stage(ctx: Context, core: np.ndarray, old: dict, mu: float) -> dict:
    """C1 (the three modes are independent: one job) -> C2 -> C3 (each step
    sees the blocks already updated, Gauss-Seidel order)."""
    spark = ctx.cells.sparkSession
    new = {}
    for m in MODES:
        empty = spark.createDataFrame([], "idx long, " + ", ".join(f"c{q} double" for q in range(ctx.ranks[m])))
        new[m] = Block(empty, ctx.new_rows(m), np.zeros((ctx.ranks[m], ctx.ranks[m])))
    c1 = [m for m in MODES if ctx.region_cells.get(C1_REGION[m], 0) > 0]
    for m in MODES:
        if m not in c1:
            ctx.metrics.append(("empty_region", C1_REGION[m], m, 1.0))
    if c1:
        rmax = max(ctx.ranks)
        union = None
        for m in c1:
            upd = _update_rows(ctx, m, C1_REGION[m], core, old, new)
            sel = upd.selectExpr(f"{m} AS mode", "idx",
                                 *[(f"c{q}" if q < ctx.ranks[m] else f"CAST(0.0 AS DOUBLE) AS c{q}") for q in range(rmax)])
            union = sel if union is None else union.unionByName(sel)
        stored, grams, _ = fo.stash_with_grams(union, "c1", {m: ctx.ranks[m] for m in c1}, partition_by=["mode"])
        for m in c1:
            part = stored.where(f"mode = {m}").select("idx", *fo.cols(ctx.ranks[m]))
            new[m] = _orthonormal_block(ctx, part, grams[m], m, C1_REGION[m])
    for m in MODES:
        for region in c2_regions(m):
            _blend_step(ctx, m, region, core, old, new, mu, "c2")
    for m in MODES:
        _blend_step(ctx, m, C3_REGION, core, old, new, mu, "c3")
    return new


def core_stage(ctx: Context, core: np.ndarray, old: dict, new: dict, schedule: str):
    """Stack old over new per mode and orthonormalise (Gram algebra: the
    stacked Gram is G_old + G_new), store the final factors once (a later
    update reads this table, not the blocks it came from), rotate the core by
    ``S^T G_old``, then add all regions' contributions in one pass."""
    final = {}
    g = core.copy()
    for m in MODES:
        stacked_gram = old[m].gram + new[m].gram
        s, deficient = mgs_transform(stacked_gram)
        if deficient:
            ctx.metrics.append(("rank_deficient", "stack", m, 1.0))
        rot = s.T @ old[m].gram
        g = mode_product(g, rot, m)
        final[m] = Block(fo.project(fo.stack(old[m].df, new[m].df), ctx.ranks[m], s), ctx.dims[m],
                         s.T @ stacked_gram @ s)
    factors = stash(fo.combine({m: (final[m].df, ctx.ranks[m]) for m in MODES}, max(ctx.ranks)), "factors",
                    partition_by=["mode"]).select("mode", "idx", *fo.cols(max(ctx.ranks)))
    for m in MODES:
        final[m].df = factors.where(f"mode = {m}").select("idx", *fo.cols(ctx.ranks[m]))
    weights = CORE_SCHEDULES[schedule]
    kept = [r for r in REGIONS if weights[r] != 0]
    case = " ".join(f"WHEN '{r}' THEN {float(weights[r])}D" for r in kept)
    in_list = ", ".join(f"'{r}'" for r in kept)
    cells = ctx.cells.where(f"region IN ({in_list})").selectExpr("i", "j", "k", "val", f"CASE region {case} END AS _w")
    delta = contract_all(cells, {m: final[m].df for m in MODES}, ctx.ranks,
                         {m: final[m].rows for m in MODES}, weight="_w")
    return g + delta, final, factors


def _as_blocks(factors, pre_dims, ranks) -> dict:
    """Old blocks from a combined ``(mode, idx, c..)`` table or a dict."""
    out = {}
    for m in MODES:
        df = factors[m] if isinstance(factors, dict) else factors.where(F.col("mode") == F.lit(m))
        df = df.where(F.col("idx") <= F.lit(int(pre_dims[m]))).select("idx", *fo.cols(ranks[m]))
        out[m] = df
    return out


def incremental_update(cells: DataFrame, factors, core, pre_dims, ranks=DEFAULT_RANKS,
                       mu: float = DEFAULT_MU, cut_num: int = DEFAULT_CUT_NUM,
                       partition: str | None = "bucket", core_schedule: str = "once",
                       gram_old: dict | None = None) -> UpdateResult:
    """Update a Tucker model for an increment that grew in all three modes.

    ``factors``: old blocks, combined table or {mode: DataFrame(idx, c..)};
    ``core``: NumPy array (r0, r1, r2) or a ``(p, q, r, g)`` DataFrame;
    ``gram_old``: optional known Grams of the old blocks (identity for an
    orthonormal start), saving one pass over the old factor tables."""
    _validate(ranks, mu, cut_num, partition, core_schedule)
    configure(cells.sparkSession)
    with owned_tables(cells.sparkSession) as paths:
        result = _run(cells, factors, core, pre_dims, ranks, mu, cut_num, partition, core_schedule, gram_old)
    result.kept = [p for p in paths if p.rsplit("/", 1)[1].startswith(("factors-", "part-map-"))]
    result.scratch = [p for p in paths if p not in result.kept]
    return result


def _run(cells: DataFrame, factors, core, pre_dims, ranks, mu: float, cut_num: int, partition: str | None,
         core_schedule: str, gram_old: dict | None) -> UpdateResult:
    spark = cells.sparkSession
    t0 = time.time()
    ranks = tuple(int(r) for r in ranks)
    g0 = core_to_array(core, ranks) if isinstance(core, DataFrame) else np.asarray(core, dtype=float)
    ctx = prepare(cells, pre_dims, ranks)
    ctx.metrics.append(("prepare_seconds", None, None, time.time() - t0))
    old_df = _as_blocks(factors, ctx.pre_dims, ranks)
    grams = gram_old if gram_old is not None else fo.grams_by_mode(old_df, ranks)
    old = {m: Block(old_df[m], ctx.pre_dims[m], np.asarray(grams[m], dtype=float)) for m in MODES}
    part_map = None
    if partition is not None:
        part_map, _, _ = partition_stage(ctx, cut_num, partition)
    t1 = time.time()
    new = factor_stage(ctx, g0, old, mu)
    t2 = time.time()
    g1, final, factors_out = core_stage(ctx, g0, old, new, core_schedule)
    ctx.metrics.append(("factor_seconds", None, None, t2 - t1))
    ctx.metrics.append(("core_seconds", None, None, time.time() - t2))
    total = time.time() - t0
    ctx.metrics.append(("total_seconds", None, None, total))
    metrics = spark.createDataFrame(ctx.metrics, "name string, region string, mode int, value double")
    labelled = None
    if part_map is not None:
        labelled = po.label_cells(ctx.cells, part_map, 4 * sum(ctx.new_rows(m) for m in MODES))
    return UpdateResult(
        factors=factors_out, core=array_to_core(spark, g1), metrics=metrics, core_array=g1,
        blocks={m: (final[m].df, new[m].df) for m in MODES}, part_map=part_map, labelled_cells=labelled,
        info={"dims": ctx.dims, "pre_dims": ctx.pre_dims, "total_seconds": total,
              "region_cells": ctx.region_cells},
    )
