"""Registered queries: every operator of the inventory run on a tensor that
Spark derives from the given tables (``sales``: part x supplier x month
from ``lineitem``), over the whole table, with pre_dims = dims*4 div 5.

Start values are the integer formula of ``functions.fixed`` so sums are
exact in any order; float-valued results are produced by the same sequence
of double operations in Spark and in the SQL oracle, or scaled and rounded
(``*_e9`` columns). ``ORACLES`` holds DuckDB SQL for the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_CUT_NUM, DEFAULT_MU, PUBLISHED_CORE_WEIGHTS
from ..functions.index import COORD, MODES, REGIONS, other_modes, unfold_index
from ..functions.linalg import core_pinv, unfold
from ..operators import core as co
from ..operators import factors as fo
from ..operators import kernel as ke
from ..operators import partition as po
from ..operators import tensor as te
from ..session import scratch_path, stash
from ..sources.coo import read_coo, write_coo
from ..sources.model import read_metrics, read_model
from ..sources.tables import PURCHASES_SQL, SALES_SQL, purchases_tensor, sales_tensor
from . import update as up
from .job import start_model, tucker_job

# The products of whole-number cores and Grams here are compared in this unit.
TURN_UNIT = "1e14"
# Twelve differently conditioned inverses: pinv and cofactors differ in the 10th digit.
GRAM_UNIT = "1e14"
R = 3
RANKS = (R, R, R)
CUT = DEFAULT_CUT_NUM
MU = DEFAULT_MU


class Setup:
    """A tensor of one scale factor plus its dims and split. The cells are summed
    once and stored, as every query reads them more than once. ``summed`` are the same
    cells, summed anew by tasks of bounded size, for what sorts all cells of a task."""

    def __init__(self, spark: SparkSession, sf_dir: str, tensor=sales_tensor):
        self.spark = spark
        obs = Observation("tensor-stats")
        self.summed = tensor(spark, sf_dir)
        self.cells = stash(self.summed.observe(obs, *te.stats_aggs()), "tensor")
        self.dims = te.stats_from_row(obs.get, None).dims
        self.pre = tuple(d * 4 // 5 for d in self.dims)

    @property
    def labelled(self) -> DataFrame:
        return te.cut_regions(self.cells, self.pre)

    def region(self, r: str) -> DataFrame:
        return self.labelled.where(f"region = '{r}'")

    def factor(self, mode: int, first: int = 1, last: int | None = None) -> DataFrame:
        last = self.dims[mode] if last is None else last
        return fo.init_factor(self.spark, mode, first, last, R)

    def old(self, mode: int) -> DataFrame:
        return self.factor(mode, 1, self.pre[mode])

    def block(self, region: str, mode: int) -> tuple[DataFrame, int, int]:
        """(start rows, rank, their number) that cells of ``region`` meet in ``mode``."""
        if region[mode] == "1":
            return self.factor(mode, self.pre[mode] + 1), R, self.dims[mode] - self.pre[mode]
        return self.old(mode), R, self.pre[mode]

    def full(self) -> dict:
        return {m: self.factor(m) for m in MODES}

    def hist(self) -> DataFrame:
        return te.slice_nnz(self.labelled)


# Every region paired with each mode that is new in it.
TASKS = [(r, m) for r in REGIONS for m in MODES if r[m] == "1"]


def _task_rows(out: DataFrame | None, rows: DataFrame, region: str, mode: int) -> DataFrame:
    """``out`` and the rows of one more task, with region and mode as columns."""
    rows = rows.select(F.lit(region).alias("region"), F.lit(mode).alias("mode"), *rows.columns)
    return rows if out is None else out.unionByName(rows)


# ------------------------------------------------------------------ Spark side

def q_read_coo(spark, sf):
    s = Setup(spark, sf)
    path = scratch_path(spark, "coo")
    write_coo(s.cells, path)
    return read_coo(spark, path)


def q_write_model(spark, sf):
    """Factors, core and metrics of a whole update, written and read back."""
    s = Setup(spark, sf)
    path = scratch_path(spark, "model")
    tucker_job(spark, s.cells, s.pre, ranks=RANKS, partition="greedy", output=path).release(results=True)
    factors, core = read_model(spark, path)
    return _model_rows(factors, core).unionByName(_metric_rows(read_metrics(spark, path)))


def q_cut_regions(spark, sf):
    return Setup(spark, sf).labelled.select("region", "i", "j", "k", "val")


def q_local_index(spark, sf):
    s = Setup(spark, sf)
    return te.with_local_indices(s.cells, s.pre).select("i", "j", "k", "li", "lj", "lk")


def q_unfold_index(spark, sf):
    s = Setup(spark, sf)
    lab = s.labelled
    parts = [lab.select("region", F.lit(m).alias("mode"), "i", "j", "k",
                        unfold_index(m, s.pre, s.dims).alias("col")) for m in MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_line_sets(spark, sf):
    s = Setup(spark, sf)
    return te.line_sets(s.cells, s.pre)


def q_filter_factors(spark, sf):
    s = Setup(spark, sf)
    old = fo.combine({m: (s.old(m), R) for m in MODES}, R)
    return fo.filter_factors(old, te.line_sets(s.cells, s.pre))


def q_line_bitmaps(spark, sf):
    """Touched indices of every region and mode, from one aggregation."""
    s = Setup(spark, sf)
    return te.line_bitmaps(te.cut_regions(s.summed, s.pre), s.dims, by=("region",)).groupBy("region", "mode").agg(
        F.sum(F.bitmap_count("bits")).alias("touched"))


def q_filter_factors_bitmap(spark, sf):
    s = Setup(spark, sf)
    old = fo.combine({m: (s.old(m), R) for m in MODES}, R)
    return fo.filter_factors_bitmap(old, te.line_bitmaps(s.summed, s.pre), s.pre)


def q_factor_lookup(spark, sf):
    s = Setup(spark, sf)
    return fo.factor_lookup(s.cells, s.factor(1), "j", R, "a", s.dims[1])


def _each_task(s: Setup, rows) -> DataFrame:
    """``rows(region, mode)`` of all twelve tasks in one table."""
    out = None
    for region, mode in TASKS:
        out = _task_rows(out, rows(region, mode), region, mode)
    return out


def _ttm(s: Setup, region: str, mode: int) -> DataFrame:
    a, b = other_modes(mode)
    return ke.ttm_chain(s.region(region), mode, *s.block(region, a), *s.block(region, b))


def q_ttm_chain(spark, sf):
    s = Setup(spark, sf)
    return _each_task(s, lambda region, mode: _ttm(s, region, mode))


def _krows(s: Setup, region: str, mode: int) -> DataFrame:
    a, b = other_modes(mode)
    pairs = s.region(region).selectExpr(f"{COORD[b]} AS xa", f"{COORD[a]} AS xb")
    (block_a, _, rows_a), (block_b, _, rows_b) = s.block(region, a), s.block(region, b)
    return ke.kron_rows(pairs, block_b, R, s.pre[b], rows_b, block_a, R, s.pre[a], rows_a)


def q_kron_rows(spark, sf):
    s = Setup(spark, sf)
    return _each_task(s, lambda region, mode: _krows(s, region, mode))


def q_unfolded_join_multiply(spark, sf):
    s = Setup(spark, sf)

    def rows(region, mode):
        k = _krows(s, region, mode).selectExpr("id", *[f"k{c} AS c{c}" for c in range(R * R)])
        return ke.unfolded_join_multiply(s.region(region), mode, k, R * R, s.pre, s.dims)

    return _each_task(s, rows)


def q_kron_core_product(spark, sf):
    s = Setup(spark, sf)
    core = co.start_core_array(RANKS)
    return _each_task(s, lambda region, mode: ke.kron_core_product(_krows(s, region, mode), R * R, core, mode))


def q_mode_dims(spark, sf):
    return te.mode_dims(sales_tensor(spark, sf))


def q_cell_count(spark, sf):
    return te.cell_count(sales_tensor(spark, sf))


def q_slice_nnz(spark, sf):
    return Setup(spark, sf).hist()


def q_slice_skew(spark, sf):
    sk = te.slice_skew(sales_tensor(spark, sf))
    return sk.selectExpr(*[f"CAST(round(cv{m} * 1e9) AS BIGINT) AS cv{m}_e9" for m in MODES],
                         "CAST(round(slice_skew * 1e9) AS BIGINT) AS slice_skew_e9")


def _bucket(s: Setup):
    hist = s.hist()
    runs = po.bucket_runs(hist, CUT)
    return po.bucket_map(hist, CUT, max(s.dims), runs=runs), runs


def _greedy(s: Setup):
    return po.greedy_map(s.hist(), CUT, {m: s.dims[m] for m in MODES})


def q_bucket_map(spark, sf):
    return _bucket(Setup(spark, sf))[0]


def q_bucket_map_wide(spark, sf):
    """A thousand bins, more than most groups have slices."""
    return po.bucket_map(Setup(spark, sf).hist(), 1000, 1 << 20)


def q_bin_layout(spark, sf):
    """The cells as the factor stage reads them: one task per bin."""
    s = Setup(spark, sf)
    ctx = up.prepare(s.cells, s.pre, RANKS)
    up.partition_stage(ctx, CUT, "bucket")
    # grouped by the key of its buckets, the table is read bucket by bucket
    whole = ctx.by_bin.whole.groupBy("bin_key", "region", "mode", "part_id").agg(F.count(F.lit(1)).alias("cells"))
    whole = whole.select("region", "mode", "part_id", F.spark_partition_id().alias("partition"), "cells")
    if ctx.by_bin.split is None:
        return whole
    split = ctx.by_bin.split.groupBy("region", "mode", "part_id").agg(F.count(F.lit(1)).alias("cells"))
    return whole.unionByName(split.withColumn("partition", F.lit(None).cast("int")), allowMissingColumns=True)


def q_ttm_by_bin(spark, sf):
    """The kernel of all twelve tasks on cells stored by bin, each bin contracted
    where it lies."""
    s = Setup(spark, sf)
    ctx = up.prepare(s.cells, s.pre, RANKS)
    up.partition_stage(ctx, CUT, "bucket")

    def rows(region, mode):
        a, b = other_modes(mode)
        return ke.ttm_by_bin(*ctx.by_bin.cells(region, mode), mode, *s.block(region, a), *s.block(region, b))

    return _each_task(s, rows)


def q_greedy_map(spark, sf):
    return _greedy(Setup(spark, sf))


def _labelled_cells(s: Setup, part_map: DataFrame) -> DataFrame:
    bound = 4 * sum(s.dims[m] - s.pre[m] for m in MODES)
    return po.label_cells(s.labelled, part_map, bound).select("region", "mode", "i", "j", "k", "val", "part_id")


def q_bucket_partition(spark, sf):
    s = Setup(spark, sf)
    return _labelled_cells(s, _bucket(s)[0])


def q_greedy_partition(spark, sf):
    s = Setup(spark, sf)
    return _labelled_cells(s, _greedy(s))


def q_group_by_part(spark, sf):
    s = Setup(spark, sf)
    grouped = po.group_by_part(_labelled_cells(s, _bucket(s)[0]), CUT)
    return grouped.withColumn("partition", F.spark_partition_id()).groupBy(
        "region", "mode", "part_id", "partition").agg(F.count(F.lit(1)).alias("cells"))


def _cv_out(cv: DataFrame) -> DataFrame:
    return cv.selectExpr("region", "mode", "parts", "cells", "cv", "CAST(round(cv_exact * 1e9) AS BIGINT) AS cv_exact_e9")


def q_partition_cv(spark, sf):
    s = Setup(spark, sf)
    return _cv_out(po.partition_cv(po.bucket_loads(_bucket(s)[1])))


def q_partition_cv_mean(spark, sf):
    s = Setup(spark, sf)
    m = po.partition_cv_mean(po.partition_cv(po.bucket_loads(_bucket(s)[1])))
    return m.selectExpr("CAST(round(partition_cv * 1e9) AS BIGINT) AS partition_cv_e9",
                        "CAST(round(partition_cv_exact * 1e9) AS BIGINT) AS partition_cv_exact_e9", "groups")


def q_partition_stage(spark, sf):
    s = Setup(spark, sf)
    ctx = up.prepare(s.cells, s.pre, RANKS)
    part_map, _, _ = up.partition_stage(ctx, CUT, "greedy")
    return _cv_out(po.partition_cv(po.partition_loads(part_map)))


def q_partition_stage_bucket(spark, sf):
    """The cells with the labels that the stage assigns them."""
    s, blocks, grams, core = _start(spark, sf)
    res = up.incremental_update(s.cells, blocks, core, s.pre, RANKS, cut_num=CUT, partition="bucket", gram_old=grams)
    return res.labelled_cells.select("region", "mode", "i", "j", "k", "val", "part_id")


def _vector_rows(s: Setup) -> DataFrame:
    j = fo.factor_lookup(s.cells, s.factor(1), "j", R, "a", s.dims[1])
    return j.selectExpr("i", *[f"val * a{q} AS v{q}" for q in range(R)])


def q_vector_sum(spark, sf):
    s = Setup(spark, sf)
    return fo.vector_sum(_vector_rows(s), "i", [f"v{q}" for q in range(R)])


def q_gram(spark, sf):
    s = Setup(spark, sf)
    vs = fo.vector_sum(_vector_rows(s), "i", [f"v{q}" for q in range(R)]).selectExpr(
        "i AS idx", *[f"v{q} AS c{q}" for q in range(R)])
    return fo.gram_frame(s.factor(0), R, vs, R)


def _update(s: Setup, region: str, mode: int) -> DataFrame:
    a, b = other_modes(mode)
    return ke.update_factor(s.region(region), mode, co.start_core_array(RANKS), *s.block(region, a), *s.block(region, b))


def q_update_factor(spark, sf):
    s = Setup(spark, sf)
    return _each_task(s, lambda region, mode: _update(s, region, mode))


def q_update_factor_gram(spark, sf):
    s = Setup(spark, sf)

    def rows(region, mode):
        a, b = other_modes(mode)
        out = ke.update_factor_gram(s.region(region), mode, co.start_core_array(RANKS), *s.block(region, a), *s.block(region, b),
                                    s.pre, s.dims)
        # values are tiny here: compared as integers in a unit of their own size
        return out.selectExpr("idx", *[f"CAST(round(c{q} * {GRAM_UNIT}) AS BIGINT) AS c{q}_scaled" for q in range(R)])

    return _each_task(s, rows)


def q_blend_factor(spark, sf):
    s = Setup(spark, sf)

    def rows(region, mode):
        prev = s.factor(mode, s.pre[mode] + 1, s.dims[mode])
        return fo.blend_factor(prev, _update(s, region, mode), R, MU)

    return _each_task(s, rows)


def _touched_new_rows(s: Setup, region: str, mode: int) -> DataFrame:
    rows = s.region(region).selectExpr(f"{COORD[mode]} AS idx").distinct()
    return s.factor(mode).join(rows, "idx", "left_semi")


def q_orthonormalize(spark, sf):
    """The touched new rows of each task, orthonormalised; one aggregation gives
    the Gram matrices of all twelve."""
    s = Setup(spark, sf)
    touched = {n: _touched_new_rows(s, *task) for n, task in enumerate(TASKS)}
    grams = fo.grams_by_mode(touched, [R] * len(TASKS))

    def rows(region, mode):
        n = TASKS.index((region, mode))
        q, _, _, _ = fo.orthonormalize(touched[n], R, gram_in=grams[n])
        return q.selectExpr("idx", *[f"CAST(round(c{c} * 1e9) AS BIGINT) AS c{c}_e9" for c in range(R)])

    return _each_task(s, rows)


def q_stack_split(spark, sf):
    s = Setup(spark, sf)

    def rows(region, mode):
        stacked = fo.stack(s.old(mode), _touched_new_rows(s, region, mode))
        old, new = fo.split(stacked, s.pre[mode])
        return old.withColumn("block", F.lit("old")).unionByName(new.withColumn("block", F.lit("new")))

    return _each_task(s, rows)


def q_init_factor(spark, sf):
    s = Setup(spark, sf)
    return fo.combine({m: (s.factor(m), R) for m in MODES}, R)


def q_factor_layout(spark, sf):
    s = Setup(spark, sf)
    old = fo.combine({m: (s.old(m), R) for m in MODES}, R)
    return fo.to_long(fo.filter_factors(old, te.line_sets(s.cells, s.pre)), R)


def q_factor_layout_dense(spark, sf):
    """Long to wide with a zero row for every index that has none."""
    s = Setup(spark, sf)
    wide = fo.combine({m: (s.factor(m), R) for m in MODES}, R)
    long = fo.to_long(fo.filter_factors(wide, te.line_sets(s.labelled, s.dims)), R)
    return fo.to_wide(long, R, dict(enumerate(s.dims)))


def _data_core(s: Setup) -> DataFrame:
    return ke.contract_frame(s.labelled, s.full(), RANKS, s.dims)


def q_matricize(spark, sf):
    core = _data_core(Setup(spark, sf))
    parts = [co.matricize(core, m, RANKS).select(F.lit(m).alias("mode"), "row", "col", "g") for m in MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_fold(spark, sf):
    core = _data_core(Setup(spark, sf))
    parts = [co.fold(co.matricize(core, m, RANKS), m, RANKS).select(F.lit(m).alias("mode"), "p", "q", "r", "g") for m in MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_core_add(spark, sf):
    s = Setup(spark, sf)
    return co.core_add(co.init_core(spark, RANKS), co.matricize(_data_core(s), 0, RANKS), 0, RANKS)


def q_core_mode_product(spark, sf):
    s = Setup(spark, sf)
    vs = fo.vector_sum(_vector_rows(s), "i", [f"v{q}" for q in range(R)]).selectExpr(
        "i AS idx", *[f"v{q} AS c{q}" for q in range(R)])
    turn = fo.gram_frame(s.factor(0), R, vs, R).selectExpr("p AS a", "q AS b", "g AS v")
    parts = [co.core_mode_product(_data_core(s), turn, m).selectExpr(
        f"{m} AS mode", "p", "q", "r", f"CAST(round(g / {TURN_UNIT}) AS BIGINT) AS g_scaled") for m in MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_update_core(spark, sf):
    s = Setup(spark, sf)
    return ke.contract_frame(s.labelled, s.full(), RANKS, s.dims)


WIDE, WIDE_CORE = 10, 8


def q_update_core_wide(spark, sf):
    """The contraction at ranks (8, 8, 8): 512 entries."""
    s = Setup(spark, sf)
    blocks = {m: fo.init_factor(spark, m, 1, s.dims[m], WIDE_CORE) for m in MODES}
    return ke.contract_frame(s.labelled, blocks, (WIDE_CORE,) * 3, s.dims)


def q_project_wide(spark, sf):
    """Kernel at ranks (10, 10) times the unfolded start core, for all twelve tasks."""
    s = Setup(spark, sf)
    core = co.start_core_array((WIDE,) * 3)

    def block(region, m):
        first, last = (s.pre[m] + 1, s.dims[m]) if region[m] == "1" else (1, s.pre[m])
        return fo.init_factor(spark, m, first, last, WIDE), WIDE, last - first + 1

    def rows(region, m):
        a, b = other_modes(m)
        return ke.project_by_blocks(s.region(region), m, unfold(core, m).T, *block(region, a), *block(region, b))

    return _each_task(s, rows)


def _scaled_frame(factors: DataFrame) -> DataFrame:
    return factors.selectExpr("mode", "idx", *[f"CAST(round(c{q} * 1e9) AS BIGINT) AS c{q}_e9" for q in range(R)])


def _start(spark, sf):
    s = Setup(spark, sf)
    blocks, grams, core = start_model(spark, s.pre, RANKS)
    return s, blocks, grams, core


def q_factor_stage(spark, sf):
    s, blocks, grams, core = _start(spark, sf)
    ctx = up.prepare(s.cells, s.pre, RANKS)
    old = {m: up.Block(blocks[m], s.pre[m], grams[m]) for m in MODES}
    new = up.factor_stage(ctx, core, old, MU)
    return _scaled_frame(fo.combine({m: (new[m].df, R) for m in MODES}, R))


def q_core_stage(spark, sf):
    s, blocks, grams, core = _start(spark, sf)
    ctx = up.prepare(s.cells, s.pre, RANKS)
    old = {m: up.Block(blocks[m], s.pre[m], grams[m]) for m in MODES}
    new = up.factor_stage(ctx, core, old, MU)
    g1, _, _ = up.core_stage(ctx, core, old, new, "once")
    return co.array_to_core(spark, g1).selectExpr("p", "q", "r", "CAST(round(g * 1e9) AS BIGINT) AS g_e9")


def q_incremental_update(spark, sf):
    s, blocks, grams, core = _start(spark, sf)
    res = up.incremental_update(s.cells, blocks, core, s.pre, RANKS, gram_old=grams)
    return _scaled_frame(res.factors)


def q_core_stage_published(spark, sf):
    """The published schedule: 110 left out, 011 twice, 111 three times."""
    s, blocks, grams, core = _start(spark, sf)
    res = up.incremental_update(s.cells, blocks, core, s.pre, RANKS, gram_old=grams, partition=None,
                                core_schedule="as_published")
    return res.core.selectExpr("p", "q", "r", "CAST(round(g * 1e9) AS BIGINT) AS g_e9")


def q_factor_stage_sparse(spark, sf):
    """The factor stage on a thin tensor (customer x part x day): most new rows
    of a mode have no cell in some region, and cells meet rows that are zero."""
    s = Setup(spark, sf, purchases_tensor)
    blocks, grams, core = start_model(spark, s.pre, RANKS)
    ctx = up.prepare(s.cells, s.pre, RANKS)
    old = {m: up.Block(blocks[m], s.pre[m], grams[m]) for m in MODES}
    new = up.factor_stage(ctx, core, old, MU)
    return _scaled_frame(fo.combine({m: (new[m].df, R) for m in MODES}, R))


def _metric_rows(metrics: DataFrame) -> DataFrame:
    return metrics.where("name NOT LIKE '%seconds'").selectExpr(
        "name", "region", "mode", "CAST(NULL AS BIGINT) AS idx", "CAST(round(value * 1e9) AS BIGINT) AS value_e9")


def _model_rows(factors: DataFrame, core: DataFrame) -> DataFrame:
    """A model in long form: factor entries (name f0.., idx = row) and core
    entries (name core, idx = 100p + 10q + r)."""
    f = factors.selectExpr("mode", "idx", "stack(3, " + ", ".join(f"'f{q}', c{q}" for q in range(R)) + ") AS (name, v)")
    f = f.selectExpr("name", "CAST(NULL AS STRING) AS region", "mode", "idx", "CAST(round(v * 1e9) AS BIGINT) AS value_e9")
    return f.unionByName(core.selectExpr(
        "'core' AS name", "CAST(NULL AS STRING) AS region", "CAST(NULL AS INT) AS mode",
        "CAST(100 * p + 10 * q + r AS BIGINT) AS idx", "CAST(round(g * 1e9) AS BIGINT) AS value_e9"))


def q_tucker_job(spark, sf):
    """Factors, core and metrics of the whole job."""
    s = Setup(spark, sf)
    res = tucker_job(spark, s.cells, s.pre, ranks=RANKS, partition="greedy")
    return _model_rows(res.factors, res.core).unionByName(_metric_rows(res.metrics))


QUERIES = {
    "read_coo": q_read_coo, "write_model": q_write_model, "cut_regions": q_cut_regions,
    "local_index": q_local_index, "unfold_index": q_unfold_index, "line_sets": q_line_sets,
    "line_bitmaps": q_line_bitmaps, "filter_factors_bitmap": q_filter_factors_bitmap,
    "filter_factors": q_filter_factors, "factor_lookup": q_factor_lookup,
    "unfolded_join_multiply": q_unfolded_join_multiply, "kron_rows": q_kron_rows,
    "mode_dims": q_mode_dims, "cell_count": q_cell_count, "slice_nnz": q_slice_nnz,
    "slice_skew": q_slice_skew, "partition_cv": q_partition_cv, "partition_cv_mean": q_partition_cv_mean,
    "ttm_chain": q_ttm_chain, "vector_sum": q_vector_sum, "gram": q_gram,
    "update_factor": q_update_factor, "blend_factor": q_blend_factor, "orthonormalize": q_orthonormalize,
    "stack_split": q_stack_split, "kron_core_product": q_kron_core_product,
    "update_factor_gram": q_update_factor_gram, "init_factor": q_init_factor, "factor_layout": q_factor_layout,
    "matricize": q_matricize, "fold": q_fold, "core_add": q_core_add, "core_mode_product": q_core_mode_product,
    "update_core": q_update_core, "bucket_map": q_bucket_map, "bucket_partition": q_bucket_partition,
    "greedy_map": q_greedy_map, "greedy_partition": q_greedy_partition, "group_by_part": q_group_by_part,
    "partition_stage_bucket": q_partition_stage_bucket, "factor_layout_dense": q_factor_layout_dense,
    "core_stage_published": q_core_stage_published, "factor_stage_sparse": q_factor_stage_sparse,
    "partition_stage": q_partition_stage, "factor_stage": q_factor_stage, "core_stage": q_core_stage,
    "incremental_update": q_incremental_update, "tucker_job": q_tucker_job,
    "bucket_map_wide": q_bucket_map_wide, "bin_layout": q_bin_layout, "ttm_by_bin": q_ttm_by_bin,
    "update_core_wide": q_update_core_wide, "project_wide": q_project_wide,
}


# ------------------------------------------------------------------ SQL side (DuckDB)

def _num(x: float) -> str:
    return f"'{repr(float(x))}'::DOUBLE"


def _lin(coefs, names) -> str:
    terms = [f"{n} * {_num(c)}" for c, n in zip(coefs, names) if float(c) != 0.0]
    return " + ".join(terms) if terms else "0.0::DOUBLE"


def _f(mode, idx: str, q: int) -> str:
    return f"CAST(({idx} * 7919 + {q * 104729 + mode + 1}) % 1000 AS DOUBLE)"


def _ftab(mode: int, first: str, last: str, name: str) -> str:
    cols = ", ".join(f"{_f(mode, 'idx', q)} AS c{q}" for q in range(R))
    return (f"{name} AS (SELECT {mode} AS mode, idx, {cols} FROM "
            f"(SELECT unnest(generate_series({first}, {last})) AS idx FROM pp))")


BASE = f"""
t AS ({SALES_SQL}),
pp AS (SELECT d0, d1, d2, d0 * 4 // 5 AS p0, d1 * 4 // 5 AS p1, d2 * 4 // 5 AS p2
       FROM (SELECT max(i) AS d0, max(j) AS d1, max(k) AS d2 FROM t)),
lab AS (SELECT t.i, t.j, t.k, t.val,
               CAST((t.i > p0)::INT AS VARCHAR) || CAST((t.j > p1)::INT AS VARCHAR) || CAST((t.k > p2)::INT AS VARCHAR) AS region
        FROM t, pp),
new_cells AS (SELECT * FROM lab WHERE region <> '000'),
{_ftab(0, '1', 'd0', 'f0')}, {_ftab(1, '1', 'd1', 'f1')}, {_ftab(2, '1', 'd2', 'f2')},
{_ftab(0, '1', 'p0', 'o0')}, {_ftab(1, '1', 'p1', 'o1')}, {_ftab(2, '1', 'p2', 'o2')},
{_ftab(0, 'p0 + 1', 'd0', 'n0')}, {_ftab(1, 'p1 + 1', 'd1', 'n1')}, {_ftab(2, 'p2 + 1', 'd2', 'n2')},
hist AS (SELECT region, mode, slice, count(*) AS nnz FROM (
           SELECT region, 0 AS mode, i AS slice FROM new_cells WHERE substr(region, 1, 1) = '1'
           UNION ALL SELECT region, 1, j FROM new_cells WHERE substr(region, 2, 1) = '1'
           UNION ALL SELECT region, 2, k FROM new_cells WHERE substr(region, 3, 1) = '1') GROUP BY ALL)
"""


def _with(*ctes: str, recursive: bool = False, tensor: str = SALES_SQL) -> str:
    head = "WITH RECURSIVE" if recursive else "WITH"
    return head + " " + ",\n".join([BASE.replace(SALES_SQL, tensor)] + list(ctes)) + "\n"


def _tasks(sql) -> str:
    """``sql(region, mode)`` of all twelve tasks, each a query with CTEs of its own."""
    return " UNION ALL ".join(f"SELECT '{r}' AS region, {m} AS mode, * FROM ({sql(r, m)})" for r, m in TASKS)


def _start_value(mode: int, idx: str, col: str) -> str:
    return f"CAST(({idx} * 7919 + {col} * 104729 + {mode + 1}) % 1000 AS DOUBLE)"


def _core_wide_sql() -> str:
    n = f"range({WIDE_CORE})"
    return _with(
        f"by_ij AS (SELECT i, j, z, sum(val * {_start_value(2, 'k', 'z')}) AS v FROM new_cells, {n} n(z) GROUP BY ALL)",
        f"by_i AS (SELECT i, y, z, sum(v * {_start_value(1, 'j', 'y')}) AS v FROM by_ij, {n} n(y) GROUP BY ALL)",
    ) + (f"SELECT CAST(x + 1 AS INTEGER) AS p, CAST(y + 1 AS INTEGER) AS q, CAST(z + 1 AS INTEGER) AS r, "
         f"sum(v * {_start_value(0, 'i', 'x')}) AS g FROM by_i, {n} n(x) GROUP BY x, y, z")


def _project_wide_sql(region: str, mode: int) -> str:
    a, b = other_modes(mode)
    weight = (31, 17, 7)  # the start core's, see functions.fixed

    def entry(q):
        return f"(({(q + 1) * weight[mode]} + (x + 1) * {weight[a]} + (y + 1) * {weight[b]}) % 97 + 1)"

    n = f"range({WIDE})"
    return _own(
        f"s AS (SELECT {COORD[mode]} AS idx, {COORD[a]} AS other, y, sum(val * {_start_value(b, COORD[b], 'y')}) AS v "
        f"FROM lab, {n} n(y) WHERE region = '{region}' GROUP BY ALL)",
        f"u AS (SELECT idx, x, y, sum(v * {_start_value(a, 'other', 'x')}) AS v FROM s, {n} n(x) GROUP BY ALL)",
    ) + "SELECT idx, " + ", ".join(f"sum(v * {entry(q)}) AS c{q}" for q in range(WIDE)) + " FROM u GROUP BY idx"


def _own(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def _blk(region: str, mode: int) -> str:
    return f"{'n' if region[mode] == '1' else 'o'}{mode}"


def _blk_rows(region: str, mode: int) -> str:
    return f"(d{mode} - p{mode})" if region[mode] == "1" else f"p{mode}"


def _lpt_ctes(cut: int = CUT) -> list[str]:
    zeros = "[" + ",".join(["0"] * cut) + "]::BIGINT[]"
    return [
        "items AS (SELECT *, row_number() OVER (PARTITION BY region, mode ORDER BY nnz DESC, slice) AS rn FROM hist)",
        f"""lpt(region, mode, rn, slice, nnz, part_id, loads) AS (
              SELECT DISTINCT region, mode, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::INTEGER, {zeros} FROM hist
              UNION ALL
              SELECT l.region, l.mode, l.rn + 1, it.slice, it.nnz,
                     CAST(list_position(l.loads, list_min(l.loads)) AS INTEGER),
                     list_transform(l.loads, lambda x, i: CASE WHEN i = list_position(l.loads, list_min(l.loads))
                                                               THEN x + it.nnz ELSE x END)
              FROM lpt l JOIN items it ON it.region = l.region AND it.mode = l.mode AND it.rn = l.rn + 1)""",
        "bmap AS (SELECT region, mode, slice, nnz, part_id FROM lpt WHERE rn > 0)",
    ]


def _greedy_ctes() -> list[str]:
    return [
        "grp AS (SELECT region, mode, sum(nnz) // " + str(CUT) + " AS thr FROM hist GROUP BY ALL)",
        """dense AS (SELECT g.region, g.mode, g.thr, s.slice, coalesce(h.nnz, 0) AS nnz
                     FROM grp g
                     JOIN (SELECT 0 AS mode, unnest(generate_series(0, d0)) AS slice FROM pp
                           UNION ALL SELECT 1, unnest(generate_series(0, d1)) FROM pp
                           UNION ALL SELECT 2, unnest(generate_series(0, d2)) FROM pp) s ON s.mode = g.mode
                     LEFT JOIN hist h ON h.region = g.region AND h.mode = g.mode AND h.slice = s.slice)""",
        f"""scan(region, mode, slice, part_id, idx, cur) AS (
              SELECT region, mode, -1::BIGINT, NULL::INTEGER, 1, 0::BIGINT FROM grp
              UNION ALL
              SELECT d.region, d.mode, d.slice,
                     CAST(CASE WHEN s.cur + d.nnz <= d.thr THEN s.idx
                               WHEN (s.cur + d.nnz - d.thr) > (d.thr - s.cur) THEN least(s.idx + 1, {CUT})
                               ELSE s.idx END AS INTEGER),
                     CASE WHEN s.cur + d.nnz <= d.thr THEN s.idx ELSE least(s.idx + 1, {CUT}) END,
                     CASE WHEN s.cur + d.nnz <= d.thr THEN s.cur + d.nnz
                          WHEN (s.cur + d.nnz - d.thr) > (d.thr - s.cur) THEN d.nnz ELSE 0 END
              FROM scan s JOIN dense d ON d.region = s.region AND d.mode = s.mode AND d.slice = s.slice + 1)""",
        "gmap AS (SELECT s.region, s.mode, s.slice, h.nnz, s.part_id FROM scan s "
        "JOIN hist h ON h.region = s.region AND h.mode = s.mode AND h.slice = s.slice)",
    ]


def _cv_ctes(map_name: str) -> list[str]:
    return [
        f"loads AS (SELECT region, mode, part_id, sum(nnz) AS load FROM {map_name} GROUP BY ALL)",
        """cvg AS (SELECT region, mode, count(*) AS n, sum(load) AS s, sum(load * load) AS s2,
                         stddev_pop(load) AS sd, avg(load) AS av FROM loads WHERE load > 0 GROUP BY ALL)""",
        """cv AS (SELECT region, mode, n AS parts, s AS cells,
                        sqrt(CAST((s2 - 2 * (s // n) * s + n * (s // n) * (s // n)) // n AS DOUBLE))
                          / CAST(s // n AS DOUBLE) AS cv,
                        sd / av AS cv_exact FROM cvg)""",
    ]


CV_SELECT = "SELECT region, mode, parts, cells, cv, CAST(round(cv_exact * 1e9) AS BIGINT) AS cv_exact_e9 FROM cv"


def _labelled_cells_sql(map_name: str) -> str:
    return f"""SELECT c.region, c.mode, c.i, c.j, c.k, c.val, m.part_id FROM (
                 SELECT region, 0 AS mode, i, j, k, val, i AS slice FROM new_cells WHERE substr(region, 1, 1) = '1'
                 UNION ALL SELECT region, 1, i, j, k, val, j FROM new_cells WHERE substr(region, 2, 1) = '1'
                 UNION ALL SELECT region, 2, i, j, k, val, k FROM new_cells WHERE substr(region, 3, 1) = '1') c
               JOIN {map_name} m ON m.region = c.region AND m.mode = c.mode AND m.slice = c.slice"""


def _local(x: str, p: str) -> str:
    return f"(CASE WHEN {x} > {p} THEN {x} - 1 - {p} ELSE {x} - 1 END)"


def _ttm_cte(region: str, mode: int) -> str:
    a, b = other_modes(mode)
    sums = ", ".join(f"sum(c.val * a.c{q} * b.c{r}) AS t{q + r * R}" for r in range(R) for q in range(R))
    return (f"ttm AS (SELECT c.{COORD[mode]} AS idx, {sums} FROM lab c JOIN {_blk(region, a)} a ON a.idx = c.{COORD[a]} "
            f"JOIN {_blk(region, b)} b ON b.idx = c.{COORD[b]} WHERE c.region = '{region}' GROUP BY c.{COORD[mode]})")


def _upd_cte(mode: int) -> str:
    p = core_pinv(_start_core(), mode)
    names = [f"t{c}" for c in range(R * R)]
    return "upd AS (SELECT idx, " + ", ".join(f"{_lin(p[:, q], names)} AS c{q}" for q in range(R)) + " FROM ttm)"


def _start_core():
    return co.start_core_array(RANKS)


def _krows_cte(region: str, mode: int, name: str = "krows") -> str:
    a, b = other_modes(mode)
    prods = ", ".join(f"a.c{x} * b.c{y} AS k{x * R + y}" for x in range(R) for y in range(R))
    return (f"{name} AS (SELECT ({_local('pr.xa', f'p{b}')}) * {_blk_rows(region, a)} + {_local('pr.xb', f'p{a}')} AS id, {prods} "
            f"FROM (SELECT DISTINCT {COORD[b]} AS xa, {COORD[a]} AS xb FROM lab WHERE region = '{region}') pr "
            f"JOIN {_blk(region, b)} a ON a.idx = pr.xa JOIN {_blk(region, a)} b ON b.idx = pr.xb, pp)")


def _touched_cte(region: str, mode: int) -> str:
    return f"touched AS (SELECT * FROM f{mode} WHERE idx IN (SELECT {COORD[mode]} FROM lab WHERE region = '{region}'))"


def _data_core_cte(where: str, name: str) -> str:
    parts = []
    for p in range(R):
        for q in range(R):
            for r in range(R):
                parts.append(f"sum(c.val * a.c{p} * b.c{q} * d.c{r}) AS g_{p}_{q}_{r}")
    body = (f"SELECT {', '.join(parts)} FROM lab c JOIN f0 a ON a.idx = c.i JOIN f1 b ON b.idx = c.j "
            f"JOIN f2 d ON d.idx = c.k WHERE {where}")
    rows = " UNION ALL ".join(
        f"SELECT {p + 1} AS p, {q + 1} AS q, {r + 1} AS r, g_{p}_{q}_{r} AS g FROM s_{name}"
        for p in range(R) for q in range(R) for r in range(R))
    return f"s_{name} AS ({body}), {name} AS ({rows})"


def _matricize_sql(core: str, mode: int) -> str:
    a, b = other_modes(mode)
    x = ["p", "q", "r"]
    return (f"SELECT CAST({x[mode]} - 1 AS INTEGER) AS row, CAST(({x[a]} - 1) + ({x[b]} - 1) * {R} AS INTEGER) AS col, g "
            f"FROM {core}")


def _start_core_cte() -> str:
    g = _start_core()
    rows = " UNION ALL ".join(f"SELECT {p + 1} AS p, {q + 1} AS q, {r + 1} AS r, {float(g[p, q, r])}::DOUBLE AS g"
                              for p in range(R) for q in range(R) for r in range(R))
    return f"g0 AS ({rows})"


def oracles() -> dict:
    line_sets = ("ls AS (SELECT DISTINCT mode, idx FROM (SELECT 0 AS mode, i AS idx FROM t UNION ALL "
                 "SELECT 1, j FROM t UNION ALL SELECT 2, k FROM t), pp "
                 "WHERE idx <= CASE mode WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)")
    olds = "olds AS (SELECT * FROM o0 UNION ALL SELECT * FROM o1 UNION ALL SELECT * FROM o2)"
    filtered = "ff AS (SELECT o.* FROM olds o WHERE EXISTS (SELECT 1 FROM ls WHERE ls.mode = o.mode AND ls.idx = o.idx))"
    kcols = [f"k{c}" for c in range(R * R)]
    vrows = "vr AS (SELECT c.i, " + ", ".join(f"c.val * a.c{q} AS v{q}" for q in range(R)) + \
            " FROM t c JOIN f1 a ON a.idx = c.j)"
    vsum = "vs AS (SELECT i, " + ", ".join(f"sum(v{q}) AS v{q}" for q in range(R)) + " FROM vr GROUP BY i)"
    mu = float(MU)
    blend_cols = ", ".join(
        f"CASE WHEN u.c{q} IS NULL THEN p.c{q} ELSE {_num(mu)} * coalesce(p.c{q}, 0.0::DOUBLE) + {_num(1.0 - mu)} * u.c{q} END AS c{q}"
        for q in range(R))
    unfold_parts = []
    for m in MODES:
        a, b = other_modes(m)
        ca, cb = COORD[a], COORD[b]
        ext = f"(CASE WHEN {ca} > p{a} THEN d{a} - p{a} ELSE p{a} END)"
        unfold_parts.append(f"SELECT region, {m} AS mode, i, j, k, "
                            f"CAST({_local(ca, f'p{a}')} + {_local(cb, f'p{b}')} * {ext} AS BIGINT) AS col "
                            f"FROM new_cells, pp")
    whole = _data_core_cte("c.region <> '000'", "dc")
    pairs = [(p, q) for p in range(R) for q in range(R)]
    turn = ("gw AS (SELECT " + ", ".join(f"sum(a.c{p} * v.v{q}) AS g{p}_{q}" for p, q in pairs)
            + " FROM f0 a JOIN vs v ON v.i = a.idx), turn AS ("
            + " UNION ALL ".join(f"SELECT {p} AS a, {q} AS b, g{p}_{q} AS v FROM gw" for p, q in pairs) + ")")
    turned = []
    for m, x in enumerate("pqr"):
        keys = ", ".join("CAST(t.a + 1 AS INTEGER) AS " + c if c == x else "dc." + c for c in "pqr")
        turned.append(f"SELECT {m} AS mode, p, q, r, CAST(round(g / {TURN_UNIT}) AS BIGINT) AS g_scaled FROM "
                      f"(SELECT {keys}, sum(dc.g * t.v) AS g FROM dc JOIN turn t ON t.b = dc.{x} - 1 GROUP BY ALL)")
    new_rows = ("nls AS (SELECT DISTINCT mode, idx FROM (SELECT 0 AS mode, i AS idx FROM new_cells UNION ALL "
                "SELECT 1, j FROM new_cells UNION ALL SELECT 2, k FROM new_cells))")
    dense = ", ".join(f"CASE WHEN n.idx IS NULL THEN 0.0::DOUBLE ELSE f.c{q} END AS c{q}" for q in range(R))
    return {
        "read_coo": _with() + "SELECT i, j, k, val FROM t",
        "cut_regions": _with() + "SELECT region, i, j, k, val FROM new_cells",
        "local_index": _with() + f"SELECT i, j, k, {_local('i', 'p0')} AS li, {_local('j', 'p1')} AS lj, "
                                 f"{_local('k', 'p2')} AS lk FROM t, pp",
        "unfold_index": _with() + " UNION ALL ".join(unfold_parts),
        "line_sets": _with(line_sets) + "SELECT mode, idx FROM ls",
        "filter_factors": _with(line_sets, olds, filtered) + "SELECT * FROM ff",
        "filter_factors_bitmap": _with(line_sets, olds, filtered) + "SELECT * FROM ff",
        "line_bitmaps": _with() + "SELECT region, mode, count(DISTINCT idx) AS touched FROM (" + " UNION ALL ".join(
            f"SELECT region, {m} AS mode, {c} AS idx FROM new_cells" for m, c in enumerate(COORD)) + ") GROUP BY ALL",
        "factor_lookup": _with() + "SELECT c.j, c.i, c.k, c.val, a.c0 AS a0, a.c1 AS a1, a.c2 AS a2 FROM t c JOIN f1 a ON a.idx = c.j",
        "ttm_chain": _with() + _tasks(lambda r, m: _own(_ttm_cte(r, m)) + "SELECT * FROM ttm"),
        "ttm_by_bin": _with() + _tasks(lambda r, m: _own(_ttm_cte(r, m)) + "SELECT * FROM ttm"),
        "unfolded_join_multiply": _with() + _tasks(lambda r, m: _own(_ttm_cte(r, m)) + "SELECT idx, " + ", ".join(
            f"t{q + w * R} AS c{w * R + q}" for w in range(R) for q in range(R)) + " FROM ttm"),
        "kron_rows": _with() + _tasks(lambda r, m: _own(_krows_cte(r, m)) + "SELECT * FROM krows"),
        "kron_core_product": _with() + _tasks(lambda r, m: _own(_krows_cte(r, m)) + "SELECT id, " + ", ".join(
            f"{_lin(unfold(_start_core(), m).T[:, q], kcols)} AS c{q}" for q in range(R)) + " FROM krows"),
        "mode_dims": _with() + "SELECT d0 AS dim0, d1 AS dim1, d2 AS dim2 FROM pp",
        "cell_count": _with() + "SELECT count(*) AS cells FROM t",
        "slice_nnz": _with() + "SELECT * FROM hist",
        "slice_skew": _with(
            "ps AS (SELECT mode, slice, count(*) AS nnz FROM (SELECT 0 AS mode, i AS slice FROM t UNION ALL "
            "SELECT 1, j FROM t UNION ALL SELECT 2, k FROM t) GROUP BY ALL)",
            "pm AS (SELECT mode, stddev_pop(nnz) / avg(nnz) AS cv FROM ps GROUP BY mode)")
        + "SELECT " + ", ".join(f"CAST(round(max(CASE WHEN mode = {m} THEN cv END) * 1e9) AS BIGINT) AS cv{m}_e9"
                                for m in MODES) + ", CAST(round(avg(cv) * 1e9) AS BIGINT) AS slice_skew_e9 FROM pm",
        "bucket_map": _with(*_lpt_ctes(), recursive=True) + "SELECT * FROM bmap",
        "bucket_map_wide": _with(*_lpt_ctes(1000), recursive=True) + "SELECT * FROM bmap",
        "bin_layout": _with(*_lpt_ctes(), recursive=True) + "SELECT region, mode, part_id, part_id - 1 AS partition, "
                      "count(*) AS cells FROM (" + _labelled_cells_sql("bmap") + ") GROUP BY ALL",
        "bucket_partition": _with(*_lpt_ctes(), recursive=True) + _labelled_cells_sql("bmap"),
        "greedy_map": _with(*_greedy_ctes(), recursive=True) + "SELECT * FROM gmap",
        "greedy_partition": _with(*_greedy_ctes(), recursive=True) + _labelled_cells_sql("gmap"),
        "group_by_part": _with(*_lpt_ctes(), recursive=True) + "SELECT region, mode, part_id, part_id - 1 AS partition, "
                         "count(*) AS cells FROM (" + _labelled_cells_sql("bmap") + ") GROUP BY ALL",
        "partition_cv": _with(*_lpt_ctes(), *_cv_ctes("bmap"), recursive=True) + CV_SELECT,
        "partition_cv_mean": _with(*_lpt_ctes(), *_cv_ctes("bmap"), recursive=True)
        + "SELECT CAST(round(avg(cv) * 1e9) AS BIGINT) AS partition_cv_e9, "
          "CAST(round(avg(cv_exact) * 1e9) AS BIGINT) AS partition_cv_exact_e9, count(*) AS groups FROM cv",
        "partition_stage": _with(*_greedy_ctes(), *_cv_ctes("gmap"), recursive=True) + CV_SELECT,
        "vector_sum": _with(vrows, vsum) + "SELECT * FROM vs",
        "gram": _with(vrows, vsum) + "SELECT p, q, g FROM (SELECT " + ", ".join(
            f"sum(a.c{p} * v.v{q}) AS g{p}_{q}" for p in range(R) for q in range(R))
        + " FROM f0 a JOIN vs v ON v.i = a.idx) UNPIVOT (g FOR pq IN (" + ", ".join(
            f"g{p}_{q}" for p in range(R) for q in range(R)) + ")) JOIN (VALUES " + ", ".join(
            f"('g{p}_{q}', {p}, {q})" for p in range(R) for q in range(R)) + ") AS m(pq, p, q) USING (pq)",
        "update_factor": _with() + _tasks(lambda r, m: _own(_ttm_cte(r, m), _upd_cte(m)) + "SELECT * FROM upd"),
        "blend_factor": _with() + _tasks(lambda r, m: _own(_ttm_cte(r, m), _upd_cte(m))
                                         + f"SELECT coalesce(p.idx, u.idx) AS idx, {blend_cols} FROM n{m} p FULL OUTER JOIN upd u ON u.idx = p.idx"),
        "orthonormalize": _with() + _tasks(lambda r, m: _own(_touched_cte(r, m), *_mgs_named("touched", "qq")) + "SELECT idx, " + ", ".join(
            f"CAST(round(c{c} * 1e9) AS BIGINT) AS c{c}_e9" for c in range(R)) + " FROM qq"),
        "stack_split": _with() + _tasks(lambda r, m: _own(_touched_cte(r, m)) + f"SELECT idx, c0, c1, c2, 'old' AS block FROM o{m} "
                                        "UNION ALL SELECT idx, c0, c1, c2, 'new' AS block FROM touched"),
        "init_factor": _with() + "SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2",
        "factor_layout": _with(line_sets, olds, filtered) + " UNION ALL ".join(
            f"SELECT mode, idx, {q} AS col, c{q} AS value FROM ff" for q in range(R)),
        "factor_layout_dense": _with(new_rows, "fs AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2)")
        + f"SELECT f.mode, f.idx, {dense} FROM fs f LEFT JOIN nls n ON n.mode = f.mode AND n.idx = f.idx",
        "partition_stage_bucket": _with(*_lpt_ctes(), recursive=True) + _labelled_cells_sql("bmap"),
        "matricize": _with(whole) + " UNION ALL ".join(
            f"SELECT {m} AS mode, * FROM ({_matricize_sql('dc', m)})" for m in MODES),
        "fold": _with(whole) + " UNION ALL ".join(f"SELECT {m} AS mode, p, q, r, g FROM dc" for m in MODES),
        "core_add": _with(whole, _start_core_cte())
        + "SELECT p, q, r, sum(g) AS g FROM (SELECT * FROM dc UNION ALL SELECT * FROM g0) GROUP BY ALL",
        "core_mode_product": _with(whole, vrows, vsum, turn) + " UNION ALL ".join(turned),
        "update_core": _with(whole) + "SELECT p, q, r, g FROM dc",
        "update_core_wide": _core_wide_sql(),
        "project_wide": _with() + _tasks(_project_wide_sql),
    }


# ------------------------------------------------------------------ the whole update in SQL

def _mgs_named(src: str, out: str) -> list[str]:
    """Gram-Schmidt of a 3-column table ``src(idx, c0, c1, c2)`` -> ``out``: the
    columns are brought to unit norm, then made orthogonal one by one; one of
    which next to nothing is left (dependent) becomes a zero column."""
    def unit(q):
        return f"CASE WHEN w{q} > 0 THEN c{q} / sqrt(w{q}) ELSE 0.0 END AS c{q}"

    def without(left, column):
        return f"CASE WHEN {left} <= 1e-12 THEN 0.0 ELSE ({column}) / sqrt({left}) END"

    return [
        f"{out}_w AS (SELECT sum(c0*c0) AS w0, sum(c1*c1) AS w1, sum(c2*c2) AS w2 FROM {src})",
        f"{out}_n AS (SELECT idx, {unit(0)}, {unit(1)}, {unit(2)} FROM {src}, {out}_w)",
        f"""{out}_g AS (SELECT sum(c0*c0) AS g00, sum(c0*c1) AS g01, sum(c0*c2) AS g02,
                              sum(c1*c1) AS g11, sum(c1*c2) AS g12, sum(c2*c2) AS g22 FROM {out}_n)""",
        f"{out}_b AS (SELECT *, {without('g00', 'g01')} AS r01, {without('g00', 'g02')} AS r02 FROM {out}_g)",
        f"{out}_c AS (SELECT *, g11 - r01 * r01 AS l1 FROM {out}_b)",
        f"{out}_d AS (SELECT *, {without('l1', 'g12 - r01 * r02')} AS r12 FROM {out}_c)",
        f"{out}_k AS (SELECT *, g22 - r02 * r02 - r12 * r12 AS l2 FROM {out}_d)",
        f"{out}_q AS (SELECT idx, c1, c2, l1, l2, r01, r02, r12, {without('g00', 'c0')} AS q0 FROM {out}_n, {out}_k)",
        f"{out}_r AS (SELECT *, {without('l1', 'c1 - r01 * q0')} AS q1 FROM {out}_q)",
        f"{out} AS (SELECT idx, q0 AS c0, q1 AS c1, {without('l2', 'c2 - r02 * q0 - r12 * q1')} AS c2 FROM {out}_r)",
    ]


def _update_ctes() -> tuple[list[str], dict, dict, list]:
    """CTEs of start model + factor stage; returns (ctes, start blocks, new
    blocks, steps as (cte tag, region, mode))."""
    from ..functions.index import C1_REGION, C3_REGION, c2_regions

    core = _start_core()
    ctes = []
    start, new = {}, {}
    steps = []
    for m in MODES:
        cols = ", ".join(f"{_f(m, 'idx', q)} / 1000.0 AS c{q}" for q in range(R))
        ctes.append(f"raw{m} AS (SELECT idx, {cols} FROM (SELECT unnest(generate_series(1, p{m})) AS idx FROM pp))")
        ctes += _mgs_named(f"raw{m}", f"s{m}")
        start[m] = f"s{m}"
    names = [f"t{c}" for c in range(R * R)]

    def step(m: int, region: str, blend: bool, tag: str):
        a, b = other_modes(m)
        blk_a = new[a] if region[a] == "1" else start[a]
        blk_b = new[b] if region[b] == "1" else start[b]
        # a factor row that is not there is a zero row: its cells count, with zeros
        sums = ", ".join(f"sum(c.val * coalesce(a.c{q}, 0.0::DOUBLE) * coalesce(b.c{r}, 0.0::DOUBLE)) AS t{q + r * R}"
                         for r in range(R) for q in range(R))
        ctes.append(f"{tag}_t AS (SELECT c.{COORD[m]} AS idx, {sums} FROM lab c "
                    f"LEFT JOIN {blk_a} a ON a.idx = c.{COORD[a]} LEFT JOIN {blk_b} b ON b.idx = c.{COORD[b]} "
                    f"WHERE c.region = '{region}' GROUP BY c.{COORD[m]})")
        pinv = core_pinv(core, m)
        ctes.append(f"{tag}_u AS (SELECT idx, " + ", ".join(f"{_lin(pinv[:, q], names)} AS c{q}" for q in range(R))
                    + f" FROM {tag}_t)")
        src = f"{tag}_u"
        if blend:
            cols = ", ".join(
                f"CASE WHEN u.c{q} IS NULL THEN p.c{q} ELSE {_num(MU)} * coalesce(p.c{q}, 0.0::DOUBLE) "
                f"+ {_num(1.0 - MU)} * u.c{q} END AS c{q}" for q in range(R))
            ctes.append(f"{tag}_b AS (SELECT coalesce(p.idx, u.idx) AS idx, {cols} "
                        f"FROM {new[m]} p FULL OUTER JOIN {tag}_u u ON u.idx = p.idx)")
            src = f"{tag}_b"
        ctes.extend(_mgs_named(src, f"{tag}_q"))
        new[m] = f"{tag}_q"
        steps.append((tag, region, m))

    for m in MODES:
        step(m, C1_REGION[m], False, f"c1m{m}")
    for m in MODES:
        for n, region in enumerate(c2_regions(m)):
            step(m, region, True, f"c2m{m}s{n}")
    for m in MODES:
        step(m, C3_REGION, True, f"c3m{m}")
    return ctes, start, new, steps


def _scaled(src: str, mode: int) -> str:
    return (f"SELECT {mode} AS mode, idx, " + ", ".join(f"CAST(round(c{q} * 1e9) AS BIGINT) AS c{q}_e9"
                                                           for q in range(R)) + f" FROM {src}")


def _final_ctes(start: dict, new: dict) -> list[str]:
    ctes = []
    for m in MODES:
        ctes.append(f"stk{m} AS (SELECT * FROM {start[m]} UNION ALL SELECT * FROM {new[m]})")
        ctes += _mgs_named(f"stk{m}", f"fin{m}")
    return ctes


def update_oracles() -> dict:
    ctes, start, new, steps = _update_ctes()
    fin = _final_ctes(start, new)
    rot = [f"rot{m} AS (SELECT {m} AS m, a.a, b.b, sum(a.v * b.v) AS v FROM "
           f"(SELECT f.idx, x.a, CASE x.a WHEN 0 THEN f.c0 WHEN 1 THEN f.c1 ELSE f.c2 END AS v "
           f"FROM fin{m} f, pp, (VALUES (0), (1), (2)) x(a) WHERE f.idx <= p{m}) a JOIN "
           f"(SELECT s.idx, y.b, CASE y.b WHEN 0 THEN s.c0 WHEN 1 THEN s.c1 ELSE s.c2 END AS v "
           f"FROM {start[m]} s, (VALUES (0), (1), (2)) y(b)) b ON a.idx = b.idx GROUP BY ALL)" for m in MODES]
    rotated = ("g1 AS (SELECT CAST(m0.a + 1 AS INTEGER) AS p, CAST(m1.a + 1 AS INTEGER) AS q, "
               "CAST(m2.a + 1 AS INTEGER) AS r, sum(g0.g * m0.v * m1.v * m2.v) AS g FROM g0 "
               "JOIN rot0 m0 ON m0.b = g0.p - 1 JOIN rot1 m1 ON m1.b = g0.q - 1 JOIN rot2 m2 ON m2.b = g0.r - 1 "
               "GROUP BY ALL)")
    parts = [f"sum(c.val * a.c{p} * b.c{q} * d.c{r}) AS g_{p}_{q}_{r}"
             for p in range(R) for q in range(R) for r in range(R)]
    weights = {r: 1 for r in ("100", "010", "001", "011", "101", "110", "111")}
    published = dict(PUBLISHED_CORE_WEIGHTS)
    delta_rows = "dl AS (" + " UNION ALL ".join(
        f"SELECT {p + 1} AS p, {q + 1} AS q, {r + 1} AS r, g_{p}_{q}_{r} AS g FROM dsum"
        for p in range(R) for q in range(R) for r in range(R)) + ")"

    def core_ctes(schedule: dict) -> list[str]:
        weight = "CASE c.region " + " ".join(f"WHEN '{r}' THEN {float(w)}::DOUBLE" for r, w in schedule.items()) + " ELSE 0.0::DOUBLE END"
        weighted = [x.replace("sum(c.val", f"sum({weight} * c.val") for x in parts]
        delta = (f"dsum AS (SELECT {', '.join(weighted)} FROM lab c JOIN fin0 a ON a.idx = c.i JOIN fin1 b ON b.idx = c.j "
                 f"JOIN fin2 d ON d.idx = c.k WHERE c.region <> '000')")
        return [*rot, _start_core_cte(), rotated, delta, delta_rows]

    core_rows = ("SELECT p, q, r, CAST(round(sum(g) * 1e9) AS BIGINT) AS g_e9 FROM "
                 "(SELECT * FROM g1 UNION ALL SELECT * FROM dl) GROUP BY ALL")
    regions = ", ".join(f"('{r}')" for r in ("000", "100", "010", "001", "011", "101", "110", "111"))
    none = "NULL::BIGINT"
    metrics = (
        f"SELECT 'cells' AS name, rg.region, NULL::INTEGER AS mode, {none} AS idx, CAST(coalesce(n, 0) * 1e9 AS BIGINT) AS value_e9 "
        f"FROM (VALUES {regions}) rg(region) LEFT JOIN (SELECT region, count(*) AS n FROM lab GROUP BY region) c "
        f"USING (region) UNION ALL "
        + " UNION ALL ".join(f"SELECT 'dim', NULL, {m}, {none}, CAST(d{m} * 1e9 AS BIGINT) FROM pp UNION ALL "
                             f"SELECT 'pre_dim', NULL, {m}, {none}, CAST(p{m} * 1e9 AS BIGINT) FROM pp" for m in MODES)
        + f" UNION ALL SELECT 'partition_cv', NULL, NULL, {none}, CAST(round(avg(cv) * 1e9) AS BIGINT) FROM cv"
        f" UNION ALL SELECT 'partition_cv', region, mode, {none}, CAST(round(cv * 1e9) AS BIGINT) FROM cv"
        f" UNION ALL SELECT 'partition_cv_exact', region, mode, {none}, CAST(round(cv_exact * 1e9) AS BIGINT) FROM cv"
        + "".join(f" UNION ALL SELECT 'rank_deficient', '{region}', {m}, {none}, CAST(1e9 AS BIGINT) FROM {tag}_q_k "
                  f"WHERE g00 <= 1e-12 OR l1 <= 1e-12 OR l2 <= 1e-12" for tag, region, m in steps))
    model = (" UNION ALL ".join(
        f"SELECT 'f{q}' AS name, NULL AS region, {m} AS mode, idx, CAST(round(c{q} * 1e9) AS BIGINT) AS value_e9 FROM fin{m}"
        for m in MODES for q in range(R))
        + f" UNION ALL SELECT 'core', NULL, NULL, CAST(100 * p + 10 * q + r AS BIGINT), g_e9 FROM ({core_rows})")
    job = (_with(*_greedy_ctes(), *_cv_ctes("gmap"), *ctes, *fin, *core_ctes(weights), recursive=True)
           + f"SELECT * FROM ({metrics}) UNION ALL SELECT * FROM ({model})")
    return {
        "update_factor_gram": _with() + _tasks(_gram_update_sql),
        "tucker_job": job,
        "write_model": job,
        "factor_stage": _with(*ctes) + " UNION ALL ".join(_scaled(new[m], m) for m in MODES),
        "factor_stage_sparse": _with(*ctes, tensor=PURCHASES_SQL) + " UNION ALL ".join(_scaled(new[m], m) for m in MODES),
        "incremental_update": _with(*ctes, *fin) + " UNION ALL ".join(_scaled(f"fin{m}", m) for m in MODES),
        "core_stage": _with(*ctes, *fin, *core_ctes(weights)) + core_rows,
        "core_stage_published": _with(*ctes, *fin, *core_ctes(published)) + core_rows,
    }


def _gram_update_sql(region: str, mode: int) -> str:
    """``update_factor_gram`` of one task: W = G^T inv(G (B'B (x) A'A) G^T)
    from the two block Grams (inverse by cofactors), Kronecker rows of the
    occurring pairs times W, joined on the unfolding column."""
    a_, b_ = other_modes(mode)
    ca, cb = COORD[a_], COORD[b_]
    gm = unfold(_start_core(), mode)
    n = R * R
    ga = ("ga AS (SELECT " + ", ".join(f"sum(c{x} * c{y}) AS a{x}{y}" for x in range(R) for y in range(R))
          + f" FROM {_blk(region, a_)})")
    gb = ("gb AS (SELECT " + ", ".join(f"sum(c{x} * c{y}) AS b{x}{y}" for x in range(R) for y in range(R))
          + f" FROM {_blk(region, b_)})")
    m_cols = []
    for p in range(R):
        for s_ in range(R):
            terms = [f"{_num(gm[p, c] * gm[s_, d])} * (b{c // R}{d // R} * a{c % R}{d % R})"
                     for c in range(n) for d in range(n)]
            m_cols.append(f"{' + '.join(terms)} AS m{p}{s_}")
    mm = f"mm AS (SELECT {', '.join(m_cols)} FROM ga, gb)"

    def cof(i, j):
        rows = [r for r in range(R) if r != i]
        cols = [c for c in range(R) if c != j]
        sign = "" if (i + j) % 2 == 0 else "-"
        return (f"{sign}(m{rows[0]}{cols[0]} * m{rows[1]}{cols[1]} - m{rows[0]}{cols[1]} * m{rows[1]}{cols[0]})")
    det = " + ".join(f"m0{j} * {cof(0, j)}" for j in range(R))
    inv = ("iv AS (SELECT " + ", ".join(f"({cof(j, i)}) / det AS v{i}{j}" for i in range(R) for j in range(R))
           + f" FROM (SELECT *, {det} AS det FROM mm))")
    w = ("ww AS (SELECT " + ", ".join(
        " + ".join(f"{_num(gm[s_, c])} * v{s_}{p}" for s_ in range(R)) + f" AS w{c}_{p}"
        for c in range(n) for p in range(R)) + " FROM iv)")
    krows = _krows_cte(region, mode, "kr")
    rw = ("rw AS (SELECT id, " + ", ".join(
        " + ".join(f"k{c} * w{c}_{p}" for c in range(n)) + f" AS c{p}" for p in range(R)) + " FROM kr, ww)")
    col = f"({_local(f'c.{ca}', f'p{a_}')} + {_local(f'c.{cb}', f'p{b_}')} * {_blk_rows(region, a_)})"
    y = (f"SELECT c.{COORD[mode]} AS idx, " + ", ".join(f"CAST(round(sum(c.val * r.c{p}) * {GRAM_UNIT}) AS BIGINT) AS c{p}_scaled"
                                                       for p in range(R))
         + f" FROM lab c, pp JOIN rw r ON r.id = {col} WHERE c.region = '{region}' GROUP BY c.{COORD[mode]}")
    return _own(ga, gb, mm, inv, w, krows, rw) + y
