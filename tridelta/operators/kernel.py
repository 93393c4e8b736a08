"""The contraction kernel and the updates built on it.

``ttm_chain`` computes, for mode ``m`` with other modes ``a < b``,
``T[x_m, q + r*R_a] = sum val * A[x_a, q] * B[x_b, r]`` — the mode-m
unfolding times (B kron A), one Kronecker row per cell, never the whole
product. Plan: two equi-joins (broadcast only under a proven row bound)
and one grouped aggregation (partial then final)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.index import COORD, coord, local_index, other_modes, unfold_index
from ..functions.linalg import core_pinv, fold, unfold
from .factors import blend_factor, factor_lookup, gram, lin_expr, num, project, rename_cols

# Above this many output columns the kernel contracts one mode at a time.
WIDE_LIMIT = 64
# Up to this many sums are one global aggregate (all in one codegen span).
SUM_LIMIT = 64
# Products that a worker holds at a time beyond these limits.
BLOCK_VALUES = 1 << 20


def ttm_chain(cells: DataFrame, mode: int, a_block: DataFrame, rank_a: int, a_rows: int,
              b_block: DataFrame, rank_b: int, b_rows: int, layout: str = "auto", keep_cells: bool = False,
              keys: tuple = ()) -> DataFrame:
    """``(idx, t0..t{Ra*Rb-1})`` for the rows of ``mode`` that have cells; those
    of which every cell meets a zero factor row only with ``keep_cells``.
    ``keys``: columns to group by, too, which come first in the result; cells
    stored by such a key are summed where they are."""
    a, b = other_modes(mode)
    ca, cb = COORD[a], COORD[b]
    x = cells.selectExpr(*keys, f"{COORD[mode]} AS idx", ca, cb, "val")
    if layout == "auto":
        layout = "wide" if rank_a * rank_b <= WIDE_LIMIT else "staged"
    if layout == "wide":
        x = factor_lookup(x, a_block, ca, rank_a, "a", a_rows, keep_cells)
        x = factor_lookup(x, b_block, cb, rank_b, "b", b_rows, keep_cells)
        aggs = [F.expr(f"sum(val * a{q} * b{r}) AS t{q + r * rank_a}")
                for r in range(rank_b) for q in range(rank_a)]
        return x.groupBy(*keys, "idx").agg(*aggs)
    # staged: contract mode b per (idx, x_a), then mode a per idx
    x = factor_lookup(x, b_block, cb, rank_b, "b", b_rows, keep_cells)
    s = x.groupBy(*keys, "idx", ca).agg(*[F.expr(f"sum(val * b{r}) AS s{r}") for r in range(rank_b)])
    s = factor_lookup(s, a_block, ca, rank_a, "a", a_rows, keep_cells)
    aggs = [F.expr(f"sum(a{q} * s{r}) AS t{q + r * rank_a}") for r in range(rank_b) for q in range(rank_a)]
    return s.groupBy(*keys, "idx").agg(*aggs)


def ttm_by_bin(whole: DataFrame, split: DataFrame | None, mode: int, *blocks, keep_cells: bool = False) -> DataFrame:
    """:func:`ttm_chain` of cells stored by bin: bins of the layout are contracted
    where they lie, without an exchange; the few that were split because one
    task should not hold them are summed as usual. No slice is in both."""
    rows = ttm_chain(whole, mode, *blocks, keep_cells=keep_cells, keys=("bin_key",)).drop("bin_key")
    if split is None:
        return rows
    return rows.unionByName(ttm_chain(split, mode, *blocks, keep_cells=keep_cells))


def update_by_bin(whole: DataFrame, split: DataFrame | None, mode: int, core: np.ndarray, a_block, rank_a, a_rows,
                  b_block, rank_b, b_rows, keep_cells: bool = False) -> DataFrame:
    """:func:`update_factor` of cells stored by bin. At high ranks what crosses
    the exchange are rank-wide sums by block, from all bins alike."""
    if rank_a * rank_b > WIDE_LIMIT:
        cells = whole.select("i", "j", "k", "val")
        if split is not None:
            cells = cells.unionByName(split.select("i", "j", "k", "val"))
        return update_factor(cells, mode, core, a_block, rank_a, a_rows, b_block, rank_b, b_rows, keep_cells)
    t = ttm_by_bin(whole, split, mode, a_block, rank_a, a_rows, b_block, rank_b, b_rows, keep_cells=keep_cells)
    return apply_right(t, rank_a * rank_b, core_pinv(core, mode))


def apply_right(t: DataFrame, n_in: int, mat: np.ndarray) -> DataFrame:
    """Rows of ``t`` (columns t0..) times a constant ``n_in x r`` matrix."""
    names = [f"t{c}" for c in range(n_in)]
    return t.selectExpr("idx", *[f"{lin_expr(mat[:, q], names)} AS c{q}" for q in range(mat.shape[1])])


def update_factor(cells: DataFrame, mode: int, core: np.ndarray, a_block, rank_a, a_rows,
                  b_block, rank_b, b_rows, keep_cells: bool = False) -> DataFrame:
    """New rows ``U[x,:] = T[x,:] . pinv(G_(mode))`` for rows with cells
    (exact when the other blocks are orthonormal)."""
    if rank_a * rank_b > WIDE_LIMIT:
        return project_by_blocks(cells, mode, core_pinv(core, mode), a_block, rank_a, a_rows, b_block, rank_b, b_rows, keep_cells)
    t = ttm_chain(cells, mode, a_block, rank_a, a_rows, b_block, rank_b, b_rows, keep_cells=keep_cells)
    return apply_right(t, rank_a * rank_b, core_pinv(core, mode))


def project_by_blocks(cells: DataFrame, mode: int, right: np.ndarray, a_block, rank_a, a_rows,
                      b_block, rank_b, b_rows, keep_cells: bool = False) -> DataFrame:
    """``T . right`` (see :func:`ttm_chain`) without a column per entry of ``T``.

    A block of cells is sorted by ``idx``, its products are summed by run
    (one segment reduction), and the sums are multiplied by ``right`` at once, as both
    steps are linear. So the aggregation that follows - partial, then final - has the
    columns of ``right`` (the rank) instead of rank_a x rank_b."""
    a, b = other_modes(mode)
    ca, cb = COORD[a], COORD[b]
    n, n_out = right.shape
    x = cells.selectExpr(f"CAST({COORD[mode]} AS BIGINT) AS idx", ca, cb, "val")
    x = factor_lookup(x, a_block, ca, rank_a, "a", a_rows, keep_cells)
    x = factor_lookup(x, b_block, cb, rank_b, "b", b_rows, keep_cells)
    x = x.select("idx", F.col("val").cast("double"), *[f"a{q}" for q in range(rank_a)], *[f"b{r}" for r in range(rank_b)])
    step = max(1, BLOCK_VALUES // n)
    names = ["idx", *[f"c{q}" for q in range(n_out)]]

    def blocks(batches):
        import numpy
        import pyarrow

        for whole in batches:
            for at in range(0, whole.num_rows, step):
                part = whole.slice(at, step)
                idx = part.column(0).to_numpy()
                order = idx.argsort(kind="stable")
                idx = idx[order]
                rows = numpy.column_stack([c.to_numpy() for c in part.columns[1:]])[order]
                left = rows[:, 1:1 + rank_a] * rows[:, :1]
                products = (rows[:, 1 + rank_a:, None] * left[:, None, :]).reshape(len(idx), n)
                starts = numpy.flatnonzero(numpy.concatenate([[True], idx[1:] != idx[:-1]]))
                out = numpy.add.reduceat(products, starts, axis=0) @ right
                yield pyarrow.RecordBatch.from_arrays(
                    [pyarrow.array(idx[starts]), *[pyarrow.array(out[:, q]) for q in range(n_out)]], names)

    sums = x.mapInArrow(blocks, ", ".join(["idx bigint", *[f"{c} double" for c in names[1:]]]))
    return sums.groupBy("idx").agg(*[F.sum(c).alias(c) for c in names[1:]])


def core_sums(cells: DataFrame, blocks: dict, ranks, rows: dict) -> DataFrame:
    """``(p, c, v)``, 0-based: entry ``c = q + r*R_1`` of slab ``p`` of
    ``sum val * U0[i] (x) U1[j] (x) U2[k]``. A task holds one accumulator of
    the core's size and adds a matrix product per block of cells; what it sends
    is a row per slab, and they are added up entry by entry."""
    r0, r1, r2 = (int(r) for r in ranks)
    x = cells.select("i", "j", "k", F.col("val").cast("double"))
    for m in (0, 1, 2):
        x = factor_lookup(x, blocks[m], COORD[m], int(ranks[m]), f"u{m}_", rows[m])
    x = x.select("val", *[f"u{m}_{q}" for m in (0, 1, 2) for q in range(int(ranks[m]))])
    step = max(1, BLOCK_VALUES // (r1 * r2))

    def slabs(batches):
        import numpy
        import pyarrow

        total = None
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                y = numpy.column_stack([c.to_numpy() for c in whole.slice(at, step).columns])
                u, v, w = y[:, 1:1 + r0] * y[:, :1], y[:, 1 + r0:1 + r0 + r1], y[:, 1 + r0 + r1:]
                part = u.T @ (w[:, :, None] * v[:, None, :]).reshape(len(y), r1 * r2)
                total = part if total is None else total + part
        if total is not None:
            yield pyarrow.RecordBatch.from_arrays(
                [pyarrow.array(range(len(total)), pyarrow.int32()),
                 pyarrow.array(total.tolist(), pyarrow.list_(pyarrow.float64()))], ["p", "sums"])

    parts = x.mapInArrow(slabs, "p int, sums array<double>")
    return parts.select("p", F.posexplode("sums").alias("c", "v")).groupBy("p", "c").agg(F.sum("v").alias("v"))


def contract_all(cells: DataFrame, blocks: dict, ranks, rows: dict, weight: str | None = None) -> np.ndarray:
    """``sum val * U0[i] (x) U1[j] (x) U2[k]`` as an r0 x r1 x r2 array. Few sums:
    the kernel along mode 0, then ``U0^T T`` over the (small) kernel output as
    one aggregate; more are :func:`core_sums`."""
    x = cells if weight is None else cells.selectExpr("i", "j", "k", f"val * {weight} AS val")
    n = ranks[1] * ranks[2]
    mat = np.zeros((ranks[0], n))
    if ranks[0] * n <= SUM_LIMIT:
        row = _core_row(x, blocks, ranks, rows).collect()[0]
        for p in range(ranks[0]):
            mat[p] = [float(row[f"m{p}_{c}"] or 0.0) for c in range(n)]
    else:
        for r in core_sums(x, blocks, ranks, rows).collect():  # as many rows as the core has entries
            mat[r["p"], r["c"]] = r["v"]
    return fold(mat, 0, tuple(ranks))


def _core_row(cells: DataFrame, blocks: dict, ranks, rows: dict) -> DataFrame:
    """All entries of the contraction as columns of one row."""
    t = ttm_chain(cells, 0, blocks[1], ranks[1], rows[1], blocks[2], ranks[2], rows[2])
    joined = t.join(rename_cols(blocks[0], ranks[0], "idx", "u"), "idx")
    return joined.agg(*[F.expr(f"sum(u{p} * t{c}) AS m{p}_{c}") for p in range(ranks[0]) for c in range(ranks[1] * ranks[2])])


def kron_rows(pairs: DataFrame, a_block: DataFrame, rank_a: int, a_pre: int, a_rows: int,
              b_block: DataFrame, rank_b: int, b_pre: int, b_rows: int) -> DataFrame:
    """Kronecker rows ``A (x) B`` only for the index pairs ``(xa, xb)`` that
    occur: row id ``la * rows(B) + lb`` (block-local 0-based), column
    ``x * Rb + y`` = ``A[xa, x] * B[xb, y]``. Size = number of pairs, so no
    cross product is ever formed."""
    p = pairs.select(F.col("xa"), F.col("xb")).distinct()
    p = factor_lookup(p, a_block, "xa", rank_a, "a", a_rows)
    p = factor_lookup(p, b_block, "xb", rank_b, "b", b_rows)
    rid = local_index(F.col("xa"), a_pre) * F.lit(int(b_rows)) + local_index(F.col("xb"), b_pre)
    return p.select(rid.cast("long").alias("id"),
                    *[(F.col(f"a{x}") * F.col(f"b{y}")).alias(f"k{x * rank_b + y}")
                      for x in range(rank_a) for y in range(rank_b)])


def kron_core_product(krows: DataFrame, n_cols: int, core: np.ndarray, mode: int) -> DataFrame:
    """``K . G_(mode)^T`` row-wise: ``(id, c0..c{r_mode-1})``."""
    gm = unfold(core, mode)
    renamed = krows.select(F.col("id").alias("idx"), *[F.col(f"k{c}").alias(f"c{c}") for c in range(n_cols)])
    return project(renamed, n_cols, gm.T).withColumnRenamed("idx", "id")


def unfolded_join_multiply(cells: DataFrame, mode: int, rows_k: DataFrame, n_cols: int,
                           pre_dims, dims) -> DataFrame:
    """``Y[x_mode,:] = sum val * K[unfold_index(cell), :]``: one shuffled
    equi-join on the unfolding column, then a grouped sum."""
    x = cells.select(coord(mode).alias("idx"), unfold_index(mode, pre_dims, dims).alias("id"), "val")
    j = x.join(rows_k, "id")
    return j.groupBy("idx").agg(*[F.sum(F.col("val") * F.col(f"c{c}")).alias(f"c{c}") for c in range(n_cols)])


def update_factor_gram(cells: DataFrame, mode: int, core: np.ndarray, a_block, rank_a, a_rows,
                       b_block, rank_b, b_rows, pre_dims, dims) -> DataFrame:
    """Baseline update ``X_(m) K pinv-term`` without assuming orthonormal
    blocks: ``W = G^T pinv(G (B^TB (x) A^TA) G^T)`` from small Grams, then
    Kronecker rows of the occurring pairs times ``W``, joined on the
    unfolding column. Empty when a factor block has no rows."""
    a, b = other_modes(mode)
    spark = cells.sparkSession
    r_m = core.shape[mode]
    if a_rows == 0 or b_rows == 0:
        return spark.createDataFrame([], "idx long, " + ", ".join(f"c{q} double" for q in range(r_m)))
    gm = unfold(core, mode)
    ktk = np.kron(gram(b_block, rank_b), gram(a_block, rank_a))
    w = gm.T @ np.linalg.pinv(gm @ ktk @ gm.T)
    pairs = cells.select(coord(b).alias("xa"), coord(a).alias("xb"))
    krows = kron_rows(pairs, b_block, rank_b, pre_dims[b], b_rows, a_block, rank_a, pre_dims[a], a_rows)
    n = rank_a * rank_b
    renamed = krows.select(F.col("id").alias("idx"), *[F.col(f"k{c}").alias(f"c{c}") for c in range(n)])
    rows_w = project(renamed, n, w).withColumnRenamed("idx", "id")
    return unfolded_join_multiply(cells, mode, rows_w, r_m, pre_dims, dims)


def contract_frame(cells: DataFrame, blocks: dict, ranks, rows: dict) -> DataFrame:
    """Same contraction as :func:`contract_all`, left as a core table
    ``(p, q, r, g)`` (1-based) computed entirely on the executors."""
    n = ranks[1] * ranks[2]
    if ranks[0] * n > SUM_LIMIT:
        return core_sums(cells, blocks, ranks, rows).selectExpr(
            "p + 1 AS p", f"c % {ranks[1]} + 1 AS q", f"CAST(floor(c / {ranks[1]}) AS INT) + 1 AS r", "v AS g")
    entries = ", ".join(
        f"struct({p + 1} AS p, {c % ranks[1] + 1} AS q, {c // ranks[1] + 1} AS r, m{p}_{c} AS g)"
        for p in range(ranks[0]) for c in range(n))
    return _core_row(cells, blocks, ranks, rows).selectExpr(f"inline(array({entries}))")


def update_and_blend(cells: DataFrame, mode: int, core: np.ndarray, a_block, rank_a, a_rows,
                     b_block, rank_b, b_rows, prev: DataFrame, rank: int, mu: float) -> DataFrame:
    """:func:`update_factor` then the blend with ``prev``. A row with cells gets
    ``mu*prev + (1-mu)*update``, also if all its cells meet absent (zero) factor
    rows and its update is zero; a row without cells keeps ``prev``; a missing
    previous row counts as zero.

    At small ranks this is ONE aggregation: the previous block's rows join the
    cell products before the grouping by row index (one shuffle instead of a
    kernel shuffle plus a join shuffle). Beyond, the update is summed by blocks
    (:func:`project_by_blocks`) and the blend is a join of the two row tables."""
    if rank_a * rank_b + rank > WIDE_LIMIT:
        cur = update_factor(cells, mode, core, a_block, rank_a, a_rows, b_block, rank_b, b_rows, keep_cells=True)
        return blend_factor(prev, cur, rank, mu)
    a, b = other_modes(mode)
    ca, cb = COORD[a], COORD[b]
    n = rank_a * rank_b
    x = cells.selectExpr(f"{COORD[mode]} AS idx", ca, cb, "val")
    x = factor_lookup(x, a_block, ca, rank_a, "a", a_rows, keep_cells=True)
    x = factor_lookup(x, b_block, cb, rank_b, "b", b_rows, keep_cells=True)
    prods = x.selectExpr("idx", *[f"val * a{q} * b{r} AS t{q + r * rank_a}" for r in range(rank_b) for q in range(rank_a)],
                         *[f"CAST(NULL AS DOUBLE) AS p{q}" for q in range(rank)], "1 AS has_cells")
    old = prev.selectExpr("idx", *[f"CAST(NULL AS DOUBLE) AS t{c}" for c in range(n)],
                          *[f"c{q} AS p{q}" for q in range(rank)], "0 AS has_cells")
    g = prods.unionByName(old).groupBy("idx").agg(
        *[F.expr(f"sum(t{c}) AS t{c}") for c in range(n)], *[F.expr(f"sum(p{q}) AS p{q}") for q in range(rank)],
        F.expr("max(has_cells) AS has_cells"))
    pinv = core_pinv(core, mode)
    names = [f"t{c}" for c in range(n)]
    out = [f"CASE WHEN has_cells = 1 THEN {num(mu)} * coalesce(p{q}, 0.0D) + {num(1.0 - mu)} * "
           f"({lin_expr(pinv[:, q], names)}) ELSE p{q} END AS c{q}" for q in range(rank)]
    return g.selectExpr("idx", *out)
