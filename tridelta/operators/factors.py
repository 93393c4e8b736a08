"""Factor-table operators. A factor block is a DataFrame ``(idx, c0..c{r-1})``
with global 1-based ``idx``; rows that are absent are zero rows, so a block
touched by few cells stays small. The combined model table adds ``mode``.

Only r x r Gram matrices are collected; rows never reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import factor_value
from ..functions.linalg import mgs_of_triangle, mgs_transform, unit_columns
from ..session import DEFAULT_BROADCAST_LIMIT, broadcast_if_small, broadcast_limit, factor_row_bytes, stash


BITMAP_BITS = 32768  # of one bitmap of Spark's bitmap functions


def cols(rank: int, prefix: str = "c") -> list[str]:
    return [f"{prefix}{q}" for q in range(rank)]


def init_factor(spark: SparkSession, mode: int, first: int, last: int, rank: int,
                kind: str = "formula", seed: int | None = None) -> DataFrame:
    """Rows ``first..last`` of a start factor: the deterministic integer
    formula (same in any partitioning) or uniform random values."""
    idx = F.col("id")
    if kind == "formula":
        values = [factor_value(idx, q, mode).alias(f"c{q}") for q in range(rank)]
    elif kind == "random":
        base = 0 if seed is None else int(seed)
        values = [F.rand(base + 7 * mode + q).alias(f"c{q}") for q in range(rank)]
    else:
        raise ValueError(f"unknown start kind {kind!r}")
    return spark.range(int(first), int(last) + 1).select(idx.alias("idx"), *values)


def num(x: float) -> str:
    """A double literal for SQL text (exact round trip)."""
    x = float(x)
    if not np.isfinite(x):
        raise ValueError(f"non-finite coefficient {x}")
    return f"({repr(x)}D)"


def lin_expr(coefs, names) -> str:
    """``sum_i coefs[i] * names[i]`` as SQL text (zero terms left out)."""
    terms = [f"{n} * {num(c)}" for c, n in zip(coefs, names) if float(c) != 0.0]
    return " + ".join(terms) if terms else "CAST(0.0 AS DOUBLE)"


def rename_cols(block: DataFrame, rank: int, key: str, prefix: str) -> DataFrame:
    return block.selectExpr(f"idx AS {key}", *[f"c{q} AS {prefix}{q}" for q in range(rank)])


def fits_broadcast(block: DataFrame, rank: int, max_rows: int) -> bool:
    return max_rows * factor_row_bytes(rank) <= broadcast_limit(block.sparkSession, DEFAULT_BROADCAST_LIMIT)


def factor_lookup(cells: DataFrame, block: DataFrame, coord_col: str, rank: int, prefix: str,
                  max_rows: int, keep_cells: bool = False) -> DataFrame:
    """Attach the factor row of ``coord_col`` to each cell (equi-join).

    A block whose bound (rows x width) is under the limit is broadcast; any
    other is joined by sort and merge, where AQE's skew join splits a hot
    index. Absent rows are zero rows: leaving out their cells is exact for a
    sum, and with ``keep_cells`` they stay, with zeros, for callers that need
    to know which slices have cells."""
    right = rename_cols(block, rank, coord_col, prefix)
    if fits_broadcast(block, rank, max_rows):
        right = F.broadcast(right)
    if not keep_cells:
        return cells.join(right, coord_col, "inner")
    names = cols(rank, prefix)
    joined = cells.join(right, coord_col, "left")
    return joined.select(coord_col, *[c for c in cells.columns if c != coord_col],
                         *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


def filter_factors(factors: DataFrame, index_sets: DataFrame) -> DataFrame:
    """Keep factor rows whose (mode, idx) occurs (left-semi join)."""
    return factors.join(index_sets.select("mode", "idx"), ["mode", "idx"], "left_semi")


def filter_factors_bitmap(factors: DataFrame, bitmaps: DataFrame, dims) -> DataFrame:
    """:func:`filter_factors` by the bitmaps of ``line_bitmaps``: a factor row
    meets one bitmap and looks its bit up. The bitmaps take at most one bit an
    index up to ``dims``; by that bound they are broadcast, so the factors are
    scanned without an exchange, or else joined."""
    rows = sum(-(-int(d) // BITMAP_BITS) for d in dims)
    right = broadcast_if_small(bitmaps.select("mode", "bucket", "bits"), rows, BITMAP_BITS // 8 + 16)
    at = "bitmap_bit_position(CAST(idx AS BIGINT))"
    byte = f"CAST(conv(hex(substring(bits, CAST({at} DIV 8 + 1 AS INT), 1)), 16, 10) AS INT)"
    return (factors.withColumn("bucket", F.bitmap_bucket_number(F.col("idx").cast("long")))
            .join(right, ["mode", "bucket"]).where(F.expr(f"shiftright({byte}, CAST({at} % 8 AS INT)) & 1 = 1"))
            .select(*factors.columns))


def gram(a: DataFrame, rank_a: int, b: DataFrame | None = None, rank_b: int | None = None) -> np.ndarray:
    """``A^T A`` or ``A^T B`` (joined on idx) as a small NumPy matrix."""
    if b is None:
        exprs = [F.expr(f"sum(c{p} * c{q}) AS g{p}_{q}") for p in range(rank_a) for q in range(p, rank_a)]
        row = a.agg(*exprs).collect()[0]
        g = np.zeros((rank_a, rank_a))
        for p in range(rank_a):
            for q in range(p, rank_a):
                g[p, q] = g[q, p] = float(row[f"g{p}_{q}"] or 0.0)
        return g
    rank_b = rank_b if rank_b is not None else rank_a
    joined = rename_cols(a, rank_a, "idx", "a").join(rename_cols(b, rank_b, "idx", "b"), "idx")
    row = joined.agg(*[F.expr(f"sum(a{p} * b{q}) AS g{p}_{q}")
                       for p in range(rank_a) for q in range(rank_b)]).collect()[0]
    return np.array([[float(row[f"g{p}_{q}"] or 0.0) for q in range(rank_b)] for p in range(rank_a)])


def _gram_sums(rank: int, when: str | None = None) -> list:
    """SQL text of the upper-triangle products (optionally under a condition)."""
    out = []
    for p in range(rank):
        for q in range(p, rank):
            term = f"c{p} * c{q}"
            out.append(term if when is None else f"CASE WHEN {when} THEN {term} END")
    return out


def _gram_from_row(row: dict, rank: int, prefix: str) -> np.ndarray:
    g = np.zeros((rank, rank))
    n = 0
    for p in range(rank):
        for q in range(p, rank):
            g[p, q] = g[q, p] = float(row.get(f"{prefix}{n}") or 0.0)
            n += 1
    return g


def grams_by_mode(blocks: dict, ranks) -> dict:
    """Gram of several blocks ``{mode: DataFrame}`` in one aggregation."""
    rmax = max(int(ranks[m]) for m in blocks)
    union = None
    for m, df in sorted(blocks.items()):
        sel = df.selectExpr(f"{int(m)} AS mode",
                            *[(f"c{q}" if q < ranks[m] else f"CAST(0.0 AS DOUBLE) AS c{q}") for q in range(rmax)])
        union = sel if union is None else union.unionByName(sel)
    aggs = []
    for m in sorted(blocks):
        for n, term in enumerate(_gram_sums(int(ranks[m]), f"mode = {int(m)}")):
            aggs.append(F.expr(f"sum({term}) AS m{m}_{n}"))
    row = union.agg(*aggs).collect()[0].asDict()
    return {m: _gram_from_row({k[len(f"m{m}_"):]: v for k, v in row.items() if k.startswith(f"m{m}_")}, int(ranks[m]), "")
            for m in blocks}


def stash_with_grams(df: DataFrame, name: str, ranks: dict, partition_by: list[str] | None = None) -> tuple:
    """Store ``df`` (lineage cut) and get the Gram of its rows in the same
    job, via observed metrics of the write. ``ranks``: {mode: rank}; with
    more than one mode, ``df`` carries a ``mode`` column."""
    from pyspark.sql import Observation

    obs = Observation(f"gram-{name}")
    aggs = [F.expr("count(1) AS rows")]
    for m, r in sorted(ranks.items()):
        when = f"mode = {int(m)}" if len(ranks) > 1 else None
        aggs += [F.expr(f"sum({t}) AS m{m}_{n}") for n, t in enumerate(_gram_sums(int(r), when))]
    stored = stash(df.observe(obs, *aggs), name, partition_by=partition_by)
    row = obs.get
    grams = {m: _gram_from_row({k[len(f"m{m}_"):]: v for k, v in row.items() if k.startswith(f"m{m}_")}, int(r), "")
             for m, r in ranks.items()}
    return stored, grams, int(row.get("rows") or 0)


def gram_frame(a: DataFrame, rank_a: int, b: DataFrame | None = None, rank_b: int | None = None) -> DataFrame:
    """Gram as a long table ``(p, q, g)`` (0-based), for SQL comparison."""
    if b is None:
        b, rank_b = a, rank_a
    joined = rename_cols(a, rank_a, "idx", "a").join(rename_cols(b, rank_b, "idx", "b"), "idx")
    sums = joined.agg(*[F.sum(F.col(f"a{p}") * F.col(f"b{q}")).alias(f"g{p}_{q}")
                        for p in range(rank_a) for q in range(rank_b)])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.col(f"g{p}_{q}").alias("g"))
        for p in range(rank_a) for q in range(rank_b)
    ])))


def project(block: DataFrame, rank_in: int, mat: np.ndarray, extra: list[str] | None = None) -> DataFrame:
    """Right-multiply rows by a small constant matrix (literals, codegen)."""
    names = [f"c{p}" for p in range(rank_in)]
    outs = [f"{lin_expr(mat[:, q], names)} AS c{q}" for q in range(mat.shape[1])]
    return block.selectExpr(*(extra or []), "idx", *outs)


def needs_second_pass(g: np.ndarray, cond_limit: float = 1e4) -> bool:
    """CholeskyQR loses orthogonality like cond(A)^2 = cond(G): re-run the
    pass from the computed Q's real Gram when G, of the columns at unit norm,
    is ill-conditioned."""
    if g.size == 0:
        return False
    ev = np.linalg.eigvalsh(unit_columns(g)[0])
    return bool(ev.min() <= 0 or ev.max() / max(ev.min(), 1e-300) > cond_limit)


# R factors that one task of the tree puts together.
FAN_IN = 64


def _triangles(df: DataFrame, rank: int, per_row: bool) -> DataFrame:
    """``(part, r)``: one R factor (flattened) for the rows of each partition,
    taken in batch by batch. Rows are table rows, or R factors themselves."""
    def run(batches):
        import numpy
        import pyarrow
        from pyspark import TaskContext

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            if per_row:
                rows = numpy.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            else:
                rows = numpy.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(-1, rank)
            stacked = rows if held is None else numpy.vstack([held, rows])
            if not numpy.isfinite(stacked).all():
                raise ValueError("a factor table has non-finite values")
            if len(stacked) < rank:
                stacked = numpy.vstack([stacked, numpy.zeros((rank - len(stacked), rank))])
            held = numpy.linalg.qr(stacked, mode="r")
        if held is not None:
            yield pyarrow.RecordBatch.from_arrays(
                [pyarrow.array([TaskContext.get().partitionId()], pyarrow.int64()),
                 pyarrow.array([held.reshape(-1)], pyarrow.list_(pyarrow.float64()))], ["part", "r"])

    return df.mapInArrow(run, "part long, r array<double>")


def r_factor(block: DataFrame, rank: int) -> np.ndarray:
    """R of the table's QR factorisation (up to signs of its rows): a QR per
    partition, then a tree in which every task puts FAN_IN R factors together.
    No more than FAN_IN small triangles reach the driver."""
    level = _triangles(block.select(*cols(rank)), rank, True)
    stored = stash(level, "r-factors")
    left = stored.count()
    while left > FAN_IN:
        # each round leaves at most a FAN_IN-th of them (and one), whatever the numbers' gaps
        merged = stored.repartition(-(-left // FAN_IN)).select("r")
        stored = stash(_triangles(merged, rank, False), "r-factors")
        left = stored.count()
    rows = [r["r"] for r in stored.select("r").collect()]
    if not rows:
        return np.zeros((rank, rank))
    stacked = np.array(rows).reshape(-1, rank)
    return np.linalg.qr(stacked, mode="r")


def orthonormalize(block: DataFrame, rank: int, cond_limit: float = 1e4,
                   gram_in: np.ndarray | None = None):
    """Orthonormal columns with positive diagonal (same Q as modified
    Gram-Schmidt). While the Gram matrix of the columns at unit norm is well
    conditioned, everything follows from it: r x r work on the driver and a
    projection. Else the columns' products no longer tell small remainders from
    rounding, and the R factor of the table itself is taken (:func:`r_factor`),
    whose condition number is not squared; its Q goes through a second pass, so
    that it is orthonormal to rounding. Dependent columns become zero.

    Returns ``(Q, T, gram_of_Q, deficient)`` with ``Q = A @ T``."""
    g = gram(block, rank) if gram_in is None else gram_in
    if not needs_second_pass(g, cond_limit):
        t, deficient = mgs_transform(g)
        return project(block, rank, t), t, t.T @ g @ t, deficient
    t, deficient = mgs_of_triangle(r_factor(block, rank))
    first = project(block, rank, t)
    r = r_factor(first, rank)
    t2, _ = mgs_of_triangle(r)
    g_q = t2.T @ (r.T @ r) @ t2
    # projected twice: the second transform belongs to the columns as they came out of the first
    return project(first, rank, t2), t @ t2, g_q, deficient


def blend_factor(prev: DataFrame, cur: DataFrame, rank: int, mu: float) -> DataFrame:
    """``mu*prev + (1-mu)*cur`` per row; a row without a current value keeps
    its previous one, a row without a previous value counts it as zero."""
    p = rename_cols(prev, rank, "idx", "p")
    c = rename_cols(cur, rank, "idx", "u")
    j = p.join(c, "idx", "full_outer")
    out = [f"CASE WHEN u{q} IS NULL THEN p{q} ELSE {num(mu)} * coalesce(p{q}, 0.0D) + {num(1.0 - mu)} * u{q} END AS c{q}"
           for q in range(rank)]
    return j.selectExpr("idx", *out)


def stack(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def split(block: DataFrame, pre: int) -> tuple[DataFrame, DataFrame]:
    return block.where(F.col("idx") <= F.lit(int(pre))), block.where(F.col("idx") > F.lit(int(pre)))


def vector_sum(df: DataFrame, key: str | list[str], value_cols: list[str]) -> DataFrame:
    """Element-wise sum of row vectors per key (partial + final aggregation)."""
    return df.groupBy(key).agg(*[F.sum(c).alias(c) for c in value_cols])


def to_long(factors: DataFrame, rank: int) -> DataFrame:
    """Wide ``(mode, idx, c0..)`` -> long ``(mode, idx, col, value)``."""
    return factors.unpivot(["mode", "idx"], cols(rank), "col_name", "value").select(
        "mode", "idx", F.regexp_extract("col_name", r"(\d+)$", 1).cast("int").alias("col"), "value"
    )


def to_wide(long: DataFrame, rank: int, dims: dict | None = None) -> DataFrame:
    """Long -> wide; with ``dims`` ({mode: rows}) absent rows become zero
    rows over ``1..rows`` (left join on a generated range)."""
    wide = long.groupBy("mode", "idx").agg(
        *[F.max(F.when(F.col("col") == q, F.col("value"))).alias(f"c{q}") for q in range(rank)]
    )
    if dims is not None:
        spark = long.sparkSession
        frames = [spark.range(1, int(n) + 1).select(F.lit(int(m)).alias("mode"), F.col("id").alias("idx"))
                  for m, n in sorted(dims.items())]
        full = frames[0]
        for f in frames[1:]:
            full = full.unionByName(f)
        wide = full.join(wide, ["mode", "idx"], "left")
    return wide.select("mode", "idx", *[F.coalesce(F.col(f"c{q}"), F.lit(0.0)).alias(f"c{q}") for q in range(rank)])


def combine(blocks: dict, rank_max: int) -> DataFrame:
    """Per-mode blocks -> one table ``(mode, idx, c0..c{rank_max-1})``
    (columns beyond a mode's rank are null)."""
    out = None
    for mode in sorted(blocks):
        df, r = blocks[mode]
        sel = df.select(F.lit(int(mode)).alias("mode"), "idx",
                        *[(F.col(f"c{q}") if q < r else F.lit(None).cast("double")).alias(f"c{q}")
                          for q in range(rank_max)])
        out = sel if out is None else out.unionByName(sel)
    return out
