"""The whole job: start model for the old part, then one incremental update.

The pre tensor only supplies its dims (the old model is a start model, not
a decomposition of it); factors start from the deterministic formula (or
random values), scaled and orthonormalised; the core starts from the
formula."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_CUT_NUM, DEFAULT_MU, DEFAULT_RANKS, FACTOR_MOD
from ..functions.index import MODES
from ..operators import factors as fo
from ..operators.core import start_core_array
from ..operators.tensor import tensor_stats
from ..sources.model import write_model
from .update import UpdateResult, incremental_update


def start_model(spark: SparkSession, pre_dims, ranks, kind: str = "formula", seed: int | None = None):
    """Orthonormal start blocks ``{mode: DataFrame}``, their Grams, start core."""
    raw = {}
    for m in MODES:
        f = fo.init_factor(spark, m, 1, int(pre_dims[m]), int(ranks[m]), kind=kind, seed=seed)
        if kind == "formula":
            f = f.select("idx", *[(F.col(c) / F.lit(float(FACTOR_MOD))).alias(c) for c in fo.cols(ranks[m])])
        raw[m] = f
    start_grams = fo.grams_by_mode(raw, ranks)  # one job for all modes
    blocks, grams = {}, {}
    for m in MODES:
        q, _, g_q, _ = fo.orthonormalize(raw[m], int(ranks[m]), gram_in=start_grams[m])
        blocks[m], grams[m] = q, g_q
    if kind == "formula":
        core = start_core_array(ranks)
    else:
        core = np.random.default_rng(seed).random(tuple(int(r) for r in ranks))
    return blocks, grams, core


def tucker_job(spark: SparkSession, increment: DataFrame, pre: DataFrame | tuple, ranks=DEFAULT_RANKS,
               mu: float = DEFAULT_MU, cut_num: int = DEFAULT_CUT_NUM, partition: str = "bucket",
               core_schedule: str = "once", start: str = "formula", seed: int | None = None,
               output: str | None = None) -> UpdateResult:
    """``pre``: the pre tensor (only its dims are read) or the dims tuple."""
    pre_dims = tuple(int(x) for x in (pre if isinstance(pre, tuple) else tensor_stats(pre).dims))
    blocks, grams, core = start_model(spark, pre_dims, ranks, kind=start, seed=seed)
    result = incremental_update(increment, blocks, core, pre_dims, ranks=ranks, mu=mu, cut_num=cut_num,
                                partition=partition, core_schedule=core_schedule, gram_old=grams)
    if output:
        write_model(result.factors, result.core, result.metrics, output)
    return result
