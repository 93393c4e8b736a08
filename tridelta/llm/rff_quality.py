"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A document is described by statistics of its whole text. Standardised, they
pass through random cosines whose inner products approximate a Gaussian
kernel; ridge scores solve the normal equations, which every partition sums
for its own labelled rows and which are then added up matrix row by matrix
row. Scores of labelled rows that the ridge did not see are calibrated by an
isotonic fit over bins of the score.

What reaches the driver does not grow with the data: means, one matrix of
(components + 1) squared, and at most ``BINS`` bins.

Null and empty text: statistics of the empty text, scored like any other.
Null labels are not learnt from; several labels of one document are averaged.
Rows with a null id get a score but no label. Repeated rows score alike. Very long
texts are measured whole. Columns of the input other than id and text do not pass.
Without any labelled row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_texts, store
from .textstats import N_FEATURES, TextStats

BINS = 2048
LOW, HIGH = -0.5, 1.5


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4 (null for a null id)."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make():
        return lambda texts: [[TextStats(t).features() for t in texts]]

    return map_texts(docs, text_col, make, "x array<double>", [id_col]).select(
        F.col("row").getField(id_col).alias("id"), "x")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        cos = np.cos(z @ self.freq + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([cos, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_FEATURES)


def _normal_rows(labelled: DataFrame, model: Model) -> DataFrame:
    """(k, v): row k of each partition's [Z'Z | Z'y]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                z = model.expand(_matrix(b.column(0)))
                y = b.column(1).to_numpy(zero_copy_only=False)
                part = np.hstack([z.T @ z, (z.T @ y)[:, None]])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["k", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

    rows = map_arrow(labelled.select("x", "y"), run, "k int, v array<double>")
    return rows.groupBy("k").applyInPandas(add, "k int, v array<double>")


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; centres and levels of the pools."""
    pools: list[list[float]] = []  # weight, sum of y, sum of x
    for xi, yi, ni in zip(x, y, n):
        pools.append([ni, yi, xi * ni])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w, s, c = pools.pop()
            pools[-1][0] += w
            pools[-1][1] += s
            pools[-1][2] += c
    p = np.array(pools)
    return p[:, 2] / p[:, 0], p[:, 1] / p[:, 0]


def fit(labelled: DataFrame, components: int = 256, gamma: float = 0.05, ridge: float = 1e-3,
        seed: int = 7) -> Model:
    """``labelled``: x, y (0 to 1), calibrate (true: for the isotonic fit)."""
    moments = labelled.select(F.count("*").alias("n"), F.array(*(
        F.avg(F.col("x")[k]) for k in range(N_FEATURES))).alias("mean"), F.array(*(
            F.coalesce(F.stddev_pop(F.col("x")[k]), F.lit(0.0)) for k in range(N_FEATURES))).alias("sd")).head()
    rng = np.random.default_rng(seed)
    freq = rng.normal(scale=np.sqrt(2 * gamma), size=(N_FEATURES, components))
    phase = rng.uniform(0, 2 * np.pi, components)
    n = moments["n"]
    mean = np.array(moments["mean"], dtype=float) if n else np.zeros(N_FEATURES)
    sd = np.array(moments["sd"], dtype=float) if n else np.ones(N_FEATURES)
    model = Model(mean, np.where(sd > 1e-9, sd, 1.0), freq, phase, np.zeros(components + 1))
    rows = {r["k"]: r["v"] for r in _normal_rows(labelled.where("not calibrate"), model).collect()}
    if not rows:
        return model
    total = np.array([rows[k] for k in range(components + 1)])
    a, b = total[:, :-1], total[:, -1]
    seen = a[-1, -1]  # the constant feature counts the rows
    beta = np.linalg.solve(a + ridge * seen / components * np.eye(components + 1), b)
    model = Model(mean, model.scale, freq, phase, beta)
    bin_of = F.floor((F.least(F.greatest(F.col("raw"), F.lit(LOW)), F.lit(HIGH)) - LOW) / (HIGH - LOW) * BINS)
    bins = (apply(labelled.where("calibrate"), model, raw=True).groupBy(bin_of.alias("bin"))
            .agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.avg("raw").alias("x")).orderBy("bin").collect())
    if not bins:
        knots, levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        knots, levels = isotonic(*(np.array([r[c] for r in bins], dtype=float) for c in ("x", "y", "n")))
    return Model(mean, model.scale, freq, phase, beta, knots, levels)


def apply(rows: DataFrame, model: Model, raw: bool = False) -> DataFrame:
    """``rows`` (with x) plus score, or plus the uncalibrated ``raw``."""
    name = "raw" if raw else "score"
    others = [c for c in rows.columns if c != "x"]
    src = rows.select("x", *others)
    kinds = ", ".join(f"`{c}` {t}" for c, t in src.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                value = model.raw(x) if raw else model.score(x)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(value)], [*b.schema.names, name])

    return map_arrow(src, run, f"{kinds}, {name} double")


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out_fold: int = 2,
                    calibration_fold: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out and score of every row of ``docs``; rows of the held-out
    fold are never learnt from."""
    x = store(features(docs, id_col, text_col), "quality-features")
    held = F.coalesce(fold(F.col("id")) == held_out_fold, F.lit(False))
    y = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
         .groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y")))
    labelled = store(x.where(~held).join(y, "id").select("x", "y", (
        fold(F.col("id")) == calibration_fold).alias("calibrate")), "quality-labelled")
    return apply(x, fit(labelled)).select("id", held.alias("held_out"), "score")
