"""Increments arriving as a stream: every micro-batch of new cells runs one
incremental update against the latest stored model version.

The model lives in folders ``<model_dir>/v=<batch_id>`` (factors by mode, core,
metrics), each finished once its manifest is published (``sources.model``). A
batch starts from the newest finished version before its own and never reads what
it writes. If it is run again, a finished version is left as it is and an
unfinished one is written anew, so every batch counts once. One model folder belongs to one
stream checkpoint. Tables stored during an update are deleted with the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_CUT_NUM, DEFAULT_MU, DEFAULT_RANKS
from ..plans.job import start_model
from ..plans.update import incremental_update
from ..sources import model as mo


def _versions(spark: SparkSession, model_dir: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(model_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(path)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and mo.versions(spark, f"{model_dir}/{n}"))


def latest_model(spark: SparkSession, model_dir: str, before: int | None = None):
    """(factors, core, dims, version) of the newest finished version (below
    ``before``), or None."""
    vs = [v for v in _versions(spark, model_dir) if before is None or v < before]
    if not vs:
        return None
    base = f"{model_dir}/v={vs[-1]}"
    info = mo.manifest(spark, base).info
    return *mo.read_model(spark, base), tuple(info["dims"]), vs[-1]


def batch_updater(model_dir: str, start_dims, ranks=DEFAULT_RANKS, mu: float = DEFAULT_MU,
                  cut_num: int = DEFAULT_CUT_NUM, partition: str | None = "bucket"):
    """A ``foreachBatch`` function. ``start_dims``: dims of the data the
    start model stands for (the pre tensor)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cells = batch.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("k").cast("long"),
                             F.col("val").cast("double"))
        if int(batch_id) in _versions(spark, model_dir):
            return
        prev = latest_model(spark, model_dir, before=int(batch_id))
        if prev is None:
            blocks, grams, core = start_model(spark, tuple(start_dims), ranks)
            pre = tuple(int(d) for d in start_dims)
            res = incremental_update(cells, blocks, core, pre, ranks, mu=mu, cut_num=cut_num,
                                     partition=partition, gram_old=grams)
        else:
            factors, core, pre, _ = prev
            res = incremental_update(cells, factors, core, pre, ranks, mu=mu, cut_num=cut_num,
                                     partition=partition)
        out = f"{model_dir}/v={int(batch_id)}"
        try:
            mo.write_model(res.factors, res.core, res.metrics, out, {"dims": list(res.info["dims"]), "batch_id": int(batch_id)})
        finally:
            res.release(results=True)

    return run


def start_stream(cells_stream: DataFrame, model_dir: str, checkpoint: str, start_dims, **kwargs):
    """Run the updater on a streaming DataFrame of cells ``(i, j, k, val)``."""
    return (cells_stream.writeStream.foreachBatch(batch_updater(model_dir, start_dims, **kwargs))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
