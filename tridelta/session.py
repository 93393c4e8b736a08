"""Session helpers: recommended settings, the shared checkpoint folder, stashing
intermediate tables there, and size-checked broadcasts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the update job wants; applied only where the session has no value yet.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Upper bound for any table this library broadcasts by hint (bytes); a
# session can set ``spark.tridelta.broadcastLimitBytes`` instead.
DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024
BROADCAST_LIMIT_KEY = "spark.tridelta.broadcastLimitBytes"


def broadcast_limit(spark: SparkSession, default: int | None = None) -> int:
    value = spark.conf.get(BROADCAST_LIMIT_KEY, None)
    return int(value) if value else int(DEFAULT_BROADCAST_LIMIT if default is None else default)


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "tridelta") -> SparkSession:
    """Session for tests and the local bench. Intermediate tables go below the
    working folder's warehouse; on a cluster the deployment names the folder."""
    scratch = os.path.abspath(os.path.join("spark-warehouse", "scratch"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", scratch)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.locality.wait", "0s")
        .config("spark.hadoop.mapreduce.fileoutputcommitter.algorithm.version", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> None:
    for key, value in RECOMMENDED_CONF.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set by the deployment. Only a local-mode session
    without a value gets a folder of the warehouse, never a temporary one.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


# Where the tables stored by the run at hand are noted, if it asked for that.
# A context variable: runs in other threads note theirs elsewhere.
_STORED: ContextVar[list[str] | None] = ContextVar("tridelta_stored", default=None)


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Paths of the tables stored within the block by this thread. They are
    deleted if the block fails; otherwise they are the caller's to release."""
    paths: list[str] = []
    token = _STORED.set(paths)
    try:
        yield paths
    except BaseException:
        delete_paths(spark, paths)
        raise
    finally:
        _STORED.reset(token)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/tridelta/{name}-{uuid.uuid4().hex[:12]}"


BUCKETED = "bucketed-"


def _bucketed_table(path: str) -> str:
    return "tridelta_" + path.rsplit("-", 1)[1]


def delete_paths(spark: SparkSession, paths) -> int:
    """Delete stored tables through the cluster file system (any scheme), and
    what the catalog knows of them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for p in paths:
        if p.rsplit("/", 1)[1].startswith(BUCKETED):
            spark.sql(f"DROP TABLE IF EXISTS {_bucketed_table(p)}")
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            fs.delete(path, True)
            n += 1
    return n


def stash(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str | None = None,
          file_rows: int | None = None) -> DataFrame:
    """Write ``df`` as parquet (compressed by ``codec``, else by the session's)
    under the checkpoint folder and read it back. ``file_rows``: the most rows of a
    file, so that later scans deal a large table over all tasks evenly.

    Cuts the lineage (a lost executor re-reads files instead of replaying
    earlier steps) and gives later scans parquet pushdown and pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    noted = _STORED.get()
    if noted is not None:
        noted.append(path)
    writer = df.write.mode("overwrite")
    if codec:
        writer = writer.option("compression", codec)
    if file_rows:
        writer = writer.option("maxRecordsPerFile", file_rows)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # the written schema: partition values such as region "010" stay strings
    return spark.read.schema(df.schema).parquet(path)


def stash_bucketed(df: DataFrame, name: str, buckets: int, key: str, partition_by: list[str]) -> DataFrame:
    """:func:`stash` with the rows of a folder dealt into ``buckets`` files by the
    hash of ``key``; a scan is then known to be partitioned by ``key``, and
    grouping by it (and more) exchanges nothing. The layout is known through the
    catalog: the table stays in it until :func:`delete_paths` gets its path."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{BUCKETED}{name}")
    noted = _STORED.get()
    if noted is not None:
        noted.append(path)
    table = _bucketed_table(path)
    (df.repartition(buckets, key).write.format("parquet").partitionBy(*partition_by).bucketBy(buckets, key)
     .option("path", path).saveAsTable(table))
    return spark.table(table).select(*df.columns)


def broadcast_if_small(df: DataFrame, max_rows: int, row_bytes: int, limit: int | None = None) -> DataFrame:
    """Hint a broadcast only when a proven row bound keeps the table under
    the limit; otherwise leave the choice to the planner (sort-merge + AQE)."""
    limit = broadcast_limit(df.sparkSession) if limit is None else limit
    if max_rows * row_bytes <= limit:
        return F.broadcast(df)
    return df


def factor_row_bytes(rank: int) -> int:
    return 8 * rank + 24
