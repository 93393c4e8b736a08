"""Command line: run the job on coordinate files (or parquet cell tables).

    python -m tridelta.plans.cli --pre PRE --increment INC [--ranks 3,3,3]
        [--cut-num 12] [--partition bucket|greedy] [--mu 0.8] [--output DIR]

Prints the update time, the partition time and the partition CV."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..functions.fixed import DEFAULT_CUT_NUM, DEFAULT_MU
from ..session import configure
from ..sources.coo import read_coo
from .job import tucker_job


def _cells(spark: SparkSession, path: str):
    if path.endswith(".parquet") or path.rstrip("/").endswith("parquet"):
        return spark.read.parquet(path).selectExpr("CAST(i AS BIGINT) AS i", "CAST(j AS BIGINT) AS j",
                                                   "CAST(k AS BIGINT) AS k", "CAST(val AS DOUBLE) AS val")
    return read_coo(spark, path)


def main(argv=None, spark: SparkSession | None = None) -> dict:
    ap = argparse.ArgumentParser(prog="tridelta", description=__doc__.splitlines()[0])
    ap.add_argument("--pre", required=True, help="pre tensor (only its dims are used)")
    ap.add_argument("--increment", required=True, help="increment tensor")
    ap.add_argument("--ranks", default="3,3,3")
    ap.add_argument("--cut-num", type=int, default=DEFAULT_CUT_NUM)
    ap.add_argument("--partition", choices=["bucket", "greedy"], default="bucket")
    ap.add_argument("--mu", type=float, default=DEFAULT_MU)
    ap.add_argument("--core-schedule", choices=["once", "as_published"], default="once")
    ap.add_argument("--output", default=None)
    args = ap.parse_args(argv)
    ranks = tuple(int(x) for x in args.ranks.split(","))
    if len(ranks) != 3 or min(ranks) < 1:
        ap.error("--ranks needs three positive integers")
    spark = spark or SparkSession.builder.appName("tridelta").getOrCreate()
    configure(spark)
    res = tucker_job(spark, _cells(spark, args.increment), _cells(spark, args.pre), ranks=ranks, mu=args.mu,
                     cut_num=args.cut_num, partition=args.partition, core_schedule=args.core_schedule,
                     output=args.output)
    m = {r["name"]: r["value"] for r in res.metrics.where("region IS NULL AND mode IS NULL").collect()}
    out = {"update_seconds": m["total_seconds"], "partition_seconds": m["partition_seconds"],
           "partition_cv": m["partition_cv"]}
    print(f"update time: {out['update_seconds']:.2f}")
    print(f"partition time: {out['partition_seconds']:.2f}")
    print(f"partition CV: {out['partition_cv']:.8f}")
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
