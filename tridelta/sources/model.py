"""Model sink and source: factor tables partitioned by mode, the core, the
metrics, published in one step.

``write_model`` writes its tables into a folder of their own below the model's
path and then a manifest that names it: first under another name, then renamed to
``manifest-<version>.json``. Readers take the newest manifest, so a run that stops
anywhere leaves the version before it readable, and nobody sees half a model. A
rename never replaces a file: of two writers of one version one fails. Folders of
older versions stay for their readers until ``drop_versions``."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import delete_paths

MANIFEST = re.compile(r"manifest-(\d{9})\.json")


@dataclass
class Manifest:
    version: int
    tables: dict          # name -> path
    info: dict            # what the writer noted


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions of the model at ``path``, oldest first."""
    _, at, fs = _file_system(spark, path)
    if not fs.exists(at):
        return []
    found = (MANIFEST.fullmatch(s.getPath().getName()) for s in fs.listStatus(at))
    return sorted(int(m.group(1)) for m in found if m)


def _publish(spark: SparkSession, path: str, version: int, content: dict) -> None:
    jvm, at, fs = _file_system(spark, path)
    unnamed = jvm.org.apache.hadoop.fs.Path(at, f"unpublished-{uuid.uuid4().hex[:12]}")
    out = fs.create(unnamed, False)
    out.write(json.dumps(content).encode())
    out.close()
    name = jvm.org.apache.hadoop.fs.Path(at, f"manifest-{version:09d}.json")
    if fs.exists(name) or not fs.rename(unnamed, name):
        fs.delete(unnamed, False)
        raise RuntimeError(f"version {version} of {path} is there already")


def write_model(factors: DataFrame, core: DataFrame, metrics: DataFrame | None, path: str, info: dict | None = None) -> int:
    """Write and publish; returns the version."""
    spark = factors.sparkSession
    base = path.rstrip("/")
    folder = f"tables-{uuid.uuid4().hex[:12]}"
    tables = {"factors": factors, "core": core} | ({"metrics": metrics} if metrics is not None else {})
    try:
        for name, df in tables.items():
            writer = df.write.partitionBy("mode") if name == "factors" else df.write
            writer.parquet(f"{base}/{folder}/{name}")
        version = max(versions(spark, base), default=-1) + 1
        _publish(spark, base, version, {"folder": folder, "tables": sorted(tables), "info": info or {}})
    except BaseException:
        delete_paths(spark, [f"{base}/{folder}"])
        raise
    return version


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The newest manifest (or that of ``version``); None if nothing is published."""
    base = path.rstrip("/")
    if version is None:
        version = max(versions(spark, base), default=None)
    if version is None:
        return None
    content = json.loads(spark.read.text(f"{base}/manifest-{version:09d}.json", wholetext=True).first()["value"])
    return Manifest(version, {t: f"{base}/{content['folder']}/{t}" for t in content["tables"]}, content["info"])


def _read(spark: SparkSession, path: str, table: str, version: int | None) -> DataFrame:
    found = manifest(spark, path, version)
    if found is None or table not in found.tables:
        raise FileNotFoundError(f"no {table} is published at {path}")
    return spark.read.parquet(found.tables[table])


def read_model(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    return _read(spark, path, "factors", version), _read(spark, path, "core", version)


def read_metrics(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return _read(spark, path, "metrics", version)


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete what no manifest names and all but the newest ``keep`` versions;
    for use while nobody writes."""
    if keep < 1:
        raise ValueError("at least one version stays")
    base = path.rstrip("/")
    _, at, fs = _file_system(spark, base)
    kept = {v: manifest(spark, base, v) for v in versions(spark, base)[-keep:]}
    names = {f"manifest-{v:09d}.json" for v in kept} | {m.tables["core"].split("/")[-2] for m in kept.values()}
    listed = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    old = [n for n in listed if n not in names and (MANIFEST.fullmatch(n) or n.startswith(("tables-", "unpublished-")))]
    # manifests first: no reader may resolve to a folder that is going
    return delete_paths(spark, [f"{base}/{n}" for n in sorted(old, key=lambda n: not MANIFEST.fullmatch(n))])
