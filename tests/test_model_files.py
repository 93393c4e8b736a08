"""Publication of models: whatever stops a writer, readers see whole versions."""

import os
import subprocess
import sys

import pytest

from conftest import ROOT
from tridelta.session import scratch_path
from tridelta.sources import model as mo


def tables(spark, k):
    factors = spark.createDataFrame([(m, i, float(k)) for m in range(3) for i in range(1, 4)], "mode int, idx long, c0 double")
    core = spark.createDataFrame([(1, 1, 1, float(k))], "p int, q int, r int, g double")
    return factors, core, spark.createDataFrame([("x", None, None, float(k))], "name string, region string, mode int, value double")


def values(spark, path, version=None):
    factors, core = mo.read_model(spark, path, version)
    return {r.c0 for r in factors.collect()} | {r.g for r in core.collect()} | {r.value for r in mo.read_metrics(spark, path, version).collect()}


def test_versions(spark):
    path = scratch_path(spark, "model")
    assert mo.manifest(spark, path) is None and mo.versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        mo.read_model(spark, path)
    assert [mo.write_model(*tables(spark, k), path, {"k": k}) for k in (1, 2, 3)] == [0, 1, 2]
    assert values(spark, path) == {3.0} and values(spark, path, 0) == {1.0}
    assert mo.manifest(spark, path).info == {"k": 3}
    assert mo.drop_versions(spark, path, keep=2) == 2
    assert mo.versions(spark, path) == [1, 2] and values(spark, path) == {3.0} and values(spark, path, 1) == {2.0}


@pytest.mark.parametrize("stop", ["factors", "core", "metrics", "publish"])
def test_a_writer_that_stops_leaves_the_version_before(spark, monkeypatch, stop):
    path = scratch_path(spark, "model")
    mo.write_model(*tables(spark, 1), path)
    frames = list(tables(spark, 2))
    if stop == "publish":
        monkeypatch.setattr(mo, "_publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    else:
        k = ["factors", "core", "metrics"].index(stop)
        name = frames[k].columns[-1]
        frames[k] = frames[k].selectExpr(*frames[k].columns[:-1], f"raise_error('stopped') AS {name}")
    with pytest.raises(Exception):
        mo.write_model(*frames, path)
    assert mo.versions(spark, path) == [0] and values(spark, path) == {1.0}
    monkeypatch.undo()
    # what a killed process leaves: tables and a manifest not yet renamed
    spark.range(3).write.parquet(f"{path}/tables-of-a-killed-writer/core")
    spark.range(1).selectExpr("'{' AS v").write.text(f"{path}/unpublished-x")
    assert values(spark, path) == {1.0}
    assert mo.write_model(*tables(spark, 3), path) == 1 and values(spark, path) == {3.0}
    mo.drop_versions(spark, path)
    left = os.listdir(path.removeprefix("file:"))
    assert sorted(n.split("-")[0] for n in left if not n.startswith(".")) == ["manifest", "tables"]


def test_one_of_two_writers_of_a_version_fails(spark):
    path = scratch_path(spark, "model")
    mo.write_model(*tables(spark, 1), path)
    with pytest.raises(RuntimeError, match="version 0"):
        mo._publish(spark, path, 0, {})
    assert values(spark, path) == {1.0}


def test_entry_without_the_tokenizer_files():
    """Whatever keeps the training-data part from importing, the engine's queries stay."""
    code = ("import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as se; "
            "print(len(se.queries()), len(se.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in se.queries()))")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    from tridelta.plans.catalog import QUERIES

    assert out.stdout.split() == [str(len(QUERIES)), str(len(QUERIES)), "False"], out.stderr
