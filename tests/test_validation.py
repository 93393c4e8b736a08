"""Input checks, sources and sinks."""

import pytest

from conftest import SF0001
from tridelta.operators import tensor as te
from tridelta.plans.job import start_model, tucker_job
from tridelta.plans.update import incremental_update
from tridelta.session import scratch_path
from tridelta.sources.coo import read_coo, write_coo
from tridelta.sources.model import read_metrics, read_model
from tridelta.sources.tables import sales_tensor


def test_read_coo_round_trip_and_failfast(spark, tmp_path):
    cells = sales_tensor(spark, SF0001)
    path = scratch_path(spark, "coo-test")
    write_coo(cells, path)
    back = read_coo(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    assert te.cell_count(back).head()[0] == cells.count() and te.mode_dims(back).head() == te.mode_dims(cells).head()
    bad = tmp_path / "bad.csv"
    bad.write_text("1,2,3,4.0\n1,x,3,4.0\n")
    short = tmp_path / "short.csv"
    short.write_text("1,2,3,4.0\n3,2\n")
    for path in (bad, short):  # whatever columns are needed
        for use in (lambda df: df.collect(), lambda df: te.mode_dims(df).collect(), lambda df: te.cell_count(df).collect()):
            with pytest.raises(Exception):
                use(read_coo(spark, str(path)))
    doubles = tmp_path / "d.csv"
    doubles.write_text("1.0,2.9,3.0,4.5\n")
    assert tuple(read_coo(spark, str(doubles)).collect()[0]) == (1, 2, 3, 4.5)


def test_indices_below_one_fail(spark):
    cells = spark.createDataFrame([(0, 1, 1, 1.0)], "i long, j long, k long, val double")
    with pytest.raises(ValueError):
        te.tensor_stats(cells)


def test_parameter_checks(spark):
    cells = spark.createDataFrame([(2, 2, 2, 1.0)], "i long, j long, k long, val double")
    blocks, grams, core = start_model(spark, (1, 1, 1), (1, 1, 1))
    for kwargs in ({"mu": 0.0}, {"mu": 1.5}, {"cut_num": 0}, {"partition": "x"}, {"core_schedule": "x"}):
        with pytest.raises(ValueError):
            incremental_update(cells, blocks, core, (1, 1, 1), (1, 1, 1), **kwargs)


def test_job_writes_model(spark):
    cells = sales_tensor(spark, SF0001)
    dims = te.tensor_stats(cells).dims
    pre = tuple(d * 4 // 5 for d in dims)
    out = scratch_path(spark, "model-test")
    res = tucker_job(spark, cells, pre, ranks=(2, 2, 2), partition="greedy", output=out)
    factors, core = read_model(spark, out)
    assert core.count() == 8
    assert factors.count() == res.factors.count()
    names = {r["name"] for r in read_metrics(spark, out).collect()}
    assert {"partition_cv", "partition_seconds", "total_seconds", "cells"} <= names


def test_release_deletes_only_this_runs_tables(spark):
    from tridelta.session import stash

    cells = sales_tensor(spark, SF0001)
    dims = te.tensor_stats(cells).dims
    pre = tuple(d * 4 // 5 for d in dims)
    keep = stash(cells, "keep-me")
    blocks, grams, core = start_model(spark, pre, (2, 2, 2))
    res = incremental_update(cells, blocks, core, pre, (2, 2, 2), gram_old=grams)
    other = incremental_update(cells, blocks, core, pre, (2, 2, 2), gram_old=grams, partition="greedy")
    paths, kept = list(res.scratch), list(res.kept)
    assert paths and len(kept) == 2
    assert not {*paths, *kept} & {*other.scratch, *other.kept}
    n = res.factors.count()
    assert res.release() == len(set(paths)) and res.scratch == []
    # the results and the other run are intact
    assert res.factors.count() == n and res.part_map.count() > 0
    assert other.labelled_cells.count() > 0 and other.factors.count() == n
    assert res.release(results=True) == 2
    assert other.factors.count() == n
    assert keep.count() == cells.count()


def test_failed_update_leaves_no_tables(spark):
    from tridelta.session import owned_tables, stash

    seen = []
    with pytest.raises(RuntimeError):
        with owned_tables(spark) as paths:
            stash(spark.range(3), "doomed")
            seen += paths
            raise RuntimeError("stop")
    assert len(seen) == 1
    with pytest.raises(Exception):
        spark.read.parquet(seen[0]).count()


def test_partition_stage_labels_every_cell(spark):
    cells = sales_tensor(spark, SF0001)
    pre = tuple(d * 4 // 5 for d in te.tensor_stats(cells).dims)
    blocks, grams, core = start_model(spark, pre, (2, 2, 2))
    for method in ("bucket", "greedy"):
        res = incremental_update(cells, blocks, core, pre, (2, 2, 2), gram_old=grams, partition=method, cut_num=5)
        want = te.region_mode_slices(te.cut_regions(cells, pre)).count()
        labelled = res.labelled_cells
        assert labelled.count() == want and labelled.where("part_id < 1 OR part_id > 5 OR part_id IS NULL").count() == 0


def test_cli_on_coordinate_files(spark, capsys):
    from tridelta.plans.cli import main

    cells = sales_tensor(spark, SF0001)
    dims = te.tensor_stats(cells).dims
    pre_cells = cells.where(f"i <= {dims[0] * 4 // 5} AND j <= {dims[1] * 4 // 5} AND k <= {dims[2] * 4 // 5}")
    pre_path, inc_path = scratch_path(spark, "cli-pre"), scratch_path(spark, "cli-inc")
    write_coo(pre_cells, pre_path)
    write_coo(cells, inc_path)
    out = main(["--pre", pre_path, "--increment", inc_path, "--ranks", "2,2,2", "--partition", "greedy",
                "--output", scratch_path(spark, "cli-model")], spark=spark)
    assert out["partition_cv"] >= 0 and out["update_seconds"] > 0
    assert "partition CV:" in capsys.readouterr().out
