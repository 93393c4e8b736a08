"""Every query of the engine against its DuckDB oracle (sf0.001, the same
comparison the driver makes at sf0.01); rows-only ones must run."""

import pytest

import __spark_entry__ as se
from conftest import SF0001
from tools_path import compare  # noqa: F401
from tridelta.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF0001, sorted(QUERIES))


def test_every_oracle_matches(results):
    bad = {n: r for n, r in results.items() if r["match"] is False}
    assert not bad


def test_registry_covers_oracles(results):
    assert set(se.oracle_sql()) <= set(se.queries()) and set(results) == set(QUERIES)
    assert all(r["rows"] >= 0 for r in results.values())


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.columns == ["mode", "idx", "c0", "c1"]
    assert df.count() > 0
