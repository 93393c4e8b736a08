"""Hand-traced goldens (FIXTURES.md section 4)."""

from pyspark.sql import functions as F

from tridelta.functions.index import local_index
from tridelta.operators import core as co
from tridelta.operators import factors as fo
from tridelta.operators import kernel as ke
from tridelta.operators import partition as po


def _hist(spark, arr, region="100", mode=0):
    rows = [(region, mode, s, n) for s, n in enumerate(arr) if n > 0]
    return spark.createDataFrame(rows, "region string, mode int, slice long, nnz long")


def _labels(df):
    return {r["slice"]: r["part_id"] for r in df.collect()}


def test_greedy_goldens(spark):
    h = _hist(spark, [0, 3, 1, 4, 2, 2])
    assert _labels(po.greedy_map(h, 3, {0: 5})) == {1: 1, 2: 1, 3: 2, 4: 3, 5: 3}
    h = _hist(spark, [0, 3, 2, 5, 2])
    assert _labels(po.greedy_map(h, 3, {0: 4})) == {1: 1, 2: 1, 3: 2, 4: 3}
    h = _hist(spark, [0, 3, 0, 0, 0, 0, 3])
    assert _labels(po.greedy_map(h, 4, {0: 6})) == {1: 2, 6: 4}


def test_bucket_golden(spark):
    h = _hist(spark, [0, 3, 2, 5, 2])
    labels = _labels(po.bucket_map(h, 3, 4))
    assert labels == {3: 1, 1: 2, 2: 3, 4: 3}
    loads = {r["part_id"]: r["load"] for r in po.bucket_loads(po.bucket_runs(h, 3)).collect()}
    assert loads == {1: 5, 2: 3, 3: 4}


def test_partition_cv_goldens(spark):
    def cv(loads):
        df = spark.createDataFrame([("100", 0, b + 1, x) for b, x in enumerate(loads)],
                                   "region string, mode int, part_id int, load long")
        return po.partition_cv(df).collect()[0]
    r = cv([5, 5, 2])
    assert abs(r["cv"] - 0.35355339) < 1e-8
    r = cv([4, 4, 3])
    assert r["cv"] == 0.0 and abs(r["cv_exact"] - 0.12856487) < 1e-8
    empty = spark.createDataFrame([], "region string, mode int, part_id int, load long")
    assert po.partition_cv_mean(po.partition_cv(empty)).collect()[0]["groups"] == 0


def test_local_index_golden(spark):
    df = spark.createDataFrame([(x,) for x in (1, 4, 5, 7)], "x long")
    assert [r[0] for r in df.select(local_index(F.col("x"), 4)).collect()] == [0, 3, 0, 2]


def test_matricize_golden(spark):
    ranks = (2, 3, 4)
    core = spark.createDataFrame([(2, 3, 4, 1.0)], "p int, q int, r int, g double")
    got = [co.matricize(core, m, ranks).collect()[0] for m in range(3)]
    assert [(r["row"], r["col"]) for r in got] == [(1, 11), (2, 7), (3, 5)]  # 0-based


def test_blend_golden(spark):
    prev = spark.createDataFrame([(1, 1.0), (2, 1.0)], "idx long, c0 double")
    cur = spark.createDataFrame([(1, 2.0)], "idx long, c0 double")
    out = {r["idx"]: r["c0"] for r in fo.blend_factor(prev, cur, 1, 0.8).collect()}
    assert abs(out[1] - 1.2) < 1e-12 and out[2] == 1.0


def test_kron_rows_golden(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "idx long, c0 double")
    b = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "idx long, c0 double")
    pairs = spark.createDataFrame([(x, y) for x in (1, 2) for y in (1, 2, 3)], "xa long, xb long")
    ids = sorted(r["id"] for r in ke.kron_rows(pairs, a, 1, 10, 2, b, 1, 10, 3).collect())
    assert ids == [3 * a_ + b_ for a_ in range(2) for b_ in range(3)]


def test_ttm_chain_golden(spark):
    cells = spark.createDataFrame([(1, 1, 1, 2.0), (1, 2, 1, 3.0)], "i long, j long, k long, val double")
    a = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "idx long, c0 double, c1 double")
    b = spark.createDataFrame([(1, 5.0, 7.0)], "idx long, c0 double, c1 double")
    for layout in ("wide", "staged"):
        row = ke.ttm_chain(cells, 0, a, 2, 2, b, 2, 1, layout=layout).collect()[0]
        assert [row[f"t{c}"] for c in range(4)] == [55.0, 80.0, 77.0, 112.0]
