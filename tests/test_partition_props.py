"""Partitioners against plain-Python statements of their rules."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import greedy_labels, lpt_labels
from tridelta.operators import partition as po


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=60), st.integers(1, 9))
def test_lpt_closed_form_matches_heap(nnz, bins):
    """Run-compressed LPT (driver-free math) == item-by-item heap."""
    arr = [0] + nnz
    want = lpt_labels(arr, bins)
    loads = np.zeros(bins, dtype=np.int64)
    got = {}
    present = sorted({n for n in arr})[::-1]
    for w in present:
        slots = [s for s in range(len(arr)) if arr[s] == w]
        if w == 0:
            continue
        stretches, new_loads = po.lpt_run(loads, w, len(slots))
        bins_of = [b[(k - start) % len(b)] for start, end, b in stretches for k in range(start, end)]
        assert len(bins_of) == len(slots)
        for s, b in zip(slots, bins_of):
            got[s] = int(b) + 1
        loads = new_loads
    for s, b in got.items():
        assert want[s] == b
    final = np.zeros(bins, dtype=np.int64)
    for s, b in want.items():
        final[b - 1] += arr[s]
    assert loads.tolist() == final.tolist()


def _hist(spark, groups):
    rows = [(region, mode, s, n) for (region, mode), arr in groups.items() for s, n in enumerate(arr) if n > 0]
    return spark.createDataFrame(rows, "region string, mode int, slice long, nnz long")


@pytest.mark.parametrize("seed", range(6))
def test_greedy_matches_scan(spark, seed):
    """Distributed reset walk == sequential scan over the densified slots,
    including slices heavier than the threshold and gaps after them."""
    rng = np.random.default_rng(seed)
    groups, dims = {}, {}
    for g, mode in enumerate((0, 1, 2, 0)):
        n = int(rng.integers(5, 80))
        arr = rng.integers(0, 6, size=n) * (rng.random(n) < 0.6)
        arr[rng.integers(1, n, size=2)] = rng.integers(20, 90, size=2)  # heavy slices
        arr[0] = 0
        groups[("100" if g < 3 else "111", mode)] = arr.tolist()
    for (region, mode), arr in groups.items():
        dims[mode] = max(dims.get(mode, 0), len(arr) - 1)
    for (region, mode), arr in groups.items():  # densify every group of a mode to its dim
        groups[(region, mode)] = arr + [0] * (dims[mode] + 1 - len(arr))
    cut = int(rng.integers(2, 13))
    got = po.greedy_map(_hist(spark, groups), cut, dims).collect()
    got = {(r["region"], r["mode"], r["slice"]): r["part_id"] for r in got}
    for (region, mode), arr in groups.items():
        want = greedy_labels(arr, cut)
        for s, n in enumerate(arr):
            if n > 0:
                assert got[(region, mode, s)] == want[s], (region, mode, s)


def test_bucket_map_matches_heap_and_bounds(spark):
    rng = np.random.default_rng(7)
    arr = [0] + rng.integers(0, 30, size=300).tolist()
    h = _hist(spark, {("010", 1): arr})
    got = {r["slice"]: r["part_id"] for r in po.bucket_map(h, 12, len(arr)).collect()}
    want = lpt_labels(arr, 12)
    assert all(want[s] == b for s, b in got.items())
    loads = [r["load"] for r in po.bucket_loads(po.bucket_runs(h, 12)).collect()]
    assert sum(loads) == sum(arr)
    assert max(loads) <= sum(arr) / 12 + max(arr)


def test_greedy_with_many_bins_and_heavy_slices(spark):
    rng = np.random.default_rng(100)
    groups = {}
    for g, n in (("100", 700), ("110", 60), ("111", 5)):
        arr = (rng.integers(0, 8, size=n) * (rng.random(n) < 0.7)).tolist()
        arr[0] = 0
        for at in rng.integers(1, n, size=3):
            arr[int(at)] = int(rng.integers(30, 400))
        groups[(g, 0)] = arr
    for cut in (2, 12, 192):
        got = {(r["region"], r["slice"]): r["part_id"] for r in po.greedy_map(_hist(spark, groups), cut, {0: 699}).collect()}
        for (region, _), arr in groups.items():
            want = greedy_labels(arr + [0] * (700 - len(arr)), cut)
            assert all(got[(region, s)] == want[s] for s, n in enumerate(arr) if n), (region, cut)


def test_greedy_jobs_grow_with_the_logarithm_of_the_bins(spark):
    arr = [0] + [1 + (7 * k) % 5 for k in range(900)]
    hist = _hist(spark, {("100", 0): arr}).cache()
    sc, jobs = spark.sparkContext, {}
    for cut in (12, 192):
        sc.setJobGroup(f"greedy-{cut}", "greedy map")
        po.greedy_map(hist, cut, {0: 900}).write.format("noop").mode("overwrite").save()
        jobs[cut] = len(sc.statusTracker().getJobIdsForGroup(f"greedy-{cut}"))
    sc.setJobGroup("", "")
    assert jobs[192] < 2 * jobs[12] + 10 and jobs[192] <= 80, jobs


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 5000))
def test_stripes_cover_ranks(start, size):
    stripes = po.rank_stripes(start, start + size)
    assert stripes == sorted({s for k in range(start, start + size) for s in po.rank_stripes(k, k + 1)})
    assert len(stripes) <= 64 * 14


def test_stripes_are_the_same_in_sql(spark):
    ranks = [*range(300), *(2 ** k + d for k in range(9, 60) for d in (-2, -1, 0, 1))]
    rows = spark.createDataFrame([(r,) for r in ranks], "rank long").selectExpr("rank", f"{po._rank_stripe('rank')} AS s").collect()
    assert all([r.s] == po.rank_stripes(r["rank"], r["rank"] + 1) for r in rows)


@pytest.mark.parametrize("cut", [1, 7, 1000])
def test_bucket_map_for_any_number_of_bins(spark, cut):
    """Many bins: rows instead of arrays, and no more of them than slices need."""
    rng = np.random.default_rng(cut)
    arr = [0] + np.minimum(rng.zipf(1.4, 3000), 500).tolist()
    h = _hist(spark, {("100", 0): arr, ("011", 2): [0] + [1] * 1500})
    runs = po.bucket_runs(h, cut)
    assert not any("array" in t for _, t in runs.dtypes)
    got = {(r["region"], r["slice"]): r["part_id"] for r in po.bucket_map(h, cut, len(arr), runs=runs).collect()}
    for region, own in (("100", arr), ("011", [0] + [1] * 1500)):
        want = lpt_labels(own, cut)
        assert all(got[region, s] == b for s, b in want.items() if own[s])
    assert runs.where("kind = 'slot'").count() <= 4500
