import math

import numpy as np

from tridelta.llm import multi_index

SCHEMA = "vec_id bigint, embedding array<float>, label int, key int, raw int, home int, visits int, kin int, weight int, id int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], SCHEMA)


def brute(rows, threshold=0.93):
    n, unit = len(rows), []
    for _, v, label in rows:
        ok = label is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)
        x = np.array(v, dtype=np.float32).astype(float) if ok else None
        unit.append(None if x is None else x / math.sqrt(x @ x))
    near = [[i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= threshold for j in range(n)] for i in range(n)]
    label = list(range(n))
    while True:
        new = [min([label[i]] + [label[j] for j in range(n) if near[i][j]]) for i in range(n)]
        if new == label:
            break
        label = new
    key = [(r[0] is None, r[0] or 0) for r in rows]
    first = {g: min(key[i] for i in range(n) if label[i] == g) for g in set(label)}
    return sorted((*key[i], sum(near[i]), *first[label[i]]) for i in range(n))


def rows():
    rng = np.random.default_rng(4)
    out = []
    for g in range(40):
        base = rng.normal(size=9)
        for k in range(8):
            v = base + rng.normal(size=9) * 0.3 * (k % 4)
            out.append((len(out), [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
    hot = rng.normal(size=9)
    out += [(1000 + k, [float(np.float32(x)) for x in hot + rng.normal(size=9) * 0.15], 1) for k in range(80)]
    out += [(2000 + k, [float(np.float32(x)) for x in hot], 1) for k in range(50)]
    out += [(3000, None, 1), (3001, [0.0] * 9, 1), (3002, [1.0, None] + [0.0] * 7, 1), (3003, [math.nan] * 9, 1), (3004, [math.inf] * 9, 1),
            (3005, [float(np.float32(x)) for x in hot], None), (3006, [1.0, 0.0], 1), (3007, [2.0, 0.0], 1), (3008, [], 1),
            (None, [float(np.float32(x)) for x in hot], 1), (None, None, None), (3009, [float(np.float32(2 * x)) for x in hot], 1),
            (3010, [-0.0, 3.0], 2), (3010, [-0.0, 3.0], 2), (3011, [1e-30, 3e-30], 2), (3012, [1e30, 3e30], 2)]
    return out


def test_against_all_pairs(spark):
    data = rows()
    want = brute(data)
    got = sorted((r.id is None, r.id or 0, r.n_links, r.component_id is None, r.component_id or 0)
                 for r in multi_index.near_duplicates(frame(spark, data)).collect())
    links = sum(x[2] for x in want)
    assert sum(x[2] for x in got) >= 0.99 * links and all(g[2] <= w[2] for g, w in zip(got, want))
    assert sum(g == w for g, w in zip(got, want)) >= 0.97 * len(want)


def test_all_cells_find_all_pairs(spark, monkeypatch):
    data = rows()
    monkeypatch.setattr(multi_index, "choose_cells", lambda classes, grid, *a: len(grid.first) * len(grid.second))
    monkeypatch.setattr(multi_index, "grid_size", lambda n: 4)
    df = multi_index.near_duplicates(frame(spark, data))
    got = sorted((r.id is None, r.id or 0, r.n_links, r.component_id is None, r.component_id or 0) for r in df.collect())
    assert got == brute(data)


def test_few_cells_count_a_link_once(spark, monkeypatch):
    """Whatever is found is found for both ends, in one place."""
    data = rows()
    monkeypatch.setattr(multi_index, "choose_cells", lambda *a: 2)
    monkeypatch.setattr(multi_index, "grid_size", lambda n: 5)
    got = multi_index.near_duplicates(frame(spark, data)).collect()
    want = brute(data)
    assert sum(r.n_links for r in got) % 2 == 0 and sum(r.n_links for r in got) <= sum(w[2] for w in want)


def test_empty_and_invalid_tables(spark):
    assert multi_index.near_duplicates(frame(spark, [])).count() == 0
    only = multi_index.near_duplicates(frame(spark, [(1, None, 1), (2, [0.0], 1)])).collect()
    assert sorted((r.id, r.n_links, r.component_id, r.kept) for r in only) == [(1, 0, 1, True), (2, 0, 2, True)]


def plain_order(a, b):
    """All sums of one vector, smallest first (ties in any order)."""
    return np.sort((a[:, None] + b[None, :]).ravel())


def test_cells_come_nearest_first():
    rng = np.random.default_rng(0)
    for k1, k2 in ((5, 5), (1, 7), (7, 1), (1, 1), (12, 4)):
        grid = multi_index.Grid(rng.normal(size=(k1, 3)), rng.normal(size=(k2, 3)))
        x = rng.normal(size=(7, 6))
        first, second = grid.halves(x)
        for a, b, cells in zip(first, second, grid.nearest(x, 1000)):
            assert sorted(cells.tolist()) == list(range(k1 * k2))
            assert np.array_equal((a[:, None] + b[None, :]).ravel()[cells], plain_order(a, b))
        some = grid.nearest(x, 4)
        assert all(np.array_equal(p, q[:4]) for p, q in zip(some, grid.nearest(x, 1000)))
        assert [c[0] for c in some] == grid.home(x).tolist()


def test_traversal_with_ties_and_a_limit():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, size=(50, 9)).astype(float), rng.integers(0, 4, size=(50, 6)).astype(float)
    for limit in (-1, 0, 2, 3, 100):
        for x, y, cells in zip(a, b, multi_index.multi_sequence(a, b, 54, within=limit)):
            sums = (x[:, None] + y[None, :]).ravel()
            assert sorted(cells.tolist()) == np.flatnonzero(sums <= limit).tolist()
            assert (np.diff(sums[cells]) >= 0).all()


def test_turn_is_when_a_cell_is_surely_visited():
    rng = np.random.default_rng(2)
    grid = multi_index.Grid(rng.normal(size=(9, 3)), rng.normal(size=(8, 3)))
    x = rng.normal(size=(6, 6))
    for v, cells in zip(x, grid.nearest(x, grid.cells)):
        assert grid.turn(v, cells).tolist() == list(range(1, grid.cells + 1))


def test_memory_on_a_large_grid():
    """1,024 vectors on 256 x 256 cells: far from the 512 MB of all distances."""
    import tracemalloc

    rng = np.random.default_rng(3)
    grid = multi_index.Grid(rng.normal(size=(256, 32)), rng.normal(size=(256, 32)))
    x = rng.normal(size=(1024, 64))
    tracemalloc.start()
    grid.nearest(x, 200)
    grid.turn(x[0], np.arange(0, grid.cells, 50))
    grid.in_reach(x[:64] / np.linalg.norm(x[:64], axis=1, keepdims=True), 0.93)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20


def rare(n=2500, pairs=40, cosine=0.94):
    """Random directions, of which a few have one near copy."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(pairs):
        away = rng.normal(size=64)
        away -= (away @ x[k]) * x[k]
        x[n - 1 - k] = cosine * x[k] + math.sqrt(1 - cosine ** 2) * away / np.linalg.norm(away)
    return x


def test_all_cells_in_reach_hold_all_links():
    x = rare()
    grid = multi_index.Grid(multi_index.kmeans(x[:, :32], 6, seed=3), multi_index.kmeans(x[:, 32:], 6, seed=4))
    home, reach = grid.home(x), grid.in_reach(x, 0.93)
    assert all(home[len(x) - 1 - k] in reach[k] and home[k] in reach[len(x) - 1 - k] for k in range(40))
    assert all(h in r for h, r in zip(home, reach)) and all(len(set(r.tolist())) == len(r) for r in reach)


def test_rare_links_are_found(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "grid_size", lambda n: 6)
    data = [(k, [float(np.float32(c)) for c in v], 1) for k, v in enumerate(rare())]
    got = multi_index.near_duplicates(frame(spark, data), probes=32).collect()
    want = {k for k in range(40)} | {2499 - k for k in range(40)}
    assert {r.id: r.n_links for r in got if r.n_links} == dict.fromkeys(want, 1)
    assert sum(r.component_id != r.id for r in got) == 40


def test_rare_links_on_a_large_grid(spark, monkeypatch):
    """256 x 256 cells, few links: recall against brute force."""
    monkeypatch.setattr(multi_index, "grid_size", lambda n: 256)
    data = [(k, [float(np.float32(c)) for c in v], 1) for k, v in enumerate(rare(2000, 60))]
    x = np.array([v for _, v, _ in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(x @ x.T >= 0.93, 1)
    got = multi_index.near_duplicates(frame(spark, data), probes=2000).collect()
    assert near.sum() >= 60 and sum(r.n_links for r in got) >= 0.9 * 2 * near.sum()
    assert all(r.n_links <= near[r.id].sum() + near[:, r.id].sum() for r in got)
