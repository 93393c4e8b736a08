"""Embedding near-duplicates with an inverted multi-index.

Vectors of the same label are linked if their cosine, in double precision, is
at least ``threshold``. Vectors that are null, zero or hold a null or
non-finite component, and those without a label, link with nothing; neither do
vectors of different length.

1. Equal vectors of a label form a class; one vector of each goes on.
2. Two independent codebooks, one for each half of the normalised vectors, are
   fitted by k-means on at most ``sample`` classes (those with the smallest
   hash). Their product is the grid of cells; every class is filed under the
   cell of its nearest codewords.
3. A vector visits cells by a multi-sequence traversal: its distances from the
   words of either half are sorted, and a frontier over the two sorted lists
   yields the cells by the sum of the two, nearest first; the whole grid is
   never written out. How many cells are visited follows from ``probes`` classes that are
   compared with all others by brute force: as many as hold, for the
   average probe, ``recall`` of its true links. Probes are drawn, ``probes``
   at a time and ``ROUNDS`` times at most, until ``LINKED`` of them have links.
   Where links are rarer than that, nothing is estimated: the same traversal runs over
   the distances from the bisecting planes of the codewords, up to what the threshold
   allows. These are all cells that can hold a linked vector, and all links are found.
4. In every cell the visitors are compared with those filed there. Crowded
   cells are cut into blocks of members and of visitors, so a task holds at most
   two blocks of vectors. What leaves is one row per vector and block pair:
   its number of links and its component there - not the pairs.

A pair is found if the one with the smaller key visits the other's cell, so it is
found in one place and counted there for both. Repeated rows are copies of each other; null ids sort after
all others. An empty table gives an empty one. Other columns do not pass and
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tridelta.session import broadcast_if_small

from .common import map_arrow, store
from .graph import components
from .ngram_join import roots

SAMPLE, PROBES, BLOCK = 20_000, 1024, 1024
RECALL = 0.9999
LINKED, ROUNDS = 256, 8
ALL_IN_REACH = 0


def grid_size(n: int) -> int:
    """Codewords per half: a cell holds about 200 of all vectors, up to 256 words."""
    return max(1, min(256, round((n / 200) ** 0.5)))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _distances(x, words).argmin(axis=1)
        count = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words)
    return words


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None, :])


def multi_sequence(first: np.ndarray, second: np.ndarray, cells: int, within: float = np.inf) -> list[np.ndarray]:
    """Cells of each vector by first[i] + second[j], smallest first: ``cells`` of
    them, or fewer where the sum passes ``within``.

    ``first`` and ``second`` hold one row per vector. All vectors of the batch
    step together. The frontier has a place for each row i of a vector's sorted grid,
    which waits at the first column not visited yet and is open once the row
    before it has passed that column. Memory: the frontier (a row of ``first``
    each) and the visits."""
    n, k1 = first.shape
    k2 = second.shape[1]
    by_first, by_second = first.argsort(axis=1, kind="stable"), second.argsort(axis=1, kind="stable")
    a, b = np.take_along_axis(first, by_first, 1), np.take_along_axis(second, by_second, 1)
    column = np.zeros((n, k1), dtype=np.int32)
    front = np.full((n, k1), np.inf)
    front[:, 0] = a[:, 0] + b[:, 0]
    live, steps, taken = np.arange(n), [], np.zeros(n, dtype=np.int64)
    for step in range(min(cells, k1 * k2)):
        at = np.arange(len(live))
        row = front[:, :step + 1].argmin(axis=1)
        go = front[at, row] <= within
        if not go.all():  # what is left of these vectors is beyond the limit
            live, row, column, front, a, b = (x[go] for x in (live, row, column, front, a, b))
            at = np.arange(len(live))
            if not len(live):
                break
        j = column[at, row]
        steps.append((live, (by_first[live, row] * k2 + by_second[live, j]).astype(np.int32)))
        taken[live] += 1
        column[at, row] = j + 1
        onward = (j + 1 < k2) & ((row == 0) | (column[at, np.maximum(row - 1, 0)] > j + 1))
        front[at, row] = np.where(onward, a[at, row] + b[at, np.minimum(j + 1, k2 - 1)], np.inf)
        below = np.flatnonzero((row + 1 < k1) & (column[at, np.minimum(row + 1, k1 - 1)] == j))
        front[below, row[below] + 1] = a[below, row[below] + 1] + b[below, j[below]]
    out = [np.empty(t, dtype=np.int32) for t in taken]
    if not steps:
        return out
    owner, cell = np.concatenate([o for o, _ in steps]), np.concatenate([c for _, c in steps])
    return np.split(cell[owner.argsort(kind="stable")], np.cumsum(taken)[:-1])


class Grid:
    """Two codebooks and the cells they span (numbered first * words + second)."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances (squared) from the words of each half."""
        half = self.first.shape[1]
        return _distances(unit[:, :half], self.first), _distances(unit[:, half:], self.second)

    def home(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.halves(unit)
        return (a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)).astype(np.int32)

    def nearest(self, unit: np.ndarray, cells: int) -> list[np.ndarray]:
        """The ``cells`` nearest cells of each vector, nearest first."""
        return multi_sequence(*self.halves(unit), cells)

    def turn(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Visits after which the traversal of one vector has surely reached each of
        ``cells``: how many cells are no farther, counted on the sorted lists."""
        a, b = (d[0] for d in self.halves(unit[None, :]))
        far = a[cells // len(self.second)] + b[cells % len(self.second)] + 1e-12
        return np.searchsorted(np.sort(b), far[:, None] - a[None, :], side="right").sum(axis=1)

    def in_reach(self, unit: np.ndarray, threshold: float) -> list[np.ndarray]:
        """All cells in which a vector of at least this cosine can be filed, of
        each vector, by their distance from it."""
        bounds = []
        for d, words in zip(self.halves(unit), (self.first, self.second)):
            apart = np.sqrt(_distances(words, words))
            apart = np.where(apart > 1e-9, 2 * apart, np.inf)
            # a vector nearer to word a than to b is beyond the plane between them
            steps = np.stack([((d[:, [w]] - d) / apart[w]).max(axis=1) for w in range(len(words))], axis=1)
            bounds.append(np.maximum(0, steps) ** 2)
        return multi_sequence(*bounds, self.cells, within=2 - 2 * threshold + 1e-9)


def units(raw: list[bytes], width: int) -> np.ndarray:
    """Normalised vectors in double precision, filled up with zeros."""
    out = np.zeros((len(raw), width))
    for k, r in enumerate(raw):
        v = np.frombuffer(r, np.float64)
        out[k, :len(v)] = v / np.sqrt(v @ v)
    return out


def classes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, kin, key, raw) of every row; kin (label and length) and the others
    are null where a vector cannot link."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                kins, keys, raws = [], [], []
                for vector, label in zip(b.column(1), b.column(2).to_pylist()):
                    v = None
                    if label is not None and vector.is_valid and not vector.values.null_count:
                        v = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                        v = v + 0.0  # no negative zero
                        if not len(v) or not np.isfinite(v).all() or not 0 < v @ v < np.inf:
                            v = None
                    kins.append(None if v is None else f"{len(v)}:{label}")
                    raws.append(None if v is None else v.tobytes())
                    keys.append(None if v is None else hashlib.md5(kins[-1].encode() + b"|" + raws[-1]).digest())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(kins, pa.string()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())],
                    ["id", "kin", "key", "raw"])

    rows = vectors.select(F.col(id_col), F.col(vector_col).cast("array<double>"), F.col(label_col).cast("string"))
    return map_arrow(rows, run, f"id {kind}, kin string, key binary, raw binary")


def fit_grid(classes: DataFrame, width: int, n: int, sample: int) -> Grid:
    rows = classes.select("raw", "key").orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    unit = units([bytes(r["raw"]) for r in rows], width)
    half = width // 2
    k = grid_size(n)
    return Grid(kmeans(unit[:, :half], k, seed=3), kmeans(unit[:, half:], k, seed=4))


def choose_cells(classes: DataFrame, grid: Grid, width: int, threshold: float, probes: int, recall: float) -> int:
    """Cells to visit: the probes' links are found by brute force over all
    classes, and the rank of each link's cell is counted. ALL_IN_REACH if too
    few probes have links to tell."""
    linked, reached = 0, {}
    for turn in range(ROUNDS):
        picked = classes.select("kin", "raw", "key").orderBy(F.xxhash64("key", F.lit(1)), "key").limit((turn + 1) * probes).collect()
        mine = picked[turn * probes:]
        if mine:
            for r in _probe_links(classes, grid, width, threshold, mine).collect():  # a row per turn, cells of the grid at most
                reached[r["turn"]] = reached.get(r["turn"], 0.0) + r["share"]
            linked = round(sum(reached.values()))  # the shares of each linked probe come to 1
        if linked >= LINKED or len(mine) < probes:
            break
    if len(mine) == probes and linked < LINKED:  # neither enough links nor all classes
        return ALL_IN_REACH
    if not linked:
        return 1  # every class was a probe and none has a link
    turns = sorted(reached)
    within = np.cumsum([reached[t] for t in turns]) / sum(reached.values())
    return turns[min(int(np.searchsorted(within, recall - 1e-9)), len(turns) - 1)]


def _probe_links(classes: DataFrame, grid: Grid, width: int, threshold: float, picked: list) -> DataFrame:
    """(turn, share): what share of a probe's links is reached at that turn of its
    traversal, summed over the probes that have links."""
    probe = units([bytes(r["raw"]) for r in picked], width)
    kin = np.array([r["kin"] for r in picked])
    place = {bytes(r["key"]): k for k, r in enumerate(picked)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                unit = units(part.column(1).to_pylist(), width)
                home = grid.home(unit)
                near = (probe @ unit.T >= threshold) & (kin[:, None] == np.array(part.column(0).to_pylist())[None, :])
                for j, key in enumerate(part.column(2).to_pylist()):
                    if key in place:
                        near[place[key], j] = False
                for p in np.flatnonzero(near.any(axis=1)):
                    cells, n = np.unique(home[near[p]], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cells), p, np.int32)), pa.array(grid.turn(probe[p], cells).astype(np.int32)), pa.array(n.astype(np.int64))],
                        ["probe", "turn", "n"])

    seen = store(map_arrow(classes.select("kin", "raw", "key"), run, "probe int, turn int, n bigint")
                 .groupBy("probe", "turn").agg(F.sum("n").alias("n")), "index-probes")
    whole = seen.groupBy("probe").agg(F.sum("n").alias("whole"))
    return seen.join(F.broadcast(whole), "probe").groupBy("turn").agg(F.sum(F.col("n") / F.col("whole")).alias("share"))


def filed(classes: DataFrame, grid: Grid, width: int, cells: int, threshold: float) -> DataFrame:
    """classes with home (their cell) and visits (cells, nearest first): as many
    as ``cells``, or all in reach."""
    src = classes.select("kin", "key", "raw", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # visits of a batch: 4 million at most
        step = max(1, min(1024, (4 << 20) // (grid.cells if cells == ALL_IN_REACH else cells)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                unit = units(b.column(2).to_pylist(), width)
                visits = grid.in_reach(unit, threshold) if cells == ALL_IN_REACH else grid.nearest(unit, cells)
                ends = np.cumsum([0, *map(len, visits)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(visits)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(grid.home(unit)), lists], [*b.schema.names, "home", "visits"])

    return map_arrow(src, run, "kin string, key binary, raw binary, weight bigint, home int, visits array<int>")


def verify(rows: DataFrame, width: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """(key, links, root) per vector and block pair in which it has a link."""
    members = rows.groupBy("kin", F.col("home").alias("cell")).agg(F.count("*").alias("n_members"))
    visitors = rows.select("kin", F.explode("visits").alias("cell")).groupBy("kin", "cell").agg(F.count("*").alias("n_visitors"))
    blocks = store(members.join(visitors, ["kin", "cell"]).select(
        "kin", "cell", F.ceil(F.col("n_members") / block).cast("int").alias("m_blocks"),
        F.ceil(F.col("n_visitors") / block).cast("int").alias("v_blocks")), "index-blocks")
    blocks = broadcast_if_small(blocks, blocks.count(), 96)
    here = rows.select("kin", F.col("home").alias("cell"), "key", "raw", "weight", F.lit(0).alias("role"))
    there = rows.select("kin", F.explode("visits").alias("cell"), "key", "raw", "weight", F.lit(1).alias("role"))

    def spread(part: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("key"), F.col(f"{own}_blocks")).cast("int")
        return (part.join(blocks, ["kin", "cell"]).withColumn(f"{own}_block", mine)
                .withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
                .select("kin", "cell", "m_block", "v_block", "role", "key", "raw", "weight"))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        m, v = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        if not len(m) or not len(v):
            return pd.DataFrame({"key": [], "links": [], "root": []})
        near = units(v["raw"].tolist(), width) @ units(m["raw"].tolist(), width).T >= threshold
        v_keys, m_keys = v["key"].tolist(), m["key"].tolist()
        both = {k: r for r, k in enumerate(sorted({*v_keys, *m_keys}))}
        near &= np.array([both[k] for k in v_keys])[:, None] < np.array([both[k] for k in m_keys])[None, :]
        if not near.any():
            return pd.DataFrame({"key": [], "links": [], "root": []})
        for_v = near @ m["weight"].to_numpy()
        for_m = near.T @ v["weight"].to_numpy()
        names = list(both)
        at_v, at_m = np.array([both[k] for k in v_keys]), np.array([both[k] for k in m_keys])
        adjacent = np.zeros((len(names), len(names)), dtype=bool)
        i, j = np.nonzero(near)
        adjacent[at_v[i], at_m[j]] = adjacent[at_m[j], at_v[i]] = True
        links = np.zeros(len(names), dtype=np.int64)
        np.add.at(links, at_v, for_v)
        np.add.at(links, at_m, for_m)
        root = roots(adjacent)
        hit = np.flatnonzero(adjacent.any(axis=1))
        return pd.DataFrame({"key": [names[h] for h in hit], "links": links[hit], "root": [names[root[h]] for h in hit]})

    dealt = spread(here, "m", "v").unionByName(spread(there, "v", "m"))
    return dealt.groupBy("kin", "cell", "m_block", "v_block").applyInPandas(judge, "key binary, links bigint, root binary")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.93, recall: float = RECALL, sample: int = SAMPLE, probes: int = PROBES) -> DataFrame:
    """One row per vector: id, n_links (others linked with it, equal vectors
    included), component_id (smallest id reachable) and kept."""
    rows = store(classes_of(vectors, id_col, vector_col, label_col), "index-rows")
    classes = store(rows.where("key is not null").groupBy("key").agg(
        F.first("kin").alias("kin"), F.first("raw").alias("raw"), F.min("id").alias("rep"), F.count("*").alias("weight")), "index-classes")
    stats = classes.select(F.count("*").alias("n"), F.max(F.length("raw") / 8).alias("width")).head()
    if stats["n"]:
        width = int(stats["width"]) + int(stats["width"]) % 2
        grid = fit_grid(classes, width, stats["n"], sample)
        cells = choose_cells(classes, grid, width, threshold, probes, recall)
        found = store(verify(store(filed(classes, grid, width, cells, threshold), "index-filed"), width, threshold), "index-links")
    else:
        found = classes.select("key", F.col("weight").alias("links"), F.col("key").alias("root"))
    groups = components(found, "key", "root")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    info = store(classes.select("key", "rep", "weight").join(links, "key", "left")
                 .join(groups.select(F.col("id").alias("key"), "component"), "key", "left")
                 .withColumn("component", F.coalesce("component", "key")), "index-info")
    first = store(info.groupBy("component").agg(F.min("rep").alias("component_id")), "index-first")
    info = store(info.join(first, "component").select(
        "key", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "index-result")
    out = rows.select("id", "key").join(info, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
