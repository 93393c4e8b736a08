"""Load balancing of slices over ``cut_num`` partitions, per (region, mode)
group, and the balance metrics.

Both maps work on the slice histogram ``(region, mode, slice, nnz)`` and
never gather a group into one task:

* ``bucket_map`` (longest-processing-time): slices by nnz desc, slice asc,
  each to the least-loaded bin (ties: lowest bin). Slices with equal nnz
  form a *run*; adding a run of equal items to bins is a merge of k
  arithmetic sequences, so a whole run has a closed form. Runs are few —
  distinct nnz values satisfy D(D+1)/2 <= cells, so D <= sqrt(2*cells) —
  and only they are processed in order, streamed through one task per
  (region, mode) that holds the loads of the bins and writes the closed form as
  interval rows. Each slice then gets its bin from its rank in the run by
  two joins, ranks coming from two bounded windows (blocks of ~sqrt(dim) slices).
* ``greedy_map`` (scan in slice order, close a bin near total/cut_num): the
  scan only changes state at *resets*, and there are O(cut_num) of them.
  Prefix sums come from two bounded windows. A reset is a node (its slice,
  and whether that slice opened the new bin or closed the old one) and has one
  successor, found for all possible nodes at once by sorting the values at
  which they pass the threshold among the prefix intervals. The chain of
  resets is then followed by doubling: O(log cut_num) joins of the successor
  table with itself. Labels follow from a running count of earlier resets.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.index import coord
from ..session import broadcast_if_small, stash, stash_bucketed

try:  # ship this module's pandas functions by value: executors need not install the package
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover
    pass

def block_size(max_dim: int) -> int:
    return max(1024, int(math.isqrt(max(int(max_dim), 1))) + 1)


# ---------------------------------------------------------------- bucket (LPT)

def lpt_run(loads: np.ndarray, w: int, m: int) -> tuple[list, np.ndarray]:
    """Closed form for ``m`` items of size ``w`` placed one by one on the
    least-loaded of ``len(loads)`` bins (ties: lowest bin).

    Slot ``n`` of bin ``b`` has load ``(q_b+n)*w + r_b`` with
    ``q, r = divmod(loads, w)``; items take slots in order of
    ``(level q_b+n, r_b, b)``. Returns the stretches ``(start, end, bins)`` that
    the items reach - from one level at which more bins open to the next, bins
    in slot order, taken round by round - and the loads afterwards."""
    q, r = np.divmod(loads, w)
    levels = np.unique(q)
    stretches, start = [], 0
    for n, level in enumerate(levels.tolist()):
        bins = np.flatnonzero(q <= level)
        bins = bins[np.lexsort((bins, r[bins]))]
        end = m if n + 1 == len(levels) else min(m, start + (int(levels[n + 1]) - level) * len(bins))
        stretches.append((start, end, bins))
        if end == m:
            rounds, rest = divmod(m - start, len(bins))
            taken = np.maximum(0, level + rounds - q)
            taken[bins[:rest]] += 1
            return stretches, loads + taken * w
        start = end
    raise ValueError("a run has no items")


# Ranks in a run are dealt into stripes: 64 of them from each power of two to the
# next, so that a run of m items has O(log m) stripes and none holds more than
# a 64th of the ranks before it.
STRIPES = 6


def rank_stripes(start: int, end: int) -> list[int]:
    """The stripes that the ranks ``start`` to ``end - 1`` lie in."""
    out = []
    while start < end:
        octave = (start + 1).bit_length() - 1
        width = 1 << max(octave - STRIPES, 0)
        sub = (start + 1 - (1 << octave)) // width
        out.append((octave << STRIPES) + sub)
        start = (1 << octave) + (sub + 1) * width - 1
    return out


def _rank_stripe(rank: str) -> str:
    """The same as SQL text, for one rank."""
    octave = f"(length(bin({rank} + 1)) - 1)"
    return (f"shiftleft({octave}, {STRIPES}) + ({rank} + 1 - shiftleft(1L, {octave})) div "
            f"shiftleft(1L, greatest({octave} - {STRIPES}, 0))")


RUN_SCHEMA = ("kind string, region string, mode int, nnz long, stripe long, start long, end long, width long, "
              "pos long, part_id int, load long")
RUN_COLUMNS = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
RUN_ROWS = 4096


def _run_rows(cut_num: int):
    """Runs sorted by (region, mode) and falling nnz -> interval rows. A worker
    holds the loads of one group's bins and a batch of rows, whatever the
    number of runs, bins or items."""
    def fn(batches):
        group, loads, rows = None, None, []

        def final():
            return [("load", *group, None, None, None, None, None, None, b + 1, x) for b, x in enumerate(loads.tolist()) if x]

        for pdf in batches:
            for region, mode, nnz, m in zip(pdf["region"], pdf["mode"].tolist(), pdf["nnz"].tolist(), pdf["m"].tolist()):
                if group != (region, mode):
                    rows += final() if group else []
                    group, loads = (region, mode), np.zeros(cut_num, dtype=np.int64)
                stretches, loads = lpt_run(loads, nnz, m)
                for start, end, bins in stretches:
                    head = (region, mode, nnz)
                    rows += [("level", *head, x, start, end, len(bins), None, None, None) for x in rank_stripes(start, end)]
                    rows += [("slot", *head, None, start, None, None, n, b + 1, None)
                             for n, b in enumerate(bins[:end - start].tolist())]
                    while len(rows) >= RUN_ROWS:
                        yield _frame(rows[:RUN_ROWS])
                        rows = rows[RUN_ROWS:]
        rows += final() if group else []
        for at in range(0, len(rows), RUN_ROWS):
            yield _frame(rows[at:at + RUN_ROWS])

    def _frame(rows):
        out = pd.DataFrame(rows, columns=RUN_COLUMNS)
        for c in RUN_COLUMNS:
            if c not in ("kind", "region"):
                out[c] = out[c].astype("Int32" if c in ("mode", "part_id") else "Int64")
        return out
    return fn


def bucket_runs(hist: DataFrame, cut_num: int) -> DataFrame:
    """The closed form of every (region, mode, nnz) run as rows:

    * ``level``: the ranks from ``start`` to ``end`` go round ``width`` bins
      (one row per stripe of ranks that they touch),
    * ``slot``: in the stretch from ``start``, place ``pos`` of a round is bin
      ``part_id``; only places that an item takes, so there are no more than items,
    * ``load``: what bin ``part_id`` holds at the end.

    Groups are processed in order, each by one task that keeps ``cut_num`` loads."""
    runs = hist.groupBy("region", "mode", "nnz").agg(F.count(F.lit(1)).alias("m"))
    ordered = runs.repartition("region", "mode").sortWithinPartitions("region", "mode", F.desc("nnz"))
    return ordered.mapInPandas(_run_rows(int(cut_num)), RUN_SCHEMA)


def _ranked(hist: DataFrame, part_keys: list[str], order_col: str, blk: int) -> DataFrame:
    """0-based rank of ``order_col`` inside ``part_keys`` without one window
    over a whole (possibly huge) group: per-block counts, block offsets
    from a window over the block table, row numbers inside a block."""
    h = hist.withColumn("blk", (F.col(order_col) / F.lit(blk)).cast("long"))
    blocks = h.groupBy(*part_keys, "blk").agg(F.count(F.lit(1)).alias("bc"))
    w_blocks = Window.partitionBy(*part_keys).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("off", F.coalesce(F.sum("bc").over(w_blocks), F.lit(0)))
    w_in = Window.partitionBy(*part_keys, "blk").orderBy(order_col)
    h = h.withColumn("rn", F.row_number().over(w_in))
    return h.join(blocks.select(*part_keys, "blk", "off"), [*part_keys, "blk"]).withColumn(
        "rank", F.col("off") + F.col("rn") - 1).drop("off", "rn")


def bucket_map(hist: DataFrame, cut_num: int, max_dim: int, runs: DataFrame | None = None) -> DataFrame:
    """``(region, mode, slice, nnz, part_id)`` by longest-processing-time: a
    slice meets the stretch its rank lies in (an interval join within stripes of
    ranks) and then the bin at its place of the round (an equi-join)."""
    runs = bucket_runs(hist, cut_num) if runs is None else runs
    run = ["region", "mode", "nnz"]
    ranked = _ranked(hist, run, "slice", block_size(max_dim)).withColumn("stripe", F.expr(_rank_stripe("rank")))
    levels = runs.where("kind = 'level'").select(*run, "stripe", "start", "end", "width")
    met = ranked.join(levels, [*run, "stripe"]).where("rank >= start AND rank < end")
    met = met.select(*run, "slice", "start", F.expr("(rank - start) % width").alias("pos"))
    slots = runs.where("kind = 'slot'").select(*run, "start", "pos", "part_id")
    return met.join(slots, [*run, "start", "pos"]).select("region", "mode", "slice", "nnz", "part_id")


def bucket_loads(runs: DataFrame) -> DataFrame:
    """Final bin loads per group straight from the run table."""
    return runs.where("kind = 'load'").select("region", "mode", "part_id", "load")


# ---------------------------------------------------------------- greedy scan

def prefix_sums(hist: DataFrame, max_dim: int) -> DataFrame:
    """Inclusive prefix of nnz in slice order per group (``P``) and the
    exclusive one (``Pex``), via bounded windows."""
    blk = block_size(max_dim)
    h = hist.withColumn("blk", (F.col("slice") / F.lit(blk)).cast("long"))
    blocks = h.groupBy("region", "mode", "blk").agg(F.sum("nnz").alias("bs"))
    wb = Window.partitionBy("region", "mode").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("off", F.coalesce(F.sum("bs").over(wb), F.lit(0)))
    wi = Window.partitionBy("region", "mode", "blk").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("run", F.sum("nnz").over(wi))
    return h.join(blocks.select("region", "mode", "blk", "off"), ["region", "mode", "blk"]).select(
        "region", "mode", "slice", "nnz",
        (F.col("off") + F.col("run")).alias("P"),
        (F.col("off") + F.col("run") - F.col("nnz")).alias("Pex"),
    )


GROUP = ["region", "mode"]


def _successors(prefix: DataFrame, limits: DataFrame, max_dim: int) -> DataFrame:
    """``(region, mode, node, to)``: the reset that follows each possible one.

    A node is ``2 * slice + opened``. Counting goes on from ``base``, the
    prefix before the slice if it opened a bin and after it if it closed one,
    to the first slice whose prefix passes ``base + thr``. A slice that opened
    a bin and passes the threshold alone is followed by the next slot, empty or
    not, which opens another bin. Node 0 is the start of the scan."""
    p = prefix.join(F.broadcast(limits), GROUP)  # limits: one row per group, 12 at most
    # fewer than cut_num + 1 slices of a group pass total // cut_num alone
    after = p.where("nnz > thr AND slice < dim").select(*GROUP, (F.col("slice") + 1).alias("slice"), F.col("P").alias("base"))
    filled = prefix.select(*GROUP, "slice").join(F.broadcast(after.select(*GROUP, "slice")), [*GROUP, "slice"], "left_semi")
    empty = after.join(filled, [*GROUP, "slice"], "left_anti").join(F.broadcast(limits), GROUP)
    opened = (F.col("slice") * 2 + 1).alias("node")
    same = ["slice", "thr", "total", "dim", "width"]
    nodes = (p.select(*GROUP, (F.col("slice") * 2).alias("node"), F.col("P").alias("base"), F.lit(False).alias("heavy"), *same)
             .unionByName(p.select(*GROUP, opened, F.col("Pex").alias("base"), (F.col("nnz") > F.col("thr")).alias("heavy"), *same))
             .unionByName(empty.select(*GROUP, opened, "base", F.lit(False).alias("heavy"), *same))
             .unionByName(limits.select(*GROUP, F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("base"),
                                        F.lit(False).alias("heavy"), F.lit(0).cast("long").alias("slice"), *same[1:])))
    next_slot = nodes.where("heavy AND slice < dim").select(*GROUP, "node", (F.col("slice") * 2 + 3).alias("to"))
    points = nodes.where("NOT heavy AND base + thr < total").select(
        *GROUP, (F.col("base") + F.col("thr")).alias("v"), "width", "node", "base", "thr",
        F.lit(None).cast("struct<slice:bigint,Pex:bigint,P:bigint>").alias("interval"))
    starts = p.select(*GROUP, F.col("Pex").alias("v"), "width", *(F.lit(None).cast("long").alias(c) for c in ("node", "base", "thr")),
                      F.struct("slice", "Pex", "P").alias("interval"))
    both = starts.unionByName(points).withColumn("blk", F.expr("v div width"))
    # the interval that holds v is the last to start at or before it: in the same block of values, else before
    inside = Window.partitionBy(*GROUP, "blk").orderBy("v", F.col("node").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*GROUP).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy(*GROUP, "blk").agg(F.max("interval").alias("top")).select(
        *GROUP, "blk", F.last("top", ignorenulls=True).over(earlier).alias("carried"))
    hit = both.withColumn("found", F.last("interval", ignorenulls=True).over(inside)).where("node IS NOT NULL")
    hit = hit.join(blocks, [*GROUP, "blk"]).withColumn("found", F.coalesce("found", "carried"))
    over = F.col("found.P") - F.col("base") - F.col("thr")
    under = F.col("thr") - (F.col("found.Pex") - F.col("base"))
    return next_slot.unionByName(hit.select(*GROUP, "node", (F.col("found.slice") * 2 + (over > under).cast("long")).alias("to")))


def greedy_resets(prefix: DataFrame, totals: dict, dims: dict, cut_num: int) -> list[tuple]:
    """``[(region, mode, slice, opened), ...]``: the resets of the greedy scan
    of all groups (O(cut_num) of them), the chain followed by doubling.

    ``totals``: {(region, mode): cells}; ``dims``: {mode: dim}."""
    spark = prefix.sparkSession
    max_dim = max(dims.values())
    groups = sorted(g for g in totals if totals[g] > 0)
    if not groups:
        return []
    rows = [(r, int(m), totals[r, m] // cut_num, totals[r, m], int(dims[m]),
             max(1, totals[r, m] // max(1, math.isqrt(max_dim)))) for r, m in groups]
    limits = spark.createDataFrame(rows, "region string, mode int, thr long, total long, dim long, width long")
    jump = stash(_successors(prefix, limits, max_dim), "greedy-next")
    seen = [(r, int(m), 0) for r, m in groups]
    while True:
        # seen: the first 2**k nodes of each chain; jump: 2**k steps at once
        here = spark.createDataFrame(seen, "region string, mode int, node long")
        new = [(r["region"], r["mode"], r["to"]) for r in jump.join(F.broadcast(here), [*GROUP, "node"]).collect()]
        if not new:
            break
        seen += new
        far = jump.select(*GROUP, F.col("node").alias("to"), F.col("to").alias("far"))
        jump = stash(jump.join(far, [*GROUP, "to"]).select(*GROUP, "node", F.col("far").alias("to")), "greedy-jump")
    return [(r, m, n // 2, bool(n % 2)) for r, m, n in seen if n]


def greedy_map(hist: DataFrame, cut_num: int, dims: dict, totals: dict | None = None) -> DataFrame:
    """``(region, mode, slice, nnz, part_id)`` by the greedy slice scan."""
    spark = hist.sparkSession
    max_dim = max(dims.values())
    prefix = stash(prefix_sums(hist, max_dim), "greedy-prefix")
    if totals is None:
        totals = {(r["region"], r["mode"]): int(r["t"]) for r in
                  prefix.groupBy("region", "mode").agg(F.sum("nnz").alias("t")).collect()}
    resets = spark.createDataFrame(greedy_resets(prefix, totals, dims, cut_num), "region string, mode int, slice long, opened boolean")
    blk = block_size(max_dim)
    # slots with a reset may be empty; they count for the slices after them and are dropped then
    slots = prefix.select(*GROUP, "slice", "nnz", F.lit(0).alias("resets"), F.lit(0).alias("opens")).unionByName(
        resets.select(*GROUP, "slice", F.lit(None).cast("long").alias("nnz"), F.lit(1).alias("resets"),
                      F.col("opened").cast("int").alias("opens")))
    slots = slots.groupBy(*GROUP, "slice").agg(F.max("nnz").alias("nnz"), F.sum("resets").alias("resets"), F.sum("opens").alias("opens"))
    slots = slots.withColumn("blk", (F.col("slice") / F.lit(blk)).cast("long"))
    before = Window.partitionBy(*GROUP).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = slots.groupBy(*GROUP, "blk").agg(F.sum("resets").alias("n")).select(
        *GROUP, "blk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    inside = Window.partitionBy(*GROUP, "blk").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("inner", F.coalesce(F.sum("resets").over(inside), F.lit(0))).join(blocks, [*GROUP, "blk"])
    part = F.least(1 + F.col("off") + F.col("inner") + F.col("opens"), F.lit(int(cut_num)))
    return slots.where("nnz IS NOT NULL").select(*GROUP, "slice", "nnz", part.cast("int").alias("part_id"))


# ---------------------------------------------------------------- labels and balance

def label_cells(labelled: DataFrame, part_map: DataFrame, max_rows: int) -> DataFrame:
    """Each (cell, mode new in its region) with its slice's ``part_id``."""
    from .tensor import MODES
    cand = F.array(*[
        F.when(F.substring("region", m + 1, 1) == F.lit("1"), F.struct(F.lit(m).alias("mode"), coord(m).alias("slice")))
        for m in MODES
    ])
    x = labelled.select("region", "i", "j", "k", "val", F.explode(F.filter(cand, lambda c: c.isNotNull())).alias("_s"))
    x = x.select("region", "i", "j", "k", "val", F.col("_s.mode").alias("mode"), F.col("_s.slice").alias("slice"))
    m = broadcast_if_small(part_map.select("region", "mode", "slice", "part_id"), max_rows, 48)
    return x.join(m, ["region", "mode", "slice"])


def group_by_part(labelled_cells: DataFrame, cut_num: int, spread: int = 1) -> DataFrame:
    """Co-locate cells by label: partition ``part_id - 1`` holds bin
    ``part_id`` (one bin per partition, as in a key-grouped layout). A bin that
    holds a hot slice can be too much for one task: with ``spread`` every bin is
    dealt over that many neighbouring partitions by the cell's coordinates, and
    what is summed per slice needs one more (partial) step."""
    own = F.pmod(F.xxhash64("i", "j", "k"), F.lit(int(spread))) if spread > 1 else F.lit(0)
    pid = ((F.col("part_id") - 1) * int(spread) + own).cast("int")
    return labelled_cells.withColumn("pid", pid).repartitionById(int(cut_num) * int(spread), "pid")


# ---------------------------------------------------------------- cells stored by bin

def bin_keys(spark, cut_num: int) -> list[int]:
    """For each bin a number whose bucket (its hash modulo ``cut_num``) is the
    bin's own, so that a table bucketed by it holds one bin per bucket."""
    keys: dict[int, int] = {}
    at, step = 0, 32 * int(cut_num) + 64
    while len(keys) < cut_num:
        rows = spark.range(at, at + step).select("id", F.pmod(F.hash("id"), F.lit(int(cut_num))).alias("b"))
        for r in rows.groupBy("b").agg(F.min("id").alias("id")).collect():  # one row per bin
            keys.setdefault(r["b"], r["id"])
        at += step
    return [keys[b] for b in range(cut_num)]


@dataclass
class BinLayout:
    """Labelled cells as stored: ``whole`` is bucketed by bin, so what is summed
    per (bin, slice) needs no exchange; ``split`` holds the bins that are too
    heavy for one task, spread evenly. A slice lies in one of the two only."""

    whole: DataFrame
    split: DataFrame | None
    split_bins: set

    def cells(self, region: str, mode: int) -> tuple[DataFrame, DataFrame | None]:
        cond = f"region = '{region}' AND mode = {int(mode)}"
        heavy = any(g[:2] == (region, mode) for g in self.split_bins)
        return self.whole.where(cond), self.split.where(cond) if heavy else None


def store_by_bin(labelled: DataFrame, part_map: DataFrame, cut_num: int, max_rows: int, loads: dict,
                 heavy: float = 2.0, least: int = 1 << 16) -> BinLayout:
    """Store every cell once per new mode of its region, by (mode, region) and bin.

    ``loads``: {(region, mode, part_id): cells}. A bin with more than ``heavy``
    times its group's mean and more than ``least`` cells is split."""
    spark = labelled.sparkSession
    totals: dict = {}
    for (region, mode, _), n in loads.items():
        totals[region, mode] = totals.get((region, mode), 0) + n
    split = {g for g, n in loads.items() if n > least and n > heavy * totals[g[:2]] / cut_num}
    cells = label_cells(labelled, part_map, max_rows)
    keys = F.array(*[F.lit(int(k)) for k in bin_keys(spark, cut_num)])
    whole, apart = cells, None
    if split:
        rows = spark.createDataFrame([(r, int(m), int(p)) for r, m, p in sorted(split)], "region string, mode int, part_id int")
        whole = cells.join(F.broadcast(rows), ["region", "mode", "part_id"], "left_anti")  # 12 * cut_num rows at most
        # only regions with such a bin are read for them
        near = label_cells(labelled.where(F.col("region").isin(sorted({g[0] for g in split}))), part_map, max_rows)
        apart = stash(near.join(F.broadcast(rows), ["region", "mode", "part_id"], "left_semi")
                      .select("mode", "region", "i", "j", "k", "val", "part_id").hint("rebalance"), "cells-split", ["mode", "region"])
    whole = whole.select("mode", "region", "i", "j", "k", "val", "part_id",
                         F.element_at(keys, F.col("part_id")).cast("long").alias("bin_key"))
    stored = stash_bucketed(whole, "cells-by-bin", int(cut_num), "bin_key", ["mode", "region"])
    return BinLayout(stored, apart, split)


def partition_loads(part_map: DataFrame) -> DataFrame:
    return part_map.groupBy("region", "mode", "part_id").agg(F.sum("nnz").alias("load"))


def partition_cv(loads: DataFrame) -> DataFrame:
    """CV of cells per non-empty partition of each (region, mode), with the
    integer mean and variance of the published metric (``cv``) and the
    true-division value (``cv_exact``)."""
    g = loads.where(F.col("load") > 0).groupBy("region", "mode").agg(
        F.count(F.lit(1)).alias("n"), F.sum("load").alias("s"),
        F.sum(F.col("load") * F.col("load")).alias("s2"),
        F.stddev_pop("load").alias("sd"), F.avg("load").alias("avg"),
    )
    mean = F.expr("s div n")
    var = F.expr("(s2 - 2 * (s div n) * s + n * (s div n) * (s div n)) div n")
    return g.select(
        "region", "mode", F.col("n").alias("parts"), F.col("s").alias("cells"),
        (F.sqrt(var.cast("double")) / mean.cast("double")).alias("cv"),
        (F.col("sd") / F.col("avg")).alias("cv_exact"),
    )


def partition_cv_mean(cv: DataFrame) -> DataFrame:
    """Mean CV over the non-empty (region, mode) groups."""
    return cv.agg(F.avg("cv").alias("partition_cv"), F.avg("cv_exact").alias("partition_cv_exact"),
                  F.count(F.lit(1)).alias("groups"))
