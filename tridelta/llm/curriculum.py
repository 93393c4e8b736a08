"""Mixing sources to target weights along a time-varying curriculum.

Each source has a schedule: a piecewise linear weight over training time 0 to
1, given by knots. The integral of the schedule is the source's weight in the
whole mix. ``budget_share`` times the corpus' words are shared by these
weights; a target stops at ``cap`` times its source's words and the excess
goes to the others by weight (water level: target = min(cap * words,
level * weight), one level for all).

Within a source documents stand in the order of a seeded hash of their id.
A source's words are laid end to end, again and again, up to its target, so a
document is taken once for each pass that reaches it (the last one perhaps in
part). The words demanded of a source up to time t are its target times the
share of its schedule's integral up to t; inverting that at a copy's first
word gives the copy's training position, and the mix is range-sorted by it.

Prefix sums are taken in two levels, buckets of the hash and then rows within
a bucket, with about sqrt(rows) buckets, so no task holds a whole source.

Null text, empty text and text without words: size 0, never taken. Null
source: a source of its own, last in order. Null ids sort first. Repeated
rows are rows of their own; those equal in id and size are interchangeable.
All columns of the input are kept apart in a struct and cannot clash. Very long
texts only count by their words. An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tridelta.session import broadcast_if_small

from .common import WORD_RE, store

SOURCE_ROW_BYTES = 512


@dataclass(frozen=True)
class MixPlan:
    """knots: for each class of sources its ((time, weight), ...) from 0 to 1;
    sources take the classes in turn, in code point order, null last."""

    knots: tuple[tuple[tuple[float, float], ...], ...]
    budget_share: float = 1.5
    cap: float = 2.0
    seed: str = "mix"

    def segments(self, turn: int) -> list[tuple[float, float, float, float, float]]:
        """(t0, t1, w0, w1, integral before) of one class."""
        out, total = [], 0.0
        for (t0, w0), (t1, w1) in zip(self.knots[turn], self.knots[turn][1:]):
            out.append((t0, t1, w0, w1, total))
            total += (w0 + w1) / 2 * (t1 - t0)
        return out

    def weight(self, turn: int) -> float:
        return sum((w0 + w1) / 2 * (t1 - t0) for t0, t1, w0, w1, _ in self.segments(turn))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null: '' stands for a null source."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _by_turn(turn: Column, values: list[Column]) -> Column:
    out = values[-1]
    for k in range(len(values) - 2, -1, -1):
        out = F.when(turn == k, values[k]).otherwise(out)
    return out


def source_targets(sizes: DataFrame, plan: MixPlan) -> DataFrame:
    """One row per source: skey, source_size, weight, segs, target. Its
    windows run over the sources alone."""
    src = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("skey") == "", "skey")
    n = len(plan.knots)
    src = src.withColumn("turn", (F.row_number().over(order) - 1) % n)
    segs = [F.array(*(F.struct(*(F.lit(float(v)).alias(name) for name, v in zip(("t0", "t1", "w0", "w1", "cum"), seg)))
                      for seg in plan.segments(k))) for k in range(n)]
    src = src.withColumn("weight", _by_turn(F.col("turn"), [F.lit(float(plan.weight(k))) for k in range(n)]))
    src = src.withColumn("segs", _by_turn(F.col("turn"), segs))
    cap = F.col("source_size") * F.lit(float(plan.cap))
    by_level = W.orderBy(F.col("source_size") * F.lit(float(plan.cap)) / F.col("weight"), "skey")
    everything = W.partitionBy()
    src = (src.withColumn("cap", cap)
           .withColumn("before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
           .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
           .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(plan.budget_share)))
           .withColumn("level", F.max((F.col("budget") - F.col("before")) / F.col("open")).over(everything)))
    target = F.when(F.col("budget") >= F.sum("cap").over(everything), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return src.select("skey", "source_size", "weight", "segs", target.alias("target"))


def _position(words_before: Column, target: Column, weight: Column, segs: Column) -> Column:
    """Time at which a source has demanded ``words_before`` words."""
    need = words_before / target * weight
    seg = F.element_at(F.filter(segs, lambda s: s["cum"] <= need), -1)
    rest = need - seg["cum"]
    slope = (seg["w1"] - seg["w0"]) / (seg["t1"] - seg["t0"])
    inner = F.greatest(F.lit(0.0), seg["w0"] * seg["w0"] + F.lit(2.0) * slope * rest)
    speed = seg["w0"] + F.sqrt(inner)
    return F.least(seg["t1"], seg["t0"] + F.when(speed > 0, F.lit(2.0) * rest / speed).otherwise(F.lit(0.0)))


def allocate(docs: DataFrame, plan: MixPlan, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``row`` (struct of the columns ``keep``, all by
    default), size, source_size, target, taken, positions (one per copy)."""
    keep = docs.columns if keep is None else keep
    ids = F.col(id_col).cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(id_col).alias("id"),
                       source_key(F.col(source_col)).alias("skey"), word_count(F.col(text_col)).alias("size"),
                       F.md5(F.concat(F.lit(plan.seed + ":"), F.coalesce(ids, F.lit("")))).alias("h"))
    if text_col not in keep:  # narrow enough to be stored: the text is read once
        rows = store(rows, "mix-rows")
        sizes = rows.select("id", "skey", "size", "h")
    else:
        sizes = store(rows.select("id", "skey", "size", "h"), "mix-sizes")
    n_buckets = max(1, int(sizes.count() ** 0.5))
    bucket = F.shiftrightunsigned(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(n_buckets), 32)
    rows, sizes = rows.withColumn("bucket", bucket), sizes.withColumn("bucket", bucket)
    totals = store(sizes.groupBy("skey", "bucket").agg(F.sum("size").alias("size")), "mix-buckets")
    starts = totals.select("skey", "bucket", F.coalesce(F.sum("size").over(
        W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    src = store(source_targets(totals, plan), "mix-sources")
    src = broadcast_if_small(src, src.count(), SOURCE_ROW_BYTES)
    within = W.partitionBy("skey", "bucket").orderBy("h", F.col("id").asc_nulls_first(), "size")
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(starts, ["skey", "bucket"]).join(src, "skey")
    wanted = F.floor(F.col("target") + F.lit(0.5))  # whole words of the source in the mix
    offset = F.col("start") + F.col("inner")
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0).cast("long"), F.ceil(
        (wanted - offset) / F.col("source_size")))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("offset", offset).withColumn("copies", copies)
    last = F.col("copies") - 1
    taken = F.when(F.col("copies") > 0, last * F.col("size") + F.least(
        F.col("size"), wanted - F.col("offset") - last * F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    passes = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    positions = F.transform(passes, lambda e: _position(
        F.col("offset") + e * F.col("source_size"), F.col("target"), F.col("weight"), F.col("segs")))
    return rows.select("row", "id", "size", "source_size", "target", taken.alias("taken"), positions.alias("positions"))


def mix(docs: DataFrame, plan: MixPlan, **columns) -> DataFrame:
    """The mix itself: one row per copy (the columns of ``docs``), range-sorted
    by training position. A copy taken in part is kept whole."""
    copies = allocate(docs, plan, **columns).select("row", "id", F.explode("positions").alias("position"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (copies.repartitionByRange(n, "position", "id").sortWithinPartitions("position", "id")
            .select("row.*"))
