"""Connected components of a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, store


def contract(edges: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """(u, v): the edges of each partition, ``chunk`` by ``chunk``, replaced by
    stars with the same components. A map: nothing is shuffled, and a task
    holds one chunk of edges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        seen = 0

        def top(x):
            while (y := above.setdefault(x, x)) != x:
                above[x] = above[y]
                x = above[y]
            return x

        def stars() -> Iterator[pa.RecordBatch]:
            pairs = [(x, r) for x in above if (r := top(x)) != x]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pairs), kinds)], ["u", "v"])

        for b in batches:
            kinds = b.schema.types
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = top(x), top(y)
                if x != y:
                    above[max(x, y)] = min(x, y)
            seen += b.num_rows
            if seen >= chunk:
                yield from stars()
                above.clear()
                seen = 0
        if seen:
            yield from stars()

    kind = edges.schema[0].dataType.simpleString()
    return map_arrow(edges, run, f"u {kind}, v {kind}")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every node of an edge, and the smallest node that can
    be reached from it. Nodes are of any ordered type but null; loops and
    repeated edges do no harm (nodes with nothing but loops are left out).

    Each round every node learns the smallest label among its neighbours,
    passes it on to the node it is labelled with, and then takes over its
    label's label, so labels travel in leaps and the rounds are about the
    logarithm of the longest path. All tables between are stored in the shared
    folder; minima are taken with partial sums, and joins are between stored
    tables, so that a node with very many neighbours can be split.
    """
    u, v = F.col(a), F.col(b)
    stars = contract(edges.where(u != v).select(u.alias("u"), v.alias("v")))
    both = stars.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
    both = store(both.select("e.u", "e.v").distinct(), "graph-edges")
    labels = store(both.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("id"), F.least("u", "v").alias("label")), "graph-labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("v"), F.col("label").alias("heard")), "v") \
            .groupBy(F.col("u").alias("id")).agg(F.min("heard").alias("heard"))
        best = F.least("label", "heard")
        told = labels.select("id", "label").join(heard, "id").select("id", "label", best.alias("best"))
        # what a node hears, it also offers to the node that it is labelled with
        offers = told.select(F.explode(F.filter(F.array(
            F.struct("id", "best", F.col("label").alias("before")),
            F.struct(F.col("label").alias("id"), "best", F.lit(None).cast(labels.schema["id"].dataType).alias("before"))),
            lambda x: x["before"].isNotNull() | (x["best"] < x["id"]))).alias("x"))
        hooked = store(offers.groupBy("x.id").agg(F.min("x.best").alias("label"), F.max("x.before").alias("before")), "graph-hooked")
        leap = hooked.select(F.col("id").alias("label"), F.col("label").alias("next"))
        labels = store(hooked.join(leap, "label").select("id", F.col("next").alias("label"), "before"), "graph-labels")
        if not labels.where(F.col("label") != F.col("before")).limit(1).count():
            return labels.select("id", F.col("label").alias("component"))
