"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Two documents are linked if the sets of their word shingles have a Jaccard
similarity of at least ``threshold``.

1. Documents with the same words in the same order form a class; only classes
   go on, with one MinHash signature each.
2. A signature is cut into the labels of ``trees`` prefix tries. All labels are
   range-sorted, so each trie is a sorted run over many partitions, and every
   label is compared with its neighbour's: the length of their common prefix
   tells at which depth two classes stand in the same subtree.
3. The prefix that must match starts at full depth and is shortened until the
   estimated recall reaches ``recall``: each neighbouring pair that looks
   similar enough stands for 1 / p pairs, p being its chance to meet at that
   depth in any trie. The shortest allowed prefix meets the target even for
   pairs at the threshold.
4. Neighbours that share the prefix are joined to clusters. As subtrees are
   runs, every pair that shares a prefix in any trie is in one cluster.
5. Clusters are dealt out in pairs of blocks of about ``block`` classes (fewer,
   if their shingle sets are large), and all pairs of a block pair are verified
   exactly on their shingle sets by matrix products. What leaves is one row per class with its number of links,
   and the edges of a spanning forest - never the pairs themselves.

A group of copies, near or exact, may hold any share of the documents: exact
copies are counted before anything is shuffled by their class, runs are sorted
over partitions, and a large cluster is spread over its block pairs.

Null, empty and white-space-only texts link with nothing. Repeated rows are
copies of each other. Null ids sort after all others when a representative is
chosen. An empty table gives an empty one. Other columns do not pass and cannot
clash. Very long texts are taken
whole; a block pair holds at most two blocks of shingle sets at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tridelta.session import broadcast_if_small

from .common import map_arrow, small_batches, store
from .graph import components
from .shingles import MinHash, Shingler, text_key

TREES, DEPTH = 32, 8
RECALL = 0.999
BLOCK = 512  # classes
BLOCK_BYTES = 32 << 20  # of shingle sets


def key_column(text: Column) -> Column:
    """``text_key`` as an expression."""
    words = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(words != "", F.unhex(F.md5(words.cast("binary"))))


def meets(similarity: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """Chance that two sets share a prefix of ``depth`` values in some trie."""
    return 1 - (1 - np.asarray(similarity, dtype=float) ** depth) ** trees


def shortest_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    fits = [d for d in range(1, depth + 1) if meets(threshold, d, trees) >= recall]
    if not fits:
        raise ValueError("more tries are needed for this recall")
    return max(fits)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, rows: int) -> DataFrame:
    """(id, key, sig, n) per document: its class, signature and number of
    shingles; key and sig are null without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minhash = Shingler(size), MinHash(rows)
        for b in small_batches(batches):
            keys, sigs, sizes = [], [], []
            for text in b.column(1).to_pylist():
                data = (text or "").encode()
                keys.append(text_key(data))
                found = shingler.shingles(data)
                sizes.append(len(found))
                sigs.append(minhash.signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())],
                ["id", "key", "sig", "n"])

    return map_arrow(
        docs.select(F.col(id_col), F.col(text_col)), run, f"id {kind}, key binary, sig binary, n bigint")


def neighbours(classes: DataFrame, trees: int, depth: int, shortest: int) -> DataFrame:
    """(a, b, common): neighbours in the sorted tries, with their common prefix."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = 2 * depth
    labels = F.expr(f"transform(sequence(0, {trees - 1}), t -> named_struct('tree', t, 'label', "
                    f"substring(sig, t * {width} + 1, {width})))")
    rows = classes.select("key", F.explode(labels).alias("x")).select("x.tree", "x.label", "key")
    ordered = rows.repartitionByRange(n, "tree", "label", "key").sortWithinPartitions("tree", "label", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kinds = [("a", pa.binary()), ("b", pa.binary()), ("common", pa.int32()), ("part", pa.int32()),
                 ("tree", pa.int32()), ("label", pa.binary())]

        def batch(*columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            tree = b.column(0).to_numpy(zero_copy_only=False)
            label = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=">u2").reshape(-1, depth)
            key = b.column(2).to_pylist()
            if last is None:  # the partition's ends are compared with their neighbours later
                yield batch([key[0]], [None], [0], [part], [int(tree[0])], [label[0].tobytes()])
            else:
                tree, label = np.concatenate([[last[0]], tree]), np.vstack([last[1], label])
                key = [last[2], *key]
            common = np.logical_and.accumulate(label[1:] == label[:-1], axis=1).sum(1) * (tree[1:] == tree[:-1])
            near = np.flatnonzero(common >= shortest)
            if len(near):
                m = len(near)
                yield batch([key[k] for k in near], [key[k + 1] for k in near], common[near].tolist(),
                            [part] * m, [None] * m, [None] * m)
            last = (tree[-1], label[-1:], key[-1])
        if last is not None:
            yield batch([None], [last[2]], [0], [part], [int(last[0])], [last[1].tobytes()])

    out = store(map_arrow(ordered, run, "a binary, b binary, common int, part int, tree int, label binary"), "forest-runs")
    inner = out.where("a is not null and b is not null").select("a", "b", "common")
    # last row of a partition and first row of the next one that has rows: two rows per partition
    ends = W.orderBy("part", F.col("a").isNull())
    edge = out.where("a is null or b is null").select(
        "part", "a", "b", "tree", "label", *(F.lag(c).over(ends).alias(f"last_{c}") for c in ("b", "tree", "label")))
    equal = [F.substring("label", 1, 2 * k) == F.substring("last_label", 1, 2 * k) for k in range(1, depth + 1)]
    common = sum((e.cast("int") for e in equal), F.lit(0))
    across = (edge.where("a is not null and last_b is not null and tree = last_tree")
              .select(F.col("last_b").alias("a"), F.col("a").alias("b"), common.alias("common")).where(F.col("common") >= shortest))
    return inner.unionByName(across)


def _agreement(pairs: DataFrame) -> DataFrame:
    """common and the share of equal signature values, per pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint16).reshape(b.num_rows, -1) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array((x == y).sum(1), pa.int32())], ["common", "equal"])

    return map_arrow(pairs.select("common", "sig_a", "sig_b"), run, "common int, equal int")


def choose_depth(near: DataFrame, classes: DataFrame, threshold: float, trees: int, depth: int, shortest: int,
                 recall: float) -> int:
    """Shorten the prefix from full depth until the estimated recall is met."""
    pairs = near.groupBy("a", "b").agg(F.max("common").alias("common"))
    sigs = classes.select("key", "sig")
    pairs = (pairs.join(sigs.select(F.col("key").alias("a"), F.col("sig").alias("sig_a")), "a")
             .join(sigs.select(F.col("key").alias("b"), F.col("sig").alias("sig_b")), "b"))
    table = _agreement(pairs).groupBy("common", "equal").count().collect()  # depth x signature rows at most
    rows = trees * depth
    seen = np.array([(r["common"], r["equal"] / rows, r["count"]) for r in table if r["equal"] >= threshold * rows])
    for d in range(depth, shortest, -1):
        met = seen[seen[:, 0] >= d] if len(seen) else seen
        if len(met):
            found = met[:, 2].sum()
            # pairs that meet in the tries only below this depth are known to be missed
            expected = max((met[:, 2] / meets(met[:, 1], d, trees)).sum(), seen[:, 2].sum())
            if found / expected >= recall:
                return d
    return shortest


def _shingle_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(cluster, key, weight, blocks, own, set): sorted distinct shingles of each
    clustered class, from its representative's whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = members.select(F.col("rep").alias("rep"), "key", "cluster", "weight", "blocks")
    rows = rows.join(broadcast_if_small(wanted, members.count(), 96), F.col("id").eqNullSafe(F.col("rep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for b in small_batches(batches):
            data = [(t or "").encode() for t in b.column(0).to_pylist()]
            mine = [k for k, (d, key) in enumerate(zip(data, b.column(1).to_pylist())) if text_key(d) == key]
            sets = [np.unique(shingler.shingles(data[k])).tobytes() for k in mine]
            rest = b.select(["key", "cluster", "weight", "blocks"]).take(pa.array(mine, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sets, pa.binary())], [*rest.schema.names, "set"])

    return map_arrow(
        rows.select("text", "key", "cluster", "weight", "blocks"), run, "key binary, cluster binary, weight bigint, blocks bigint, set binary")


def linked(left: list[np.ndarray], share: Fraction, cells: int = 4 << 20) -> np.ndarray:
    """Which of the sets (sorted distinct hashes) are at least ``share`` similar:
    a matrix of booleans without its diagonal. Exact in the hashes."""
    sizes = np.array([len(s) for s in left], dtype=np.int64)
    n = len(left)
    _, code, count = np.unique(np.concatenate(left), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = count[code] > 1
    owner, code = owner[shared], code[shared]
    names, code = np.unique(code, return_inverse=True)
    both = np.zeros((n, n), dtype=np.float64)
    step = max(1, cells // n)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for at in range(0, len(names), step):
        lo, hi = np.searchsorted(code, [at, at + step])
        grid = np.zeros((n, min(step, len(names) - at)), dtype=np.float32)
        grid[owner[lo:hi], code[lo:hi] - at] = 1
        both += grid @ grid.T
    common = both.astype(np.int64)
    p, q = share.numerator, share.denominator
    # common / union >= p / q
    out = common * (p + q) >= p * (sizes[:, None] + sizes[None, :])
    out &= common > 0
    np.fill_diagonal(out, False)
    return out


def roots(adjacent: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric matrix."""
    label = np.arange(len(adjacent))
    while True:
        low = np.where(adjacent, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify(sets: DataFrame, share: Fraction) -> DataFrame:
    """(key, links, root): per class and block pair, the documents that it is
    linked with there, and the smallest class of its component in it."""
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks"))
    grid = (sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "weight", "set"))
    # dealt by block pair, then streamed group by group: a task holds one block pair at a time
    dealt = grid.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(group: list) -> Iterator[pa.RecordBatch]:
            rows = [r for k, r in enumerate(group) if not k or r["key"] != group[k - 1]["key"]]  # repeated rows
            if len(rows) < 2:
                return
            adjacent = linked([np.frombuffer(r["set"], np.uint64) for r in rows], share)
            side = np.array([r["own"] for r in rows])
            if rows[0]["i"] != rows[0]["j"]:
                adjacent &= side[:, None] != side[None, :]
            links = adjacent @ np.array([r["weight"] for r in rows], dtype=np.int64)
            hit = np.flatnonzero(links)
            if len(hit):
                root = roots(adjacent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[k]["key"] for k in hit], pa.binary()), pa.array(links[hit], pa.int64()),
                     pa.array([rows[root[k]]["key"] for k in hit], pa.binary())], ["key", "links", "root"])

        group, at = [], None
        for b in small_batches(batches):
            for r in b.to_pylist():
                here = (r["cluster"], r["i"], r["j"])
                if here != at:
                    yield from judged(group)
                    group, at = [], here
                group.append(r)
        yield from judged(group)

    return map_arrow(dealt, run, "key binary, links bigint, root binary")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8,
         trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: id, key (its class; null without words), class_id
    (smallest id of its class), n_links (other documents it is linked with,
    exact copies included), component_id (smallest id reachable by links),
    component (that component's first class) and kept (id = component_id)."""
    shortest = shortest_depth(threshold, trees, depth, recall)
    rows = store(signatures(docs, id_col, text_col, size, trees * depth), "forest-signatures")
    classes = store(rows.where("key is not null").groupBy("key").agg(
        F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("sig").alias("sig"),
        F.max("n").alias("n")), "forest-classes")
    near = store(neighbours(classes, trees, depth, shortest), "forest-near")
    d = choose_depth(near, classes, threshold, trees, depth, shortest, recall)
    clusters = components(near.where(F.col("common") >= d))
    members = store(clusters.select(F.col("id").alias("key"), F.col("component").alias("cluster"))
                    .join(classes.select("key", "rep", "weight", "n"), "key"), "forest-clustered")
    sizes = store(members.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count("*") / F.lit(float(block))), F.ceil(F.sum("n") * 8 / F.lit(float(BLOCK_BYTES)))).alias("blocks")), "forest-sizes")
    members = store(members.join(sizes, "cluster"), "forest-members")
    found = store(verify(_shingle_sets(docs, members, id_col, text_col, size), Fraction(threshold).limit_denominator(1000)), "forest-links")
    groups = components(found, "key", "root")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    info = (classes.select("key", "rep", "weight").join(links, "key", "left")
            .join(groups.select(F.col("id").alias("key"), "component"), "key", "left")
            .withColumn("component", F.coalesce("component", "key")))
    info = store(info, "forest-info")
    first = store(info.groupBy("component").agg(F.min("rep").alias("component_id")), "forest-first")
    info = store(info.join(first, "component").select(
        "key", "component", "component_id", F.col("rep").alias("class_id"),
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "forest-result")
    out = rows.select("id", "key").join(info, "key", "left")
    alone = F.col("key").isNull()
    return out.select(
        "id", "key", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "component",
        (alone | F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every component: that with the smallest id
    (null ids last). Rows without words stay."""
    found = store(join(docs, id_col, text_col, **options).where("key is not null")
                  .select("id", "key", "component", "component_id"), "forest-found")
    first = F.col("id").eqNullSafe(F.col("component_id"))
    gone = store(found.where(~first).select("id", "key").distinct(), "forest-gone")
    # an id that stands in several rows of its component: one of them stays
    many = store(found.where(first).groupBy("component").agg(
        F.min("component_id").alias("id"), F.min("key").alias("key"), F.count("*").alias("n"),
        ).where("n > 1").select("component", "id", "key"), "forest-many")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("own_id"),
                       key_column(F.col(text_col)).alias("own_key"))

    def same(other: DataFrame) -> Column:
        return F.col("own_id").eqNullSafe(other["id"]) & (F.col("own_key") == other["key"])

    gone = broadcast_if_small(gone, gone.count(), 96)
    rows = rows.join(gone, same(gone), "left_anti")
    if many.count():
        named = many.select("component", F.col("key").alias("only"))
        every = store(found.where(first).join(named, "component").groupBy("id", "key").agg(
            F.first("component").alias("component"), F.max(F.col("key") == F.col("only")).alias("chosen")), "forest-every")
        alone = rows.join(every, same(every), "left_anti")
        one = (rows.join(every.where("chosen"), same(every), "inner").dropDuplicates(["component"]).select("row", "own_id", "own_key"))
        rows = alone.unionByName(one)
    return rows.select("row.*")
