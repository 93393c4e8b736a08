"""Repeated passages: seed and extend over winnowed anchors.

A window is ``length`` consecutive words; it repeats if its words stand somewhere
else, too (in the same text or another). The maximal stretches that such windows
cover are found without forming all windows:

1. Seeds. Every window selects the least of its ``seed``-word hashes (the first
   of equals), so equal windows select the same seed at the same place. A text's
   selected places are its anchors, about one word in twelve. Texts that are equal
   count once from here on; all windows of a text that has a copy are repeats.
2. Join. Anchors are joined by hash; those that stand in one place only are
   dropped. That is most of them.
3. Extend, both ways. With each anchor goes a hash of the words around it, as far
   as its windows reach. Where all occurrences of an anchor agree in it, every match
   extends over the whole surroundings, left and right, and nothing needs comparing
   word by word. Elsewhere each window that selected the anchor is one way of
   extending it, so many words left and the rest right: occurrences match so far
   if they agree in that window's hash.
4. What matches of neighbouring anchors overlaps is merged into maximal repeats.

No pairs are formed: a join partner is always a row per hash, so a passage that
a third of all texts share costs each of them a few rows. All these tables grow
with the texts, so none is broadcast: joins sort and merge, and a hot key is split
at run time. Hashes that must agree are 128 bits together (an anchor's and its
surroundings', or its window's).

Null text: no words. Null ids, ties and repeated rows: every row of the input
comes back once. Texts with fewer words than ``length`` lose nothing. Very long texts
are hashed block by block. An empty table gives an empty one. All columns asked
for come back in one struct ``row``, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_arrow, small_batches, store, words_of
from .shingles import SPACE, Shingler, mix

LENGTH = 35
SEED = 12
BLOCK_WORDS = 1 << 16
BLOCK_BYTES = 1 << 20
KEY = ["k1", "k2"]
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def word_hashes(shingler: Shingler, data: bytes, block: int = BLOCK_BYTES) -> np.ndarray:
    """A 64-bit hash of every word, block by block for long texts."""
    if len(data) <= 2 * block:
        return shingler.words(data)
    raw, parts, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(data):
        to = at + block
        while to < len(data) and not (hits := np.flatnonzero(SPACE[raw[to:to + block]])).size:
            to += block
        to = to + int(hits[0]) if to < len(data) else len(data)
        parts.append(shingler.words(data[at:to]))
        at = to
    return np.concatenate(parts)


class Anchors:
    """Windows, their seeds and hashes of a text given by its words' hashes."""

    def __init__(self, length: int = LENGTH, seed: int = SEED):
        if not 1 <= seed < length:
            raise ValueError("a seed must be shorter than a window")
        self.length, self.seed, self.reach = length, seed, length - seed
        n = BLOCK_WORDS + 4 * length
        self.powers, self.inverses = [], []
        for factor in FACTORS:
            for out, x in ((self.powers, factor), (self.inverses, pow(factor, -1, 1 << 64))):
                out.append(np.cumprod(np.append(np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)), dtype=np.uint64))

    def _sums(self, words: np.ndarray, k: int) -> np.ndarray:
        """Running sums of which differences are hashes of stretches."""
        own = words if k == 0 else mix(words + np.uint64(FACTORS[1]))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * self.powers[k][:len(own)], dtype=np.uint64)])

    def _stretch(self, sums: np.ndarray, k: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[begin]) * self.inverses[k][begin] + (end - begin).astype(np.uint64))

    def blocks(self, words: np.ndarray) -> Iterator[tuple]:
        """For runs of windows: (first window, place of the seed of each
        window, words before the slice, sums of the slice for both hashes, its end, seeds' hashes)."""
        for first in range(0, len(words) - self.length + 1, BLOCK_WORDS):
            last = min(first + BLOCK_WORDS, len(words) - self.length + 1)
            skip = max(0, first - self.reach)
            part = words[skip:last + 2 * self.length]
            sums = self._sums(part, 0), self._sums(part, 1)
            at = np.arange(first - skip, last - skip + self.reach)
            seeds = self._stretch(sums[0], 0, at, at + self.seed)
            least = np.lib.stride_tricks.sliding_window_view(seeds, self.reach + 1).argmin(axis=1)
            yield first, first + np.arange(last - first) + least, skip, sums, len(part), seeds

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, hash, hash of the surroundings) of every anchor, in order."""
        found = []
        for first, chosen, skip, sums, size, seeds in self.blocks(words):
            places = np.unique(chosen)
            begin = np.maximum(places - self.reach - skip, 0)
            end = np.minimum(places + self.length - skip, size)
            around = self._stretch(sums[1], 1, begin, end)
            # how far the text reaches to the left belongs to it, too
            around = mix(around + (places - skip - begin).astype(np.uint64))
            found.append((places, seeds[places - first], around))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        places, seeds, around = (np.concatenate(c) for c in zip(*found))
        places, once = np.unique(places, return_index=True)
        return places, seeds[once], around[once]

    def windows(self, words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, hash of its seed, its own hash) of the windows that selected
        one of ``places``."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for first, chosen, skip, sums, _, seeds in self.blocks(words):
            own = np.flatnonzero(np.isin(chosen, places))
            begin = own + first - skip
            found.append((own + first, seeds[chosen[own] - first], self._stretch(sums[1], 1, begin, begin + self.length)))
        return tuple(np.concatenate(c) for c in zip(*found))


def keyed(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``row``, ``text`` and two hashes of the whole text."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), text.alias("text"),
                       F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(35), text, F.lit(12)).alias("k2"))


def anchor_table(texts: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(k1, k2, places, seeds, around): the anchors of every text with a window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, finder = Shingler(), Anchors(length, seed)
        for b in small_batches(batches):
            found = [finder.anchors(word_hashes(shingler, t)) for t in b.column(0).cast(pa.binary()).to_pylist()]
            has = np.flatnonzero([len(x[0]) for x in found])
            columns = [pa.array([found[k][0].astype(np.int32) for k in has], pa.list_(pa.int32())),
                       *(pa.array([found[k][c].view(np.int64) for k in has], pa.list_(pa.int64())) for c in (1, 2))]
            keys = [b.column(c).take(pa.array(has)) for c in (1, 2)]
            yield pa.RecordBatch.from_arrays([*keys, *columns], [*KEY, "places", "seeds", "around"])

    return map_arrow(texts.where("text IS NOT NULL").select("text", *KEY), run,
                     "k1 bigint, k2 bigint, places array<int>, seeds array<bigint>, around array<bigint>")


def window_table(texts: DataFrame, wanted: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(k1, k2, copied, window, seed, hash): windows of the texts that selected
    one of the places in ``wanted`` (k1, k2, copied, places)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, finder = Shingler(), Anchors(length, seed)
        for b in small_batches(batches, rows=128):
            texts, k1, k2, copied, places = (c.to_pylist() for c in (b.column(0).cast(pa.binary()), *b.columns[1:]))
            found = [finder.windows(word_hashes(shingler, t), np.array(p)) for t, p in zip(texts, places)]
            sizes = [len(x[0]) for x in found]
            at, seeds, own = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(c), sizes)) for c in (k1, k2, copied)]
                + [pa.array(at.astype(np.int32)), pa.array(seeds.view(np.int64)), pa.array(own.view(np.int64))],
                [*KEY, "copied", "window", "seed", "hash"])

    joined = texts.where("text IS NOT NULL").join(wanted, KEY).select("text", *KEY, "copied", "places")
    return map_arrow(joined, run, "k1 bigint, k2 bigint, copied boolean, window int, seed bigint, hash bigint")


def _merged(parts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, copied, spans): the stretches of each text put together."""
    held = parts.groupBy(*KEY).agg(F.max("copied").alias("copied"), F.collect_set(F.struct("begin", "end")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            out = []
            for parts in b.column(3).to_pylist():
                pairs = np.array(sorted((max(0, x["begin"]), x["end"]) for x in parts if x["begin"] is not None), np.int64).reshape(-1, 2)
                reach = np.maximum.accumulate(pairs[:, 1]) if len(pairs) else pairs[:, 1]
                opens = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1])) if len(pairs) else np.zeros(0, np.int64)
                ends = reach[np.append(opens[1:] - 1, len(pairs) - 1)] if len(pairs) else reach
                out.append([{"begin": x, "end": y} for x, y in zip(pairs[opens, 0].tolist(), ends.tolist())])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, kind)], [*KEY, "copied", "spans"])

    return map_arrow(held, run, "k1 bigint, k2 bigint, copied boolean, spans array<struct<begin:int,end:int>>")


def repeats(texts: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(k1, k2, copied, spans) of the texts that hold repeats: the maximal ones,
    as stretches of word numbers, or ``copied``: all of it. The end of a span may lie
    beyond the end of its text."""
    found = store(anchor_table(texts, length, seed), "repeat-anchors")
    # equal texts have equal anchors: one row for all of them
    once = store(found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("places", "seeds", "around"))),
                 "repeat-texts")
    own = once.select(*KEY, (F.col("n") > 1).alias("copied"), F.inline(F.arrays_zip("places", "seeds", "around")))
    own = own.toDF(*KEY, "copied", "place", "seed", "around")
    shared = store(own.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("least"), F.max("around").alias("most"))
                   .where("n > 1").select("seed", (F.col("least") == F.col("most")).alias("alike")), "repeat-seeds")
    joined = own.join(shared.hint("merge"), "seed")
    joined = store(joined.select(*KEY, "copied", "place", "alike"), "repeat-joined")
    # extended over the whole surroundings at once
    reach = length - seed
    whole = joined.where("alike AND NOT copied").select(*KEY, "copied", (F.col("place") - reach).alias("begin"),
                                                        (F.col("place") + length).alias("end"))
    # extended window by window
    wanted = store(joined.where("NOT alike").groupBy(*KEY).agg(F.max("copied").alias("copied"), F.sort_array(F.collect_list("place")).alias("places")),
                   "repeat-wanted")
    windows = store(window_table(texts, wanted.hint("merge"), length, seed), "repeat-windows")
    # copies of a text give the same rows: they are one place
    place = F.struct(*KEY, "window")
    met = store(windows.groupBy("seed", "hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                .where("first <> last").select("seed", "hash"), "repeat-met")
    again = windows.where("NOT copied").join(met.hint("merge"), ["seed", "hash"])
    single = again.select(*KEY, "copied", F.col("window").alias("begin"), (F.col("window") + length).alias("end"))
    none = F.lit(None).cast("int")
    copies = once.where("n > 1").select(*KEY, F.lit(True).alias("copied"), none.alias("begin"), none.alias("end"))
    return _merged(whole.unionByName(single).unionByName(copies), length)


def remove(docs: DataFrame, length: int = LENGTH, seed: int = SEED, text_col: str = "text",
           keep: list[str] | None = None) -> DataFrame:
    """``row``, ``n_words``, ``n_removed``, ``spans`` (the maximal repeats) and
    ``kept``: the words outside of them, joined by one space."""
    texts = keyed(docs, text_col, docs.columns if keep is None else keep)
    spans = store(repeats(texts, length, seed), "repeat-spans")
    joined = texts.join(spans.hint("merge"), KEY, "left").select("row", "text", "copied", "spans")
    schema = StructType([joined.schema["row"], *StructType.fromDDL(
        "n_words bigint, n_removed bigint, spans array<struct<begin:int,end:int>>, kept string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.string()]
        for b in small_batches(batches):
            out = []
            for text, copied, own in zip(*(c.to_pylist() for c in b.columns[1:])):
                words = words_of(text or "")
                n = len(words)
                own = [{"begin": 0, "end": n}] if copied else [{"begin": x["begin"], "end": min(n, x["end"])} for x in own or ()]
                left, at = [], 0
                for x in own:
                    left += words[at:x["begin"]]
                    at = x["end"]
                left += words[at:]
                out.append((n, n - len(left), own, " ".join(left)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip(zip(*out), kinds))], schema.names)

    return map_arrow(joined, run, schema)
