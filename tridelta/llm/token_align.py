"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers see a space and the text (a sentencepiece model adds that space
itself). A document's tokens are cut into groups at the byte offsets where a
token of either side ends; a link is a pair of tokens, one of each side, whose
byte ranges overlap.

Groups are found by diagonal run skipping. At a place where both sides have just
ended, the two arrays of end offsets are compared at the current index shift:
a stretch of one-to-one tokens is a stretch on which they agree, and its length
is probed at exponentially growing, then shrinking steps; a running sum of mixed
offsets on each side compares a whole step at once. Where they differ, the side
that lags is advanced until both end together again: that is an irregular group,
and the shift is updated by it. Runs found by sums are checked offset by offset
afterwards. Many stretches of text advance side by side, as numpy vectors: texts
are cut at spaces between two characters that are not white space, where both
tokenizers always end a token (the models are checked for that).

Corpus counts of linked id pairs need two steps. The first, a map, writes one row
per block of documents: its distinct pairs with their counts, and each
document's pairs as places in that list. Counts are summed over blocks; every
block's pairs are joined with the sums; and a second map adds them up per
document. So a pair travels once per block that holds it, however often.

Texts that are null or empty, or whose joined tokens differ from space + text in
bytes on either side (a text that holds the sentencepiece space sign, say), have
no tokens: zeros and an empty digest. Special tokens' strings within texts are plain text.
Very long texts are taken in pieces, and only distinct pairs are kept of each.
Repeated rows count as often as they stand; null ids pass; an empty table gives an
empty one. All columns asked for come back in one struct ``row``: no name can clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .bpe_rank import safe_pieces
from .common import map_arrow, per_worker, small_batches, store
from .piecewise import Model, PieceEncoder, byte_level
from .shingles import mix

PIECE_CHARS = 1024
GROUP_BYTES = 1 << 20
SPACE_SIGN = "▁"
B_BITS = 32


# ---------------------------------------------------------------- the two sides

def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable
    Latin-1 bytes are themselves, the others follow from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevelSide:
    """A byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        self.model, vocab = byte_level(path, specials=False)
        of = byte_alphabet()
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.bytes_of[k] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()


class PieceSide:
    """A sentencepiece model, which puts a space in front of what it encodes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        if any(re.search(f"[^{SPACE_SIGN}]{SPACE_SIGN}", p) for p in names):
            raise ValueError("the model has pieces that reach over a space: texts cannot be cut there")
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if model.is_byte(k) else p.replace(SPACE_SIGN, " ").encode()
                         for k, p in enumerate(names)]
        self.model = Model(lambda texts: model.encode([t[1:] for t in texts], num_threads=1),
                           np.array([len(x) for x in self.bytes_of], np.int64), re.compile(SPACE_SIGN))


# ---------------------------------------------------------------- the alignment

def diagonal_groups(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray,
                    starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of either side, whether a group ends with it.

    ``ends_*``: rising byte offsets; lane ``k`` begins with token ``starts_a[k]``
    and ``starts_b[k]``, and ends where the next begins (with a common end)."""
    n_a, n_b = len(ends_a), len(ends_b)
    sum_a, sum_b = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(e.astype(np.uint64)), dtype=np.uint64)])
                    for e in (ends_a, ends_b))
    stop_a, stop_b = np.append(starts_a[1:], n_a), np.append(starts_b[1:], n_b)
    i, j = starts_a.astype(np.int64), starts_b.astype(np.int64)
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    closed: list[tuple[np.ndarray, np.ndarray]] = []
    live = np.flatnonzero(i < stop_a)
    i, j, stop_a, stop_b = i[live], j[live], stop_a[live], stop_b[live]
    while len(i):
        # how far the ends agree at the shift j - i
        room = np.minimum(stop_a - i, stop_b - j)
        base = sum_b[j] - sum_a[i]
        run, step = np.zeros(len(i), np.int64), np.ones(len(i), np.int64)
        grow = np.arange(len(i))
        while len(grow):
            to = run[grow] + step[grow]
            fits = to <= room[grow]
            to = np.minimum(to, room[grow])
            good = fits & (sum_b[j[grow] + to] - sum_a[i[grow] + to] == base[grow])
            grow, to = grow[good], to[good]
            run[grow] = to
            step[grow] <<= 1
        step >>= 1
        shrink = np.flatnonzero(step)
        while len(shrink):
            to = run[shrink] + step[shrink]
            fits = to <= room[shrink]
            to = np.minimum(to, room[shrink])
            good = fits & (sum_b[j[shrink] + to] - sum_a[i[shrink] + to] == base[shrink])
            run[shrink[good]] = to[good]
            step[shrink] >>= 1
            shrink = shrink[step[shrink] > 0]
        some = run > 0
        runs.append((i[some], j[some], run[some]))
        i, j = i + run, j + run
        live = i < stop_a
        i, j, stop_a, stop_b = i[live], j[live], stop_a[live], stop_b[live]
        # an irregular group: the side that lags goes on until both end together
        x, y = i.copy(), j.copy()
        behind = np.arange(len(x))
        while len(behind):
            end_a, end_b = ends_a[x[behind]], ends_b[y[behind]]
            x[behind] += end_a < end_b
            y[behind] += end_b < end_a
            behind = behind[end_a != end_b]
        closed.append((x, y))
        i, j = x + 1, y + 1
        live = i < stop_a
        i, j, stop_a, stop_b = i[live], j[live], stop_a[live], stop_b[live]
    from_a, from_b, length = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*runs) if runs else ([], [], [])))
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    on_a, on_b = np.repeat(from_a, length) + within, np.repeat(from_b, length) + within
    if not np.array_equal(ends_a[on_a], ends_b[on_b]):  # two sums met by chance
        return np.isin(ends_a, ends_b), np.isin(ends_b, ends_a)
    last_a, last_b = np.zeros(n_a, bool), np.zeros(n_b, bool)
    last_a[on_a] = last_b[on_b] = True
    for x, y in closed:
        last_a[x] = last_b[y] = True
    return last_a, last_b


def link_places(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of A, token of B) of every link, in no particular order. A link is
    a stretch of bytes between two neighbouring ends of either side."""
    close_a, close_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
    single = (np.diff(close_a, prepend=-1) == 1) & (np.diff(close_b, prepend=-1) == 1)
    odd_a, odd_b = np.ones(len(ends_a), bool), np.ones(len(ends_b), bool)
    odd_a[close_a[single]] = odd_b[close_b[single]] = False
    a, b = np.flatnonzero(odd_a), np.flatnonzero(odd_b)
    inner_b = b[~last_b[b]]
    over_a = b[np.searchsorted(ends_b[b], ends_a[a])] if len(a) else a
    over_b = a[np.searchsorted(ends_a[a], ends_b[inner_b])] if len(inner_b) else inner_b
    return np.concatenate([close_a[single], a, over_b]), np.concatenate([close_b[single], over_a, inner_b])


class Aligner:
    """Both tokenizers and what is worked out from their vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = ByteLevelSide(path_a), PieceSide(path_b)
        self.encoder = PieceEncoder([s.model for s in self.sides], lead=True)
        self.sizes = [np.array([len(x) for x in s.bytes_of], np.int64) for s in self.sides]
        # decimal ids with what follows them: another of the same side, or the end of the group's side
        signs = [f"{k}{sign}" for s, end in zip(self.sides, "|;") for k in range(len(s.bytes_of)) for sign in (",", end)]
        self.signs = np.array(signs, dtype="S")
        self.base_b = 2 * len(self.sides[0].bytes_of)

    def _tokens(self, pieces: list[str]) -> tuple[list, list[bool]]:
        """Ids of either side, and whether a piece's tokens give its bytes."""
        raw = [p.encode() for p in pieces]
        found = self.encoder.encode([p[1:] for p in pieces])
        right = [True] * len(pieces)
        for side, ids in zip(self.sides, found):
            get = side.bytes_of.__getitem__
            right = [ok and b"".join(map(get, own.tolist())) == text for ok, own, text in zip(right, ids, raw)]
        return found, right

    def groups_of(self, texts: list[str | None]) -> Iterator[tuple]:
        """Groups of pieces: (document of each piece, ids of A, of B, whether a
        group ends with each token of A, of B, their end offsets, the first
        token of each piece and the number of all, documents left out because
        their tokens differ from their bytes)."""
        held: list[tuple[int, str]] = []
        size = 0
        for doc, text in enumerate(texts):
            if not text:
                continue
            for piece in safe_pieces(" " + text, PIECE_CHARS):
                held.append((doc, piece))
                size += len(piece)
                if size >= GROUP_BYTES:
                    yield self._group(held)
                    held, size = [], 0
        if held:
            yield self._group(held)

    def _group(self, held: list[tuple[int, str]]) -> tuple:
        (a, b), right = self._tokens([p for _, p in held])
        wrong = {doc for (doc, _), ok in zip(held, right) if not ok}
        fine = [k for k, (doc, _) in enumerate(held) if doc not in wrong]
        docs = np.array([held[k][0] for k in fine], np.int64)
        ids, ends, firsts = [], [], []
        for own, sizes in zip((a, b), self.sizes):
            own = [own[k] for k in fine]
            counts = np.array([len(x) for x in own], np.int64)
            flat = np.concatenate([np.zeros(0, np.int64), *own]).astype(np.int64)
            ids.append(flat)
            ends.append(np.cumsum(sizes[flat]))
            firsts.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
        last = diagonal_groups(*ends, firsts[0][:-1], firsts[1][:-1])
        return docs, *ids, *last, *ends, *firsts, wrong

    def spelt(self, ids_a, ids_b, last_a, last_b) -> np.ndarray:
        """The tokens of both sides in the order of groups, each as a fixed-width
        decimal id and the sign after it."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        ends_a = np.flatnonzero(last_a) + 1
        before_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        out[np.arange(len(ids_a)) + before_b[group_a]] = 2 * ids_a + last_a
        out[np.arange(len(ids_b)) + ends_a[group_b]] = self.base_b + 2 * ids_b + last_b
        return self.signs[out]


class Block:
    """Sums over the documents of one block."""

    def __init__(self, n: int):
        self.n_a, self.n_b, self.n_groups = (np.zeros(n, np.int64) for _ in range(3))
        self.hashes: list = [None] * n
        self.wrong: set[int] = set()
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, aligner: Aligner, docs, ids_a, ids_b, last_a, last_b, ends_a, ends_b, first_a, first_b, wrong) -> None:
        self.wrong |= wrong
        if not len(docs):
            return
        n = len(self.n_a)
        self.n_a += np.bincount(docs, np.diff(first_a), n).astype(np.int64)
        self.n_b += np.bincount(docs, np.diff(first_b), n).astype(np.int64)
        doc_of = np.repeat(docs, np.diff(first_a))
        self.n_groups += np.bincount(doc_of[last_a], minlength=n)
        spelt = aligner.spelt(ids_a, ids_b, last_a, last_b)
        turns = np.flatnonzero(np.diff(docs, prepend=-1))
        cuts = (first_a + first_b)[np.append(turns, len(docs))].tolist()
        for doc, a, b in zip(docs[turns].tolist(), cuts[:-1], cuts[1:]):
            own = spelt[a:b].tobytes().translate(None, b"\0")[:-1]
            if self.hashes[doc] is None:
                self.hashes[doc] = hashlib.sha256(own)
            else:  # a text of several groups of pieces
                self.hashes[doc].update(b";" + own)
        at_a, at_b = link_places(ends_a, ends_b, last_a, last_b)
        pairs, place = np.unique((ids_a[at_a] << B_BITS) | ids_b[at_b], return_inverse=True)
        both, times = np.unique(doc_of[at_a] * len(pairs) + place, return_counts=True)
        self.links.append((both // len(pairs), pairs[both % len(pairs)], times))

    def columns(self) -> tuple:
        """n_a, n_b, n_groups, digests, distinct pairs, their counts, and the
        documents' pairs as compressed places and counts."""
        bad = np.array(sorted(self.wrong), np.int64)
        docs, pairs, times = (np.concatenate(c) for c in zip(*self.links)) if self.links else (np.zeros(0, np.int64),) * 3
        if len(bad):
            fine = ~np.isin(docs, bad)
            docs, pairs, times = docs[fine], pairs[fine], times[fine]
            for c in (self.n_a, self.n_b, self.n_groups):
                c[bad] = 0
            for doc in self.wrong:
                self.hashes[doc] = None
        order = np.argsort(docs, kind="stable")
        docs, pairs, times = docs[order], pairs[order], times[order]
        known, place = np.unique(pairs, return_inverse=True)
        counts = np.bincount(place, times, len(known)).astype(np.int64)
        entries = np.bincount(docs, minlength=len(self.n_a))
        packed = zlib.compress(np.concatenate([entries, place, times]).astype("<u4").tobytes(), 1)
        digests = ["" if h is None else h.hexdigest() for h in self.hashes]
        return self.n_a, self.n_b, self.n_groups, digests, known, counts, packed


# ---------------------------------------------------------------- Spark side

def _source(docs: DataFrame, text_col: str, keep: list[str] | None) -> DataFrame:
    keep = docs.columns if keep is None else keep
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text_col}`").alias("text"))


def _aligner(path_a: str, path_b: str) -> Aligner:
    return per_worker(("align", path_a, path_b), lambda: Aligner(path_a, path_b))


def groups(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row``, ``ids_a``, ``ids_b`` and how many tokens of either side each
    group has (``group_a``, ``group_b``): the alignment itself."""
    src = _source(docs, text_col, keep)
    names = ["ids_a", "ids_b", "group_a", "group_b"]
    schema = StructType([src.schema["row"], *StructType.fromDDL(", ".join(f"{n} array<int>" for n in names)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for b in small_batches(batches, rows=128, byte_limit=2 << 20):
            parts: list[list] = [[] for _ in range(b.num_rows)]
            wrong: set[int] = set()
            for docs_, ids_a, ids_b, last_a, last_b, _, _, first_a, first_b, bad in aligner.groups_of(b.column(1).to_pylist()):
                wrong |= bad
                for k, doc in enumerate(docs_.tolist()):
                    own_a, own_b = slice(first_a[k], first_a[k + 1]), slice(first_b[k], first_b[k + 1])
                    parts[doc].append((ids_a[own_a], ids_b[own_b], *(np.diff(np.flatnonzero(x), prepend=-1) for x in (last_a[own_a], last_b[own_b]))))
            rows = [[] if doc in wrong else own for doc, own in enumerate(parts)]
            columns = [pa.array([np.concatenate([x[c] for x in own]).astype(np.int32) if own else [] for own in rows], pa.list_(pa.int32()))
                       for c in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["row", *names])

    return map_arrow(src, run, schema)


def blocks(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per block of documents, as the module's text says."""
    src = _source(docs, text_col, keep)
    schema = StructType.fromDDL("part int, block int, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
                                "digests array<string>, pairs array<bigint>, counts array<bigint>, packed binary")
    schema = schema.add("rows", ArrayType(src.schema["row"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        whole = pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int32(), whole, whole, whole, pa.list_(pa.string()), whole, whole, pa.binary()]
        part = TaskContext.get().partitionId()
        for number, b in enumerate(small_batches(batches, byte_limit=4 << 20)):
            block = Block(b.num_rows)
            for found in aligner.groups_of(b.column(1).to_pylist()):
                block.add(aligner, *found)
            values = [part, number, *block.columns()]
            rows = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(values, kinds)), rows], schema.names)

    return map_arrow(src, run, schema)


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each id pair, and
    whether no other pair of its B id has more."""
    own = table.select(F.inline(F.arrays_zip("pairs", "counts"))).toDF("pair", "n")
    sums = own.groupBy("pair").agg(F.sum("n").alias("n"))
    # a window holds the pairs of one id of B: as many as A has ids, at most
    of_b = W.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)))
    return sums.select("pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("best"))


def link_table(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """(id_a, id_b, n, best): the corpus counts of linked id pairs."""
    table = store(blocks(docs, path_a, path_b, text_col, keep=[text_col]).select("pairs", "counts"), "align-pairs")
    return pair_counts(table).select(F.shiftright("pair", B_BITS).alias("id_a"),
                                     F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("id_b"), "n", "best")


def measure(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links
    that are their B id's most frequent one), ``count_sum`` (corpus counts over
    links) and ``groups_sha256`` of every document."""
    table = store(blocks(docs, path_a, path_b, text_col, keep), "align-blocks")
    counts = store(pair_counts(table), "align-counts")
    own = table.select("part", "block", F.posexplode("pairs").alias("place", "pair"))
    told = own.join(counts, "pair").groupBy("part", "block").agg(
        F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("told"))
    both = table.select("part", "block", "n_a", "n_b", "n_groups", "digests", "packed", "rows") \
        .join(told, ["part", "block"], "left") \
        .select("n_a", "n_b", "n_groups", "digests", "packed", F.col("told.n").alias("ns"), F.col("told.best").alias("bests"), "rows")
    row = table.schema["rows"].dataType.elementType
    names = ["row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = StructType().add("row", row)
    for n in names[1:]:
        schema = schema.add(n, "string" if n == "groups_sha256" else "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                n_a, n_b, n_groups, digests, packed, ns, bests, rows = (c.slice(k, 1) for c in b.columns)
                n_a, n_b, n_groups, digests, rows = (c.flatten() for c in (n_a, n_b, n_groups, digests, rows))
                ns = ns.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                bests = bests.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = np.frombuffer(zlib.decompress(packed[0].as_py()), "<u4").astype(np.int64)
                entries, rest = flat[:len(n_a)], flat[len(n_a):]
                place, times = rest[:len(rest) // 2], rest[len(rest) // 2:]
                at = np.concatenate([[0], np.cumsum(entries)])
                sums = []
                for value in (np.ones(len(ns), np.int64), bests, ns):
                    run_sums = np.concatenate([[0], np.cumsum(value[place] * times)])
                    sums.append(pa.array(run_sums[at[1:]] - run_sums[at[:-1]]))
                yield pa.RecordBatch.from_arrays([rows, n_a, n_b, n_groups, *sums, digests], names)

    return map_arrow(both, run, schema)
