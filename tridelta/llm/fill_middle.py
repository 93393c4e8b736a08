"""Fill-in-middle rewriting of whole texts over a learned index of their code
points.

A cut after ``k`` code points needs the byte at which the ``k``-th begins. The
index of a text maps ranks to those bytes: straight lines are fitted to all
boundary offsets, each line as long as no offset is more than MAX_ERROR bytes
off it, and what every offset lies off its line (one byte each, none where all
lie on it) is stored. An offset is predicted by its line and then corrected by
its residual, so every lookup is exact. Texts are read in blocks, twice: once to
fit the lines, once for the residuals, so that beside the text itself a worker
holds one byte a code point.

``build_index`` gives the index of each text as columns, ``cut_offsets`` looks
up bytes of any ranks in such a stored index without the text, and ``rewrite``
cuts, orders and marks the texts. ``restore`` is a column expression that takes
the text back out of output and form; it is exact, as texts that hold one of the
marks are left plain.

Cuts and forms follow from a hash of seed and id, so reruns agree. Null text: the
empty text, which stays plain; null id: hashed as the seed alone. Repeated rows
give equal rows, an empty table an empty one. Very long texts take lines and
residuals block by block, no more. All columns asked for come back in one
struct ``row``, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_arrow, small_batches

MAX_ERROR = 100
BLOCK_BYTES = 1 << 18
FIRST_REACH = 64
# Marks before the prefix, the suffix and the middle: fixed values.
MARKS = ("<P>", "<S>", "<M>")
INDEX_DDL = "n bigint, seg_rank array<bigint>, seg_offset array<bigint>, seg_slope array<double>, residuals binary"


def boundaries(data: bytes, block: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """Byte offsets of all code points and of the end, in blocks."""
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(raw), block):
        yield np.flatnonzero((raw[at:at + block] & 0xC0) != 0x80) + at
    yield np.array([len(raw)])


class RankIndex:
    """Lines over the ranks 0 to n: line ``k`` starts at (rank, offset) and
    rises by slope; ``residuals`` are offsets less predictions (int8), or empty
    where every prediction is right."""

    def __init__(self, ranks: np.ndarray, offsets: np.ndarray, slopes: np.ndarray, residuals: np.ndarray, n: int):
        self.ranks, self.offsets, self.slopes, self.residuals, self.n = ranks, offsets, slopes, residuals, n

    @classmethod
    def of(cls, data: bytes, max_error: int = MAX_ERROR, block: int = BLOCK_BYTES) -> RankIndex:
        if not 1 <= max_error <= 120:
            raise ValueError("residuals are kept in one byte: max_error must be 1 to 120")
        lines: list[tuple[int, int, float]] = []
        rank0 = offset0 = rank = 0
        low, high = -np.inf, np.inf
        for ys in boundaries(data, block):
            a, m, reach = 0, len(ys), FIRST_REACH
            if rank == 0:
                offset0, a = int(ys[0]), 1
            while a < m:
                part = ys[a:a + reach]
                run = np.arange(rank + a - rank0, rank + a - rank0 + len(part))
                rise = part - offset0
                highs = np.minimum(np.minimum.accumulate((rise + max_error) / run), high)
                lows = np.maximum(np.maximum.accumulate((rise - max_error) / run), low)
                wrong = highs < lows
                k = int(wrong.argmax()) if wrong.any() else len(part)
                if k:
                    low, high = float(lows[k - 1]), float(highs[k - 1])
                a += k
                reach *= 2
                if k < len(part):  # this offset starts the next line
                    lines.append((rank0, offset0, cls._slope(low, high)))
                    rank0, offset0, low, high = rank + a, int(ys[a]), -np.inf, np.inf
                    a, reach = a + 1, FIRST_REACH
            rank += m
        lines.append((rank0, offset0, cls._slope(low, high)))
        ranks, offsets, slopes = (np.array(c, dtype=t) for c, t in zip(zip(*lines), (np.int64, np.int64, np.float64)))
        index = cls(ranks, offsets, slopes, np.zeros(0, np.int8), rank - 1)
        residuals, at = np.zeros(rank, np.int8), 0
        for ys in boundaries(data, block):
            residuals[at:at + len(ys)] = ys - index.predict(np.arange(at, at + len(ys)))
            at += len(ys)
        if residuals.any():
            index.residuals = residuals
        return index

    @staticmethod
    def _slope(low: float, high: float) -> float:
        return (low + high) / 2 if high < np.inf else 0.0

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        line = np.searchsorted(self.ranks, ranks, side="right") - 1
        return self.offsets[line] + np.rint(self.slopes[line] * (ranks - self.ranks[line])).astype(np.int64)

    def offset(self, ranks) -> np.ndarray:
        """The byte at which each rank begins."""
        ranks = np.asarray(ranks, dtype=np.int64)
        found = self.predict(ranks)
        return found + self.residuals[ranks] if len(self.residuals) else found


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _rows(df: DataFrame, text_col: str, keep: list[str] | None, *extra: Column) -> DataFrame:
    keep = df.columns if keep is None else keep
    return df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text_col}`").alias("text"), *extra)


def build_index(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                max_error: int = MAX_ERROR) -> DataFrame:
    """``row`` and the index of each text (INDEX_DDL)."""
    src = _rows(docs, text_col, keep)
    schema = StructType([src.schema["row"], *StructType.fromDDL(INDEX_DDL).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            made = [RankIndex.of(t, max_error) for t in _texts(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x.n for x in made], pa.int64()),
                 pa.array([x.ranks for x in made], pa.list_(pa.int64())), pa.array([x.offsets for x in made], pa.list_(pa.int64())),
                 pa.array([x.slopes for x in made], pa.list_(pa.float64())), pa.array([x.residuals.tobytes() for x in made], pa.binary())],
                ["row", "n", "seg_rank", "seg_offset", "seg_slope", "residuals"])

    return map_arrow(src, run, schema)


def cut_offsets(index: DataFrame, ranks_col: str, keep: list[str]) -> DataFrame:
    """``row`` and ``offsets``: the bytes of the ranks in the array column
    ``ranks_col``, from stored indexes alone. A rank beyond the text fails."""
    src = index.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(ranks_col).alias("wanted"),
                       "n", "seg_rank", "seg_offset", "seg_slope", "residuals")
    schema = StructType([src.schema["row"], *StructType.fromDDL("offsets array<bigint>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = []
            for wanted, n, *lines, residuals in zip(*(c.to_pylist() for c in b.columns[1:])):
                found = RankIndex(*(np.array(x) for x in lines), np.frombuffer(residuals, np.int8), n)
                if wanted and not 0 <= min(wanted) <= max(wanted) <= n:
                    raise ValueError(f"a cut lies beyond the text's {n} code points")
                out.append(None if wanted is None else found.offset(wanted))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["row", "offsets"])

    return map_arrow(src, run, schema)


def check_marks(marks: tuple[str, str, str]) -> None:
    """No mark may arise where a text meets a mark: then a text without marks
    can be taken out of the output again."""
    for s in marks:
        for t in marks:
            if not s or any(t.endswith(s[:k]) for k in range(1, min(len(s), len(t)))) or (s != t and s in t):
                raise ValueError(f"the marks {marks} can overlap")
    if len(set(marks)) < 3:
        raise ValueError("three different marks are needed")


def draws(seed: int, id_col: str) -> list[Column]:
    """Four numbers below 2 ** 32 from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def rewrite(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20,
            marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text",
            keep: list[str] | None = None, max_error: int = MAX_ERROR) -> DataFrame:
    """``row``, ``n`` (code points), ``form`` (plain, psm, spm), ``prefix_chars``,
    ``middle_chars`` (null if plain) and ``output``. ``plain_percent`` of the
    texts stay as they are, ``spm_percent`` of the others start with the suffix."""
    check_marks(marks)
    signs = [m.encode() for m in marks]
    src = _rows(docs, text_col, keep, *draws(seed, id_col))
    schema = StructType([src.schema["row"], *StructType.fromDDL(
        "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").fields])

    def one(text: bytes, h1: int, h2: int, h3: int, h4: int):
        index = RankIndex.of(text, max_error)
        if not text or h3 % 100 >= 100 - plain_percent or any(s in text for s in signs):
            return index.n, "plain", None, None, text
        first, second = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
        a, b = index.offset([first, second]).tolist()
        prefix, suffix, middle = signs[0] + text[:a], signs[1] + text[b:], signs[2] + text[a:b]
        spm = h4 % 100 < spm_percent
        whole = suffix + prefix + middle if spm else prefix + suffix + middle
        return index.n, "spm" if spm else "psm", first, second - first, whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            made = list(zip(*map(one, _texts(b.column(1)), *(c.to_pylist() for c in b.columns[2:]))))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            n, form, prefix, middle, output = (pa.array(v, k) for v, k in zip(made, kinds))
            yield pa.RecordBatch.from_arrays([b.column(0), n, form, prefix, middle, output.cast(pa.string())],
                                             ["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_arrow(src, run, schema)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that was rewritten, from output and form alone."""
    quoted = "|".join("\\Q" + m + "\\E" for m in marks)
    part = F.split(output, quoted, 4)
    in_order = F.when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(in_order)
