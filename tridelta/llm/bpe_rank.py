"""Byte-level BPE encoding and decoding with the tiktoken library and a rank file.

``encode`` gives each row's ids as little-endian unsigned 32-bit integers
(the form in which ids are stored), ``decode`` turns them back into raw bytes.
Both are maps without a shuffle; texts never leave their partition.

Long texts are cut where the split pattern cannot match across: at a space
between two characters that are not white space. Every alternative of the
pattern takes a space only as its first character or within a run of white
space, so a match always ends before such a space and the next starts with
it, and the pieces encode to the same ids as the whole text. Where a stretch of
several times that length has no such place (a run of white space, mostly, at
which the library's own matcher runs out of stack), the pattern's matches are
found here instead and each is encoded on its own.

Null text: encodes as the empty text (no ids, no bytes). Null ids decode to
no bytes. Rows are kept as they are, repeated ones included, and an empty table
gives an empty one; other columns of the input do not pass and cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import map_arrow, per_worker, small_batches

SAFE_CUT = regex.compile(r"(?<=\S) (?=\S)")
CHUNK_CHARS = 32_768


def safe_pieces(text: str, chunk: int = CHUNK_CHARS) -> Iterator[str]:
    """Pieces of at least ``chunk`` characters that end at safe boundaries."""
    at = 0
    while len(text) - at > 2 * chunk:
        cut = SAFE_CUT.search(text, at + chunk)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode_text(enc, split: regex.Pattern, text: str, chunk: int = CHUNK_CHARS) -> list[int]:
    """Ids of a whole text of any length, by a tiktoken ``Encoding``."""
    ids: list[int] = []
    for piece in safe_pieces(text, chunk):
        if len(piece) <= 8 * chunk:
            ids.extend(enc.encode_ordinary(piece))
        else:
            for match in split.finditer(piece):
                ids.extend(enc._encode_single_piece(match.group().encode()))
    return ids


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens long, ids binary) for every row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc = per_worker(("ranks", rank_path, pattern), lambda: tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=load_ranks(rank_path), special_tokens={}))
        split = regex.compile(pattern)
        for b in small_batches(batches):
            counts, ids = [], []
            for text in b.column(1).to_pylist():
                own = encode_text(enc, split, text or "")
                counts.append(len(own))
                ids.append(np.array(own, dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], [id_col, "n_tokens", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, n_tokens bigint, ids binary")


def decode(df: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``df`` with the raw bytes of its ids in a new column ``decoded``; the
    bytes of a text may be cut anywhere, so they are not made into a string.
    An id without a token fails."""
    if "decoded" in df.columns:
        raise ValueError("the input has a column named decoded")
    schema = StructType([*df.schema.fields, StructField("decoded", BinaryType())])
    place = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_of = per_worker(("tokens", rank_path), lambda: {rank: token for token, rank in load_ranks(rank_path).items()})
        for b in small_batches(batches):
            out = [b"".join(map(token_of.__getitem__, np.frombuffer(x or b"", "<u4").tolist()))
                   for x in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return map_arrow(df, run, schema)
