"""Token ids in files: documents encoded with a tokenizer file of the
tokenizers library and stored in ascending id order, coded by ``idcoder``.

``write_tokens`` range-partitions the documents by id, encodes each partition
in order and writes segments: runs of whole documents with at most
``segment_ids`` ids (a longer document is a segment of its own). A segment is
one row: shard and segment number, the documents' ids and id counts, and the
coded ids. Rows are kept in a table of files written by Spark, so any store
that Spark writes will do, and a lost task is simply run again.

``read_tokens`` decodes segments, checks every block's checksum and returns one
row per document with its ids and its start: the number of ids before it in the
whole corpus, from a sum over the shards and one over each shard's segments.

Ids come from the distinct pieces of each batch (``piecewise``); one encoder
serves all tasks of a worker, and it starts no threads of its own. Texts that
hold the string of an added token are encoded whole.

Null text: the empty text (only the end id). Null ids sort first, repeated
rows stay rows of their own, in any order among themselves. An empty table gives
no segments and no rows. A very long text is a segment of its own, coded like any
other. Other columns of the input do not pass and cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tridelta.session import broadcast_if_small, scratch_path

from . import idcoder
from .common import map_arrow, per_worker, small_batches
from .piecewise import PieceEncoder, byte_level

SEGMENT_IDS = 2 << 20
ENCODED_BYTES = 12 << 20  # texts encoded at once: the more, the fewer pieces are looked up again


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ENCODED_BYTES."""
    held, size = [], 0
    for b in small_batches(batches, rows=4096, byte_limit=4 << 20):
        if held and size + b.nbytes > ENCODED_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.concat_batches(held)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", segment_ids: int = SEGMENT_IDS, partitions: int | None = None,
                 segments_per_file: int = 8) -> None:
    kind = docs.schema[id_col].dataType.simpleString()
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def segment(number: int, doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(x) for x in ids]
        coded = idcoder.encode(np.concatenate(ids))
        return pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([number], pa.int32()),
             pa.array([doc_ids], pa.list_(doc_ids_type)), pa.array([sizes], pa.list_(pa.int64())),
             pa.array([sum(sizes)], pa.int64()), pa.array([coded], pa.binary())],
            ["shard", "segment", "doc_ids", "sizes", "n_ids", "coded"])

    from pyspark.sql.pandas.types import to_arrow_type

    doc_ids_type = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("tokens", tokenizer_path), lambda: PieceEncoder([byte_level(tokenizer_path, specials=True)[0]]))
        doc_ids, ids, held, number = [], [], 0, 0
        for b in _gathered(batches):
            for doc_id, own in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).fill_null(""))[0]):
                own = np.append(own, np.uint32(end_id))
                if ids and held + len(own) > segment_ids:
                    yield segment(number, doc_ids, ids)
                    doc_ids, ids, held, number = [], [], 0, number + 1
                doc_ids.append(doc_id)
                ids.append(own)
                held += len(own)
        if ids:
            yield segment(number, doc_ids, ids)

    # the running number only parts rows of equal id, so no partition is forced to hold them all
    rows = docs.select(F.col(id_col), F.col(text_col), F.monotonically_increasing_id().alias("tie"))
    ordered = rows.repartitionByRange(n, id_col, "tie").sortWithinPartitions(id_col, "tie").select(id_col, text_col)
    schema = f"shard int, segment int, doc_ids array<{kind}>, sizes array<bigint>, n_ids bigint, coded binary"
    (map_arrow(ordered, run, schema).write.option("maxRecordsPerFile", segments_per_file).parquet(path))


def segment_starts(segments: DataFrame) -> DataFrame:
    """shard, segment, start: ids before each segment. The sum over shards runs
    over one row per shard, that within a shard over its segments."""
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("shard_start"))
    inner = W.partitionBy("shard").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    own = segments.select("shard", "segment", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("inner_start"))
    return own.join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("inner_start")).alias("base"))


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32, ids): one row per document; ``ids``
    (little-endian unsigned 32-bit integers) only with ``with_ids``."""
    table = spark.read.parquet(path)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["shard", "segment", id_col, "ahead", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = f"shard int, segment int, `{id_col}` {kind}, ahead bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                shard, segment, doc_ids, sizes, coded = (c[k] for c in b.columns)
                sizes = np.array(sizes.as_py(), dtype=np.int64)
                ends = np.cumsum(sizes)
                raw = idcoder.decode(coded.as_py()).astype("<u4")
                if len(raw) != ends[-1]:
                    raise ValueError("a segment's documents and ids differ in number")
                for a in range(0, len(sizes), 1024):
                    own = [raw[e - n:e] for e, n in zip(ends[a:a + 1024].tolist(), sizes[a:a + 1024].tolist())]
                    m = len(own)
                    arrays = [pa.array([shard.as_py()] * m, pa.int32()), pa.array([segment.as_py()] * m, pa.int32()),
                              doc_ids.values[a:a + m], pa.array((ends - sizes)[a:a + m]), pa.array(sizes[a:a + m]),
                              pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    if with_ids:
                        arrays.append(pa.array([x.tobytes() for x in own], pa.binary()))
                    yield pa.RecordBatch.from_arrays(arrays, names)

    rows = map_arrow(table.select("shard", "segment", "doc_ids", "sizes", "coded"), run, schema)
    segments = table.select("shard", "segment", "n_ids")
    bases = broadcast_if_small(segment_starts(segments), segments.count(), 64)
    joined = rows.join(bases, ["shard", "segment"])
    return joined.select(id_col, (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32",
                         *(["ids"] if with_ids else []))


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None,
               with_ids: bool = False, **columns) -> DataFrame:
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, **columns)
    return read_tokens(spark, path, columns.get("id_col", "doc_id"), with_ids)
