"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tridelta.session import stash

# Words of every operator on documents: maximal runs of characters other than
# ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_WORDS = re.compile(WORD_RE)
# what str.split() takes for white space beyond the six ASCII characters
_OTHER_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def words_of(text: str) -> list[str]:
    """Words of a text (``str.split`` is faster, where it splits the same)."""
    return _WORDS.findall(text) if _OTHER_SPACE.search(text) else text.split()


ROWS_PER_BATCH = 1000


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with at most ROWS_PER_BATCH rows to a batch: with
    Spark's default of ten thousand, a batch of documents takes tens of MB in
    the JVM and again in Python. Lowers the session's setting where it is higher."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= ROWS_PER_BATCH:
        conf.set(key, str(ROWS_PER_BATCH))
    return df.mapInArrow(fn, schema)


def per_worker(key: tuple, make: Callable):
    """What ``make`` returns, made once per Python worker process and kept for
    its later tasks. The functions of this package are shipped by value, so
    globals of their own do not outlive a task; a module made here does. The
    tokenizer libraries are told beforehand not to start threads of their own,
    as Spark already runs a task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    name = "tridelta_llm_worker"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512,
                  byte_limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a worker holds a bounded number of bytes of
    text at a time (one row may exceed the limit on its own)."""
    for b in batches:
        n = b.num_rows
        if n == 0:
            continue
        step = max(1, min(rows, int(n * byte_limit / max(1, b.nbytes))))
        for at in range(0, n, step):
            yield b.slice(at, step)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and a join of
    two stored tables can have its hot partitions split at run time. By zstd,
    which takes a third less room for texts than the default."""
    return stash(df, f"llm-{name}", codec="zstd")


def map_texts(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], list]], fields: str,
              keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the columns ``keep``, all by default) and new columns
    computed from each whole text in Python, batch by batch, without a shuffle.

    ``make`` is called once per task and returns a function from a list of
    texts (None for null) to one list of values per new column; ``fields`` is
    their schema in DDL. As the input's columns sit in the struct, no name of
    theirs can clash.
    """
    keep = df.columns if keep is None else keep
    new = df.sparkSession.createDataFrame([], fields).schema.fields
    src = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    out_schema = StructType([src.schema["row"], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in new]
        names = ["row", *(f.name for f in new)]
        fn = make()
        for b in small_batches(batches):
            values = fn(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(v, k) for v, k in zip(values, kinds))], names)

    return map_arrow(src, run, out_schema)
