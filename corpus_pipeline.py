"""A training corpus from raw documents, in five stages.

1. Quality rules: documents that the weakly supervised rules reject go.
2. N-gram Jaccard join: one document of each group of near copies stays.
3. Secret scan: findings that the forest keeps are blanked out in the text.
4. Source mix: documents are taken by the curriculum, those of sources with
   much weight twice, those of sources with little perhaps not at all, and stand
   in training order.
5. Byte-level BPE: token ids of every document, and whether they decode to its
   text again.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. ``run`` writes
every stage's result to the shared folder and reads it back, so a lost executor
costs at most the stage at hand. All but the last stage return the columns of
``documents``. Null texts fail the quality rules; other null columns pass.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tridelta.llm import bpe_rank, curriculum, ngram_join, secret_forest, weak_rules
from tridelta.llm.common import read, store
from tridelta.llm.queries import MIX

# Model fits and the documents' signatures have no counterpart in SQL.
ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak_rules.reject(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    words = secret_forest.dictionary_regex(secret_forest.words_for_dictionary(read(spark, sf_dir, "benchmark")))
    clean = secret_forest.redact(docs, secret_forest.train(docs, words))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.mix(docs, MIX)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.struct("doc_id", "lang", "source", "text").alias("row"), "text")
    coded = bpe_rank.decode(bpe_rank.encode(rows, ranks, public_tokenizers.PATTERN, id_col="row"), ranks)
    same = F.col("decoded") == F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return coded.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids", same.alias("decodes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scan", secrets),
    ("source mix", source_mix),
    ("byte-level BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
