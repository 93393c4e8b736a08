"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_rank, curriculum, fill_middle, multi_index, ngram_join, repeat_spans, rff_quality, secret_forest, style_tree, token_align, token_file, warc, weak_rules
from .common import read


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written as coded ids, read back and decoded."""
    return token_file.round_trip(spark, read(spark, sf_dir, "documents"),
                                 public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document through encode and decode; digests of both."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe_rank.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    both = bpe_rank.decode(ids, ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding that the forest keeps, in every whole document."""
    docs = read(spark, sf_dir, "documents")
    words = secret_forest.dictionary_regex(secret_forest.words_for_dictionary(read(spark, sf_dir, "benchmark")))
    found = secret_forest.scan(docs, secret_forest.train(docs, words), keep=["doc_id"])
    return found.select("row.doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score")


# Weights 5, 2 and 1 in the whole; heavy sources fade, light ones grow.
MIX = curriculum.MixPlan(knots=(
    ((0.0, 7.5), (1.0, 2.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (1.0, 1.5)),
))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the curriculum takes of every document, in training order (by the
    position of a document's first copy, those not taken last)."""
    per_doc = curriculum.allocate(read(spark, sf_dir, "documents"), MIX, keep=["doc_id"])
    out = per_doc.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken",
                         F.round(F.get("positions", F.lit(0)), 9).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE turn WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size::DOUBLE AS cap FROM s),
l AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget FROM w),
t AS (
  SELECT source, turn, weight, source_size, least(cap, max((budget - before) / open) OVER () * weight) AS target FROM l),
o AS (
  SELECT doc_id, size, source_size::BIGINT AS source_size, target, turn, weight, floor(target + 0.5::DOUBLE)::BIGINT AS wanted,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pre
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CASE WHEN size > 0 THEN greatest(0, ceil((wanted - pre) / source_size))::BIGINT ELSE 0 END AS copies,
         pre::DOUBLE / target * weight AS need,
         CASE turn WHEN 0 THEN 7.5::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS w0,
         CASE turn WHEN 0 THEN -5.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS slope FROM o)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       CASE WHEN copies > 0 THEN (copies - 1) * size + least(size, wanted - pre - (copies - 1) * source_size)
            ELSE 0 END::BIGINT AS taken,
       CASE WHEN copies > 0 THEN round(least(1.0::DOUBLE, 2.0::DOUBLE * need / (
            w0 + sqrt(greatest(0.0::DOUBLE, w0 * w0 + 2.0::DOUBLE * slope * need)))), 9) END AS position
FROM c
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive and back; the revisits' response is
    looked up by the record id that the archive names."""
    caps = warc.capture_table(warc.round_trip(spark, read(spark, sf_dir, "pages")))
    return caps.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha, html FROM p),
d AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY sha) AS last_id,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(sha, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '')
           AS payload_digest FROM h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = last_id OR last_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last_id THEN last_id END AS refers_to FROM d
"""


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share four fifths of their five-word shingles."""
    found = ngram_join.join(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "component_id", "kept")


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with a cosine of at least 0.93."""
    found = multi_index.near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op8_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rff_quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_rules.judge(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("row.doc_id", *weak_rules.STATS, "base_failed", "kept", "posterior")


def op10_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = style_tree.extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("row.page_id", "row.url", "text", "n_chars")


def op11_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document without the passages that repeat anywhere."""
    out = repeat_spans.remove(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT id, unnest(range(1, len(w) - 33)) AS b, w FROM d),
h AS (SELECT id, b, md5(array_to_string(w[b:b + 34], ' ')) AS h FROM s),
r AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT id, unnest(range(b, b + 35)) AS i FROM h SEMI JOIN r USING (h)),
x AS (SELECT id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN c USING (id, i) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (id)
"""


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of two tokenizers over every whole document, aligned."""
    found = token_align.measure(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select("row.doc_id", *found.columns[1:])


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document rewritten for infilling, and taken back out."""
    out = fill_middle.rewrite(read(spark, sf_dir, "documents"), seed=1, keep=["doc_id"])
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM o
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_file": op1_token_file,
    "op2_secret_forest": op2_secret_forest,
    "op3_curriculum_mix": op3_curriculum_mix,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_warc": op5_warc,
    "op6_ngram_join": op6_ngram_join,
    "op7_multi_index": op7_multi_index,
    "op8_rff_quality": op8_rff_quality,
    "op9_weak_rules": op9_weak_rules,
    "op10_style_tree": op10_style_tree,
    "op11_repeat_spans": op11_repeat_spans,
    "op12_token_align": op12_token_align,
    "op13_fill_middle": op13_fill_middle,
}

ORACLES: dict[str, str] = {
    "op3_curriculum_mix": OP3_SQL,
    "op5_warc": OP5_SQL,
    "op11_repeat_spans": OP11_SQL,
    "op13_fill_middle": OP13_SQL,
}
