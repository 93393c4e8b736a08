"""The registered queries: names, SQL, and the columns that are agreed on."""

import pytest

import __spark_entry__ as se
from tools_path import compare
from tridelta.llm.queries import ORACLES, QUERIES

SF0001 = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_file": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op3_curriculum_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op2_secret_forest": {"doc_id": "bigint"},
    "op6_ngram_join": {"doc_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_multi_index": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_rff_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_weak_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
                       "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op10_style_tree": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op11_repeat_spans": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op12_token_align": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint",
                         "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
    "op13_fill_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint",
                         "output_sha256": "string", "restored_sha256": "string"},
}


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(se.queries()) and set(ORACLES) <= set(QUERIES)


def test_sql_matches(spark):
    found = compare(spark, SF0001, sorted(ORACLES))
    assert all(r["match"] for r in found.values()), found


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_agreed_columns(spark, name):
    types = dict(QUERIES[name](spark, SF0001).dtypes)
    assert {c: types[c] for c in COLUMNS[name]} == COLUMNS[name]
