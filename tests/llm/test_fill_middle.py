import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import edge
from tridelta.llm import fill_middle as fim


def byte_offsets(text: str) -> list[int]:
    return np.cumsum([0] + [len(c.encode()) for c in text]).tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("aé€𝄞"), st.integers(1, 90)), max_size=30), st.integers(1, 5), st.integers(3, 64))
def test_index_is_exact(runs, max_error, block):
    text = "".join(c * n for c, n in runs)
    index = fim.RankIndex.of(text.encode(), max_error, block)
    assert index.n == len(text)
    assert index.offset(np.arange(len(text) + 1)).tolist() == byte_offsets(text)
    off = np.array(byte_offsets(text)) - index.predict(np.arange(len(text) + 1))
    assert np.abs(off).max() <= max_error + 1


def test_lines_are_few_where_text_is_even():
    assert len(fim.RankIndex.of(b"a" * 1_000_000).ranks) == 1
    assert not len(fim.RankIndex.of(b"a" * 1_000_000).residuals)
    even = fim.RankIndex.of(("aé" * 200_000).encode())
    assert len(even.ranks) == 1 and even.offset([200_000]).tolist() == [300_000]
    mixed = fim.RankIndex.of(("a" * 50_000 + "€" * 50_000).encode())
    assert 2 <= len(mixed.ranks) <= 3


def plain_version(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "<P>" + t[:a], "<M>" + t[a:b], "<S>" + t[b:]
    return (doc_id, n, "spm", a, b - a, s + p + m) if h4 % 100 < 20 else (doc_id, n, "psm", a, b - a, p + s + m)


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[5]))


def test_rows_equal_a_plain_version(spark):
    more = [(100 + k, ("é<" * k + "P> x" * (k % 3) + "𝄞y" * (k % 7)), "en", "a") for k in range(120)]
    more += [(300, "has <S> inside", "en", "a"), (301, "<", "en", "a"), (302, "x" * 300_000 + "é" * 300_000, "en", "a")]
    rows = edge.texts() + more
    out = fim.rewrite(edge.frame(spark, rows)).withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    got = out.collect()
    assert order([(r.row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got]) == order(
        [plain_version(i, t) for i, t, *_ in rows])
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted(r.restored for r in got) == sorted(t or "" for _, t, *_ in rows)


def test_stored_index_serves_cuts_without_the_text(spark):
    rows = [(k, "aé€"[k % 3] * 1000 + "𝄞" * k, "en", "a") for k in range(40)]
    index = fim.build_index(edge.frame(spark, rows), keep=["doc_id"])
    wanted = index.select("row.doc_id", *index.columns[1:], F.expr("array(0, n div 2, n)").alias("wanted"))
    found = {r.row.doc_id: r.offsets for r in fim.cut_offsets(wanted, "wanted", ["doc_id"]).collect()}
    for k, text, *_ in rows:
        offsets = byte_offsets(text)
        assert found[k] == [0, offsets[len(text) // 2], offsets[-1]]


def test_empty_table_and_marks(spark):
    assert fim.rewrite(edge.frame(spark, [])).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("<P", "P>", "<M>"), ("aba", "x", "y"), ("<P>", "<S>", "")):
        with pytest.raises(ValueError):
            fim.check_marks(marks)
