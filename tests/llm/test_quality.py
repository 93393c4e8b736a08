import math

import numpy as np
import pytest

import edge
from tridelta.llm import rff_quality, weak_rules
from tridelta.llm.textstats import N_FEATURES, TextStats


def brute_repeats(words, n=5):
    windows = [tuple(words[k:k + n]) for k in range(len(words) - n + 1)]
    inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(n)}
    return len(inside)


@pytest.mark.parametrize("text", [
    "", "a", "a b c d e a b c d e", "a a a a a a a", "x y a b c d e f a b c d e f z", "l1\nl2\nl1\n\n\nl1\n l1", "a\x1cb c é　x",
    "a b c d e q a b c d e f c d e f q"])
def test_counts(text):
    import re

    s = TextStats(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert s.words == words and s.n_words == len(words) and s.word_chars == sum(map(len, words))
    assert s.n_repeat_words == brute_repeats(words)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert s.n_dup_lines == sum(x in lines[:k] for k, x in enumerate(lines))
    assert len(s.features()) == N_FEATURES and all(map(math.isfinite, s.features()))


def test_symbols_are_counted_in_the_whole_text():
    assert TextStats("# a*b $%&|<> !").n_symbols == 8 and TextStats(None).n_words == 0


def junk(k):
    words = edge.prose(60, 5000 + k).split()
    return [" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join(w + "###" for w in words),
            " ".join(w for w in words[:12] for _ in range(7))][k % 4]


def corpus():
    rows = [(k, edge.prose(40 + k % 90, k) + ".", "en", "a") for k in range(20, 300)]
    return rows + [(1000 + k, junk(k), "en", "a") for k in range(40)]


def test_em_finds_the_bad_documents(spark):
    got = {r.row.doc_id: r for r in weak_rules.judge(edge.frame(spark, corpus() + edge.texts())).collect()}
    assert all(got[k].kept for k in range(20, 300))
    assert not any(got[1000 + k].kept for k in range(40))
    for i in (4, 5, 6, 7, 8):
        assert got[i].base_failed and not got[i].kept


def test_em_on_counts():
    votes = {}
    rng = np.random.default_rng(0)
    for _ in range(5000):
        good = rng.random() < 0.9
        v = [(1 if rng.random() < 0.97 else 0) if good else (-1 if rng.random() < 0.5 else 1) for _ in range(6)]
        p = sum((x + 1) * 3 ** j for j, x in enumerate(v))
        votes[p] = votes.get(p, 0) + 1
    model = weak_rules.fit(votes, 6)
    assert abs(model.prior - 0.9) < 0.03
    assert all(g[0] < 0.02 and 0.4 < b[0] < 0.6 for g, b in zip(model.on_good, model.on_bad))
    assert weak_rules.fit({}, 6).posterior == {}


def test_rejecting_keeps_the_columns(spark):
    df = edge.frame(spark)
    out = weak_rules.reject(df)
    assert out.columns == df.columns and out.where("text is null").count() == 0
    assert weak_rules.judge(edge.frame(spark, [])).count() == 0


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    x = np.sort(rng.random(200))
    n = rng.integers(1, 9, 200).astype(float)
    y = n * (rng.random(200) < x)
    knots, levels = rff_quality.isotonic(x, y, n)
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all() and levels.min() >= 0 and levels.max() <= 1


def test_normal_equations_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(3).normal(size=(200, N_FEATURES))
    rows = [(list(map(float, r)), float(r[0] > 0), k % 4 == 3) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "x array<double>, y double, calibrate boolean")
    a, b = (rff_quality.fit(df.repartition(n), components=32) for n in (1, 7))
    assert np.allclose(a.beta, b.beta, atol=1e-6) and np.allclose(a.score(x), b.score(x), atol=1e-6)
    z = a.expand(x[[k for k in range(200) if k % 4 != 3]])
    y = np.array([r[1] for k, r in enumerate(rows) if k % 4 != 3])
    want = np.linalg.solve(z.T @ z + 1e-3 * len(y) / 32 * np.eye(33), z.T @ y)
    assert np.allclose(a.beta, want, atol=1e-6)
    exact = np.exp(-0.05 * ((x[:40, None] - x[None, :40]) ** 2).sum(-1) / 1.0)
    wide = rff_quality.fit(df, components=4000)
    scaled = (x[:40] - wide.mean) / wide.scale
    exact = np.exp(-0.05 * ((scaled[:, None] - scaled[None]) ** 2).sum(-1))
    assert np.abs(wide.expand(x[:40])[:, :-1] @ wide.expand(x[:40])[:, :-1].T - exact).max() < 0.1


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus() + edge.texts()
    docs = edge.frame(spark, rows)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20, 300)] + [(1000 + k, 0, 0) for k in range(40)] + [(5, None, 1), (None, 0, 0), (20, 1, 1)],
                                   "doc_id bigint, quality int, toxic int")
    got = rff_quality.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.id is not None]
    import zlib

    assert {r.id for r in held} == {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2}
    right = [(r.score >= 0.7) == (r.id < 1000) for r in held if r.id >= 20]
    assert sum(right) >= 0.95 * len(right)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in rff_quality.score_documents(edge.frame(spark), none).collect()} == {0.5}
    assert rff_quality.score_documents(edge.frame(spark, []), none).count() == 0
