import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import edge
from tridelta.llm import repeat_spans as rs
from tridelta.llm.common import words_of
from tridelta.llm.shingles import Shingler


def plain_version(texts, length):
    """Kept words of each text, by counting every window."""
    lists = [words_of(t or "") for t in texts]
    counts = Counter(tuple(w[s:s + length]) for w in lists for s in range(len(w) - length + 1))
    out = []
    for w in lists:
        gone = {i for s in range(len(w) - length + 1) if counts[tuple(w[s:s + length])] > 1 for i in range(s, s + length)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def planted(n, seed):
    """Texts that share passages of many lengths around the threshold, also hot
    ones, in surroundings of their own; copies and near copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passages = [[word() for _ in range(rng.choice((12, 20, 34, 35, 36, 50, 90)))] for _ in range(12)]
    out = []
    for k in range(n):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = passages[0] if rng.random() < 0.4 else rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            w += p[a:len(p) - rng.randint(0, len(p) // 3)] + [word() for _ in range(rng.choice((0, 1, 40)))]
        out.append(" ".join(w))
        if rng.random() < 0.3 and w:
            w = list(w)
            w[rng.randrange(len(w))] = "changed"
            out.append("  ".join(w))
        if rng.random() < 0.2:
            out.append(out[-1])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc"]), max_size=120), st.integers(2, 9), st.integers(1, 4))
def test_equal_windows_select_equal_seeds(words, length, seed):
    if seed >= length:
        return
    finder, hashes = rs.Anchors(length, seed), Shingler().words(" ".join(words).encode())
    places, seeds, around = finder.anchors(hashes)
    at, own_seed, own = finder.windows(hashes, places)
    assert at.tolist() == list(range(max(0, len(words) - length + 1)))
    seen = {}
    for k, x in enumerate(at.tolist()):
        assert seen.setdefault(tuple(words[x:x + length]), (own_seed[k], own[k])) == (own_seed[k], own[k])
    assert len(set(own.tolist())) == len(seen)
    reach = length - seed
    near = {}
    for p, s, c in zip(places.tolist(), seeds, around):
        key = tuple(words[max(0, p - reach):p]), tuple(words[p:p + length])
        assert near.setdefault((s, c), key) == key


def test_blocks_change_nothing(monkeypatch):
    text = (" ".join(planted(60, 5)) + " ").encode()
    shingler = Shingler()
    hashes = rs.word_hashes(shingler, text)
    assert np.array_equal(rs.word_hashes(shingler, text, 100), hashes)
    want = rs.Anchors().anchors(hashes)
    monkeypatch.setattr(rs, "BLOCK_WORDS", 64)
    assert all(np.array_equal(a, b) for a, b in zip(rs.Anchors().anchors(hashes), want))


def test_rows_equal_counting_all_windows(spark):
    texts = planted(150, 3) + [edge.prose(80, 1), " ".join(["x"] * 100), " ".join(["y", "z"] * 30), "same " * 40]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)] + edge.texts()
    got = rs.remove(edge.frame(spark, rows).repartition(7), keep=["doc_id", "text"]).collect()
    want = plain_version([t for _, t, *_ in rows], rs.LENGTH)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted([(r.row.doc_id, r.row.text, r.n_words, r.n_removed, r.kept) for r in got], key=key) == sorted(
        [(i, t, len(words_of(t or "")), len(words_of(t or "")) - len(w), " ".join(w)) for (i, t, *_), w in zip(rows, want)], key=key)
    assert 0 < sum(r.n_removed > 0 for r in got) < len(got)
    for r in got:  # maximal: in order, apart, and never shorter than a window
        assert all(x.end - x.begin >= rs.LENGTH for x in r.spans)
        assert all(x.end < y.begin for x, y in zip(r.spans, r.spans[1:]))


def test_other_lengths_and_empty_table(spark):
    texts = planted(60, 9)
    got = rs.remove(edge.frame(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]), length=9, seed=4, keep=["doc_id"]).collect()
    assert {r.row.doc_id: r.kept for r in got} == {k: " ".join(w) for k, w in enumerate(plain_version(texts, 9))}
    assert rs.remove(edge.frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        rs.Anchors(5, 5)
