from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import edge
from tridelta.llm import graph, ngram_join
from tridelta.llm.shingles import MinHash, Shingler, text_key


def sets_of(rows, size=5):
    out = []
    for r in rows:
        w = (r[1] or "").encode().split()
        out.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    return out


def brute(rows, share=Fraction(4, 5)):
    """Links and components by comparing every pair."""
    sets = sets_of(rows)
    n = len(rows)
    near = [[i != j and bool(sets[i]) and bool(sets[j]) and len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j])
             for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i]] + [label[j] for j in range(n) if near[i][j]]) for i in range(n)]
        if new == label:
            break
        label = new
    key = [(r[0] is None, r[0] or 0) for r in rows]
    first = {g: min(key[i] for i in range(n) if label[i] == g) for g in set(label)}
    return sorted((*key[i], sum(near[i]), *first[label[i]]) for i in range(n))


def edited(words, k, seed):
    rng = np.random.default_rng(seed)
    out = list(words)
    for at in rng.choice(len(out), k, replace=False):
        out[at] = f"e{seed}x{at}"
    return " ".join(out)


def corpus():
    rows = edge.texts()
    for g in range(12):  # groups of near copies around the threshold
        base = edge.prose(80 + 15 * g, 100 + g).split()
        rows += [(200 + 40 * g + k, edited(base, k % 5, 1000 * g + k), "en", "a") for k in range(8)]
    hot = edge.prose(120, 7).split()
    rows += [(2000 + k, edited(hot, 1 + k % 2, 50_000 + k), "en", "a") for k in range(90)]
    rows += [(3000 + k, " ".join(hot), "en", "a") for k in range(60)]
    passage = edge.prose(60, 8)  # shared by texts that are otherwise apart
    rows += [(4000 + k, edge.prose(70, 900 + k) + " " + passage, "en", "a") for k in range(30)]
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    got = ngram_join.join(edge.frame(spark, rows), block=16).collect()
    assert sorted((r.id is None, r.id or 0, r.n_links, r.component_id is None, r.component_id or 0) for r in got) == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus()
    df = edge.frame(spark, rows)
    out = ngram_join.deduplicate(df)
    assert out.columns == df.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    want = set()
    words = {(r[0] is None, r[0] or 0): bool((r[1] or "").split()) for r in rows}
    for row in brute(rows):
        if (row[0], row[1]) == (row[3], row[4]) or not words[(row[0], row[1])]:
            want.add((row[0], row[1]))
    assert set(kept) == want and kept.count((False, 10)) == 1  # the repeated row
    assert kept.count((True, 0)) == 2  # two different texts without an id


def test_empty_table(spark):
    assert ngram_join.join(edge.frame(spark, [])).count() == 0
    assert ngram_join.deduplicate(edge.frame(spark, [])).count() == 0
    assert ngram_join.join(edge.frame(spark, [(1, None, "en", "a")])).head()[0] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é\n\x1c")), max_size=24), min_size=2, max_size=8))
def test_shingle_hashes_tell_what_the_words_tell(texts):
    s = Shingler(3)
    hashed = [set(s.shingles(t.encode()).tolist()) for t in texts]
    real = sets_of([(0, t) for t in texts], 3)
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(hashed[i] & hashed[j]) == len(real[i] & real[j])
            assert (text_key(texts[i].encode()) == text_key(texts[j].encode())) == (texts[i].encode().split() == texts[j].encode().split())


def test_signatures_estimate_the_similarity():
    s, m = Shingler(), MinHash(512)
    base = edge.prose(400, 3).split()
    for k in (0, 4, 12, 40):
        a, b = (s.shingles(t.encode()) for t in (" ".join(base), edited(base, k, k)))
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs((m.signature(a) == m.signature(b)).mean() - true) < 0.09


def test_depth_and_matrix():
    assert ngram_join.shortest_depth(0.8, 32, 8, 0.999) == 7
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 9], [7])]
    assert ngram_join.linked(sets, Fraction(4, 5), cells=4).tolist() == [[0, 1, 0, 0], [1, 0, 0, 0], [0] * 4, [0] * 4]


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(1000, 1100)] + [(7, 7), (3, 2), (2, 3)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {k: 100 for k in range(100, 161)} | {k: 5 for k in [5, *range(1000, 1100)]} | {2: 2, 3: 2}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
