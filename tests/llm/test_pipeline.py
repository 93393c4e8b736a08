import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
import edge
from tridelta.llm import bpe_rank, weak_rules
from tridelta.session import scratch_path
from test_mix import brute as brute_mix
from test_ngram import brute as brute_groups, edited


def corpus():
    rows = edge.texts()
    for g in range(25):
        base = edge.prose(90 + g, 700 + g)
        rows.append((100 + 10 * g, base, "en", f"s{g % 5}"))
        rows += [(100 + 10 * g + k, edited(base.split(), 1, 10 * g + k), "en", f"s{(g + k) % 5}") for k in (1, 2)]
    rows += [(900 + k, " | ".join(edge.prose(40, 40 + k).split()), "en", "s1") for k in range(12)]
    for k in range(40):
        token = hashlib.sha1(str(k).encode()).hexdigest()
        rows.append((2000 + k, edge.prose(50, 2000 + k) + f' token = "{token}" ' + edge.prose(20, 3000 + k) + " " + "".join(edge.prose(4, k).split()) + "andmore", "en", "s2"))
    return rows


def test_stages_against_plain_versions(spark):
    rows = corpus()
    docs = edge.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    sf_dir = scratch_path(spark, "sf")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(1, edge.prose(80, 77))], "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n in stages] == ["quality rules", "n-gram Jaccard join", "secret scan", "source mix", "byte-level BPE"]

    def after(name, df):
        path = scratch_path(spark, "stage")
        stages[name](spark, df, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        return out, [(r.doc_id, r.text, r.lang, r.source) for r in out.collect()] if "text" in out.columns else None

    df, kept = after("quality rules", docs)
    assert df.columns == docs.columns
    counts = {}
    for r in rows:
        s = weak_rules.TextStats(r[1])
        p = sum((x.vote(s) + 1) * 3 ** j for j, x in enumerate(weak_rules.RULES))
        counts[p] = counts.get(p, 0) + 1
    post = weak_rules.fit(counts, len(weak_rules.RULES)).posterior
    want = []
    for r in rows:
        s = weak_rules.TextStats(r[1])
        p = sum((x.vote(s) + 1) * 3 ** j for j, x in enumerate(weak_rules.RULES))
        if s.n_words >= 10 and 100 * s.n_repeat_words <= 20 * s.n_words and post[p] >= 0.5:
            want.append(r)
    assert sorted(kept, key=repr) == sorted(want, key=repr) and not any(900 <= (r[0] or 0) < 912 for r in kept)

    groups = brute_groups(kept)
    df, one = after("n-gram Jaccard join", df)
    first = {(g[0], g[1]) for g in groups if (g[0], g[1]) == (g[3], g[4])}
    assert {(r[0] is None, r[0] or 0) for r in one} == first and df.columns == docs.columns

    df, clean = after("secret scan", df)
    before = {r[0]: r[1] for r in one}
    assert len(clean) == len(one) and df.columns == docs.columns
    for i, text, *_ in clean:
        if i and 2000 <= i < 2040:
            assert text == before[i].replace(hashlib.sha1(str(i - 2000).encode()).hexdigest(), "[SECRET]")
        elif i is not None:
            assert text == before[i]
    assert all(r.n_chars == len(r.text) for r in df.collect())

    df, mixed = after("source mix", df)
    size, _, _, taken = brute_mix(clean, corpus_pipeline.MIX)
    copies = sorted((clean[k][0] or 0, -(-taken[k] // size[k])) for k in size if taken[k])
    ids = [r[0] or 0 for r in mixed]
    assert sorted((i, ids.count(i)) for i in set(ids) if i) == [c for c in copies if c[0]]

    df, _ = after("byte-level BPE", df)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe_rank.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = sorted((r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist(), r.decodes) for r in df.collect())
    assert got == sorted((r[0] or 0, enc.encode_ordinary(r[1]), True) for r in mixed)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(mixed)


def test_empty_documents(spark):
    sf_dir = scratch_path(spark, "sf")
    docs = edge.frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
