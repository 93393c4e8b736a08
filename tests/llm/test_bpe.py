import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import edge
from tridelta.llm import bpe_rank

RANKS = P.path("byte_bpe_50k.tiktoken")
ENC = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe_rank.load_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sre 1!\n\t é 　\x1cß")), max_size=60))
def test_pieces_encode_like_the_whole(text):
    pieces = list(bpe_rank.safe_pieces(text, 3))
    assert "".join(pieces) == text
    assert [i for p in pieces for i in ENC.encode_ordinary(p)] == ENC.encode_ordinary(text)


def test_round_trip_of_edge_cases(spark):
    df = edge.frame(spark)
    rows = bpe_rank.decode(bpe_rank.encode(df, RANKS, P.PATTERN), RANKS).collect()
    want = sorted(((i or -1, ENC.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in edge.texts()))
    got = sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in rows)
    assert got == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in rows)


def test_empty_table_and_special_strings(spark):
    assert bpe_rank.encode(edge.frame(spark, []), RANKS, P.PATTERN).count() == 0
    row = bpe_rank.encode(edge.frame(spark, [(1, "x <|endoftext|> y", "en", "a")]), RANKS, P.PATTERN).head()
    assert np.frombuffer(row.ids, "<u4").max() < 50256
    assert hashlib.sha256(row.ids).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sre 1!\n\t é 　\x1c\x85ß")), max_size=60))
def test_matches_encode_like_the_whole(text):
    """What is done where no safe boundary is in reach."""
    split = bpe_rank.regex.compile(P.PATTERN)
    assert bpe_rank.encode_text(ENC, split, text * 9, 1) == ENC.encode_ordinary(text * 9)


def test_very_long_stretches(spark):
    """Runs without a safe boundary, at which the library's matcher fails."""
    texts = [" " * 1_000_000 + "x", "\n" * 900_000, "a" * 400_000, "word " + "\t " * 500_000 + "end of it"]
    rows = bpe_rank.decode(bpe_rank.encode(edge.frame(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]), RANKS, P.PATTERN), RANKS)
    got = {r.doc_id: r for r in rows.collect()}
    assert [bytes(got[k].decoded) for k in range(len(texts))] == [t.encode() for t in texts]
    short = ENC.encode_ordinary(" " * 300_000 + "x")  # the library still takes this one
    assert bpe_rank.encode_text(ENC, bpe_rank.regex.compile(P.PATTERN), " " * 300_000 + "x") == short
