import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import edge
from tridelta.llm import idcoder, piecewise, token_file
from tridelta.llm.piecewise import PieceEncoder, byte_level
from tridelta.session import scratch_path

PATH = P.path("byte_bpe_50k.json")
RNG = np.random.default_rng(1)


@pytest.mark.parametrize("ids", [
    np.zeros(0), np.array([50256]), np.full(9000, 7), RNG.integers(0, 50257, 9001), RNG.integers(0, 3, 4096),
    np.tile(RNG.integers(0, 999, 60), 200), RNG.zipf(1.3, 20_000) % 4000, np.arange(2049)], ids=range(8))
def test_coder_round_trip(ids):
    coded = idcoder.encode(ids)
    assert (idcoder.decode(coded) == ids).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=200), st.integers(1, 40))
def test_coder_round_trip_of_small_blocks(ids, block):
    assert idcoder.decode(idcoder.encode(np.array(ids, dtype=np.uint32), block)).tolist() == ids


def test_groups_of_blocks_do_not_change_the_code(monkeypatch):
    ids = RNG.zipf(1.4, 30_000) % 500
    coded = idcoder.encode(ids)
    monkeypatch.setattr(idcoder, "CELLS", 2048)
    assert idcoder.encode(ids) == coded and (idcoder.decode(coded) == ids).all()


def test_repeats_and_skewed_ids_are_coded_short():
    assert len(idcoder.encode(np.tile(RNG.integers(0, 999, 60), 400))) < 24_000 * 2 / 20
    ids = RNG.zipf(1.5, 50_000) % 3000
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    assert len(idcoder.encode(ids)) * 8 / len(ids) < 1.1 * entropy + 0.6


def test_damage_is_found():
    coded = bytearray(idcoder.encode(RNG.integers(0, 900, 9000)))
    coded[-2000] ^= 4
    with pytest.raises(ValueError, match="block"):
        idcoder.decode(bytes(coded))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abé 's1!\n\t <|>")), max_size=40), max_size=6))
def test_pieces_encode_like_whole_texts(texts):
    enc = encoder()
    whole = [x.tolist() for x in enc.models[0].whole(texts)] if texts else []
    assert [x.tolist() for x in enc.encode(texts)[0]] == whole


def encoder(_kept=[]):
    if not _kept:
        _kept.append(PieceEncoder([byte_level(PATH, specials=True)[0]]))
    return _kept[0]


def test_files_of_edge_cases(spark):
    path = scratch_path(spark, "t")
    token_file.write_tokens(edge.frame(spark), path, PATH, 2, segment_ids=5000, partitions=3)
    rows = token_file.read_tokens(spark, path).orderBy("start").collect()
    tok = Tokenizer.from_file(PATH)
    want, at = [], 0
    got_order = [r.doc_id for r in rows]
    assert got_order == sorted(got_order, key=lambda i: (i is not None, i or 0))
    pool = {}
    for i, t, *_ in edge.texts():
        pool.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [2])
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        pool[r.doc_id].remove(ids)
        assert r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        at += len(ids)
        want.append(ids)
    assert not any(pool.values())


def test_empty_table(spark):
    assert token_file.round_trip(spark, edge.frame(spark, []), PATH, 2).count() == 0


def test_added_tokens_are_encoded_as_the_library_does():
    tok = Tokenizer.from_file(PATH)
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b c", "plain words here", "<|endof text|>"]
    want = [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert 50256 in want[0]
    assert [x.tolist() + [2] for x in encoder().encode(texts)[0]] == want


def test_pieces_of_several_batches_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(piecewise, "CACHED_PIECES", 120)
    enc = PieceEncoder([byte_level(PATH, specials=True)[0]])
    tok, model = Tokenizer.from_file(PATH), enc.models[0]
    taught, own = [], model.encode_all
    model.encode_all = lambda texts: taught.append("".join(texts)) or own(texts)
    often = " ".join(f"word{k}" for k in range(20))
    for batch in range(30):
        texts = [often, " ".join(f"once{batch}x{k}" for k in range(15))]
        assert [x.tolist() for x in enc.encode(texts)[0]] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(enc.known) == len(enc.uses) == len(model.sizes) <= 140 and model.sizes.sum() == len(model.ids)
    assert sum("word7" in t for t in taught) == 1


def test_both_searches_find_the_same_spaces():
    import sys

    spaces = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    texts = [t for x in spaces for t in (f"a{x} b", f"a {x}b", f"a{x}b", f"a {x}", f"{x} a", x)]
    texts += ["", "a b", " a", "a ", "a \n", "a\n", "a\n b", "a\u200b b", "\n a", "a b\n"]
    found = piecewise.pc.match_substring_regex(piecewise.pa.array(texts, piecewise.pa.large_string()), piecewise.UNSAFE_SPACE_RE2).to_pylist()
    assert found == [bool(piecewise.UNSAFE_SPACE.search(t)) for t in texts]


def test_newlines_and_closing_marks_do_not_multiply_pieces():
    words = [f"word{k}" for k in range(20)]
    texts = ["\n".join(f"{a}{mark} {b}{mark}" for a in words for b in words) for mark in ("", ",", ".", "!")]
    enc = PieceEncoder([byte_level(PATH, specials=True)[0]])
    tok = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in enc.encode(texts)[0]] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(enc.known) < 3 * len(words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("a1éªΩ×.,!'\" \n\t\r\0\x85\u2028")), max_size=24), max_size=6))
def test_texts_cut_at_lines_and_marks_encode_like_whole_texts(texts):
    enc = encoder()
    whole = [x.tolist() for x in enc.models[0].whole(texts)] if texts else []
    assert [x.tolist() for x in enc.encode(texts)[0]] == whole


def plain_code(ranks: list[int], weights: list[int]) -> bytes:
    """A block's code, one id after another, in Python's integers."""
    entries, rates = {}, [idcoder.START_RATES.tolist(), idcoder.START_RATES.tolist()]
    counts, total = [0] * len(weights), sum(weights)
    low, span, used, one, two = 0, 1 << 56, 0, 0, 0
    for t, s in enumerate(ranks):
        if t in idcoder.REFRESH:
            counts = np.bincount(ranks[:t], minlength=len(weights)).tolist()
            total = sum(weights) + 16 * t
        places = [(0, one & 2047), (1, (one + 1265 * two) & 2047)]
        (id1, conf1), (id2, conf2) = told = [entries.get(p, (None, 0)) for p in places]
        second = rates[1][conf2] * 252
        first = ((idcoder.SPIKES - second) * rates[0][conf1]) >> 16
        rest = idcoder.TOTAL - second - first
        begin, width = sum(weights[:s]) + 16 * sum(counts[:s]), weights[s] + 16 * counts[s]
        unit, plain = span >> 24, width * rest // total
        if id2 == s and second > plain:
            span = second * unit
        elif id1 == s and first > plain:
            low, span = low + second * unit, first * unit
        else:
            share = rest * unit // total
            low, span = low + (second + first) * unit + begin * share, width * share
        while span < 1 << 40:
            low, span, used = low << 16, span << 16, used + 1
        for k, (place, (known, conf)) in enumerate(zip(places, told)):
            hit = known == s
            rates[k][conf] += (65535 * hit - rates[k][conf]) >> 5
            after = min(conf + 1, 7) if hit else conf >> 1
            entries[place] = (known, after) if after else (s, 1)
        one, two = s, one
    return np.frombuffer((low << 8).to_bytes(2 * used + 8, "big"), ">u2").astype("<u2").tobytes()


@pytest.mark.parametrize("ids", [
    RNG.zipf(1.3, 3000) % 400, np.tile(RNG.integers(0, 99, 60), 40), np.full(2100, 7), RNG.integers(0, 50257, 2500)], ids=range(4))
def test_coder_does_what_a_plain_one_does(ids):
    data = idcoder.encode(ids)
    _, _, n, block, size = struct.unpack_from(idcoder.HEAD, data)
    at = struct.calcsize(idcoder.HEAD)
    known, weights = np.frombuffer(zlib.decompress(data[at:at + size]), "<u4").reshape(2, -1)
    rank = {k: r for r, k in enumerate(known.tolist())}
    ranks = [rank[i] for i in ids.tolist()]
    want = [plain_code(ranks[k:k + block], weights.tolist()) for k in range(0, n, block)]
    assert data[at + size + 8 * len(want):] == b"".join(want)


@pytest.mark.parametrize("n", [9001, 6200, 2049])
def test_a_short_last_block_changes_no_other(monkeypatch, n):
    ids = RNG.zipf(1.3, n) % 500
    coded = idcoder.encode(ids)
    monkeypatch.setattr(idcoder, "CELLS", 512)
    assert idcoder.encode(ids) == coded and (idcoder.decode(coded) == ids).all()
