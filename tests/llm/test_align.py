import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import edge
from tridelta.llm import token_align as ta

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return ta.Aligner(A, B)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 40)), st.sets(st.integers(1, 40))), min_size=1, max_size=6))
def test_groups_are_the_common_ends(lanes):
    ends, firsts = ([], []), ([], [])
    at = 0
    for lane in lanes:
        for own, first, part in zip(ends, firsts, lane):
            first.append(len(own))
            own.extend(at + x for x in sorted(part | {41}))
        at += 41
    ea, eb = (np.array(x) for x in ends)
    last_a, last_b = ta.diagonal_groups(ea, eb, *(np.array(x) for x in firsts))
    assert last_a.tolist() == np.isin(ea, eb).tolist() and last_b.tolist() == np.isin(eb, ea).tolist()
    a, b = ta.link_places(ea, eb, last_a, last_b)
    ba, bb = np.concatenate([[0], ea[:-1]]), np.concatenate([[0], eb[:-1]])
    want = [(x, y) for x in range(len(ea)) for y in range(len(eb)) if ba[x] < eb[y] and bb[y] < ea[x]]
    assert sorted(zip(a.tolist(), b.tolist())) == want


KEPT: list = []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abé 's1!\n\t <|>▁")), max_size=40), max_size=6))
def test_pieces_encode_like_whole_texts(texts):
    KEPT[:] = KEPT or [ta.Aligner(A, B), Plain()]
    made, plain = KEPT
    found = made.encoder.encode(texts)
    assert [x.tolist() for x in found[0]] == [plain.a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in found[1]] == [plain.b.encode(t) for t in texts]


class Plain:
    """Whole texts through the libraries; groups and links by comparing all tokens."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.names = {k: t for t, k in self.a.get_vocab().items()}
        self.alphabet = ta.byte_alphabet()

    def tokens(self, text):
        ids_a = self.a.encode(" " + text, add_special_tokens=False).ids
        ids_b = self.b.encode(text)
        bytes_a = [bytes(self.alphabet[c] for c in self.names[k]) for k in ids_a]
        bytes_b = [bytes([int(self.b.id_to_piece(k)[3:-1], 16)]) if self.b.is_byte(k)
                   else self.b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        return ids_a, bytes_a, ids_b, bytes_b

    def one(self, text):
        """(groups, links) or None."""
        if not text:
            return None
        ids_a, bytes_a, ids_b, bytes_b = self.tokens(text)
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return None
        ends_a, ends_b = ([sum(map(len, x[:k + 1])) for k in range(len(x))] if len(x) < 3000 else np.cumsum([len(t) for t in x]).tolist()
                          for x in (bytes_a, bytes_b))
        common = sorted(set(ends_a) & set(ends_b))
        groups, links, i, j = [], [], 0, 0
        for end in common:
            x, y = i, j
            while ends_a[x] < end:
                x += 1
            while ends_b[y] < end:
                y += 1
            groups.append((ids_a[i:x + 1], ids_b[j:y + 1]))
            for p in range(i, x + 1):
                for q in range(j, y + 1):
                    if ends_a[p] - len(bytes_a[p]) < ends_b[q] and ends_b[q] - len(bytes_b[q]) < ends_a[p]:
                        links.append((ids_a[p], ids_b[q]))
            i, j = x + 1, y + 1
        return groups, links

    def corpus(self, rows):
        found = [(i, self.one(t)) for i, t, *_ in rows]
        counts = Counter(x for _, f in found if f for x in f[1])
        best = defaultdict(int)
        for (a, b), n in counts.items():
            best[b] = max(best[b], n)
        out = []
        for i, f in found:
            if f is None:
                out.append((i, 0, 0, 0, 0, 0, 0, ""))
                continue
            groups, links = f
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                        sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
        return out, counts, best


ODD = ["two  spaces", " lead", "tail ", "\n", "a\tb\n\nc", "▁", "x ▁ y", "<s> </s> <unk> <0x41> <|endoftext|>", "日本語 テキスト 🙂 é", "\x00 \x01",
       "a" * 5000, " " * 3000 + "x", "naïve　wide", "ﬁ ½ ™", "<|endoftext|>" * 3]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


def test_rows_equal_a_plain_version(spark):
    rows = [r for r in edge.texts() if r[0] != 9] + [(100 + k, t, "en", "a") for k, t in enumerate(ODD)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).select("doc_id", "text").collect()
    rows += [(1000 + r.doc_id, r.text, "en", "a") for r in docs] + [(5000, " ".join(r.text for r in docs[:60]), "en", "a")]
    want, counts, best = Plain().corpus(rows)
    df = edge.frame(spark, rows).repartition(5)
    got = [(r.row.doc_id, *r[1:]) for r in ta.measure(df, A, B).collect()]
    assert order(got) == order(want)
    assert sum(1 for r in want if not r[1]) == 4
    table = {(r.id_a, r.id_b): (r.n, r.best) for r in ta.link_table(df, A, B).collect()}
    assert table == {x: (n, n == best[x[1]]) for x, n in counts.items()}


def test_groups_of_whole_texts(spark):
    rows = [(k, t, "en", "a") for k, t in enumerate(ODD)] + [(50, edge.prose(400, 7), "en", "a"), (51, None, "en", "a")]
    plain = Plain()
    for r in ta.groups(edge.frame(spark, rows), A, B, keep=["doc_id", "text"]).collect():
        found = plain.one(r.row.text)
        a, b = iter(r.ids_a), iter(r.ids_b)
        groups = [([next(a) for _ in range(x)], [next(b) for _ in range(y)]) for x, y in zip(r.group_a, r.group_b)]
        assert groups == (found[0] if found else [])


def test_long_text_in_small_pieces(aligner, monkeypatch):
    """Pieces and groups of pieces far smaller than the text change nothing."""
    text = edge.prose(3000, 11) + " two  spaces " + edge.prose(200, 12)
    plain = Plain().one(text)
    monkeypatch.setattr(ta, "GROUP_BYTES", 3000)
    block = ta.Block(2)
    for found in aligner.groups_of([text, "▁ no " * 3000]):
        block.add(aligner, *found)
    n_a, n_b, n_groups, digests, pairs, counts, _ = block.columns()
    spelt = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain[0])
    assert digests == [hashlib.sha256(spelt.encode()).hexdigest(), ""]
    assert n_groups.tolist() == [len(plain[0]), 0] and n_a.tolist() == [sum(len(a) for a, _ in plain[0]), 0]
    assert dict(zip(pairs.tolist(), counts.tolist())) == Counter((a << 32) | b for a, b in plain[1])


def test_empty_table(spark):
    assert ta.measure(edge.frame(spark, []), A, B).count() == 0
    assert ta.link_table(edge.frame(spark, []), A, B).count() == 0
