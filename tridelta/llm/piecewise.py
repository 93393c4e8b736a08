"""Token ids of texts from the ids of their distinct pieces.

Texts are split at single spaces between two characters that are not white
space. No match of a byte-level split pattern, and no piece of a model whose
pieces hold the space sign in front only, reaches over such a place, so what
lies between encodes alone to the same ids. Each distinct piece of a batch is
encoded once and remembered for later batches; when the memory is full, pieces that
came in one batch only are forgotten. Texts with other spaces, and
those that match ``odd``, are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_PIECES = 1 << 19  # some 200 bytes each
# a space that is not between two characters other than white space
UNSAFE_SPACE = re.compile(r"^ |\s | \s| $")
# the same for Arrow, whose \s is ASCII only
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNSAFE_SPACE_RE2 = rf"\A |{_SPACE} | {_SPACE}| \z"
# newlines next to other white space, in threes, or in twos at the end
_OTHER_SPACE = _SPACE.replace(r"[\t-\r", r"[\t\x0b-\r")
UNSAFE_LINE_RE2 = rf"\n{_OTHER_SPACE}|{_OTHER_SPACE}\n|\n\n\n|\n\n\z"
MARK = "\0"
# a letter or digit (of blocks that no version of Unicode changes) and a mark that a space follows
CLOSING_RE2 = r"([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([.,;:!?]) ", r"\1 " + MARK + r"\2 "


def _join(sign: str, texts: pa.Array) -> pa.Array:
    """Each text with ``sign`` in front."""
    return pc.binary_join_element_wise(pa.scalar(sign, pa.large_string()), texts, pa.scalar("", pa.large_string()))


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``begins[k]`` to ``begins[k] + sizes[k] - 1`` of all k, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


class Model:
    """One tokenizer: ``encode_all`` gives the ids of a list of whole texts,
    ``token_bytes`` how many bytes of text each id stands for, ``odd`` finds
    what may not be cut into pieces, ``lines`` says that texts are split by the
    pattern of GPT-2: a newline before other than white space is a match of its own there,
    and no match goes from a letter or digit on to a punctuation mark."""

    def __init__(self, encode_all: Callable[[list[str]], list], token_bytes: np.ndarray, odd: re.Pattern, lines: bool = False):
        self.encode_all, self.token_bytes, self.odd, self.lines = encode_all, token_bytes, odd, lines
        self.forget()

    def forget(self) -> None:
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def keep(self, places: np.ndarray) -> None:
        """Forget all pieces but those at ``places``, which is their new order."""
        begins = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[places]
        self.ids = self.ids[spread(begins[places], sizes)]
        self.sizes = sizes

    def known(self) -> pa.Array:
        """The ids of each piece as bytes."""
        begins = np.concatenate([[0], np.cumsum(4 * self.sizes)])
        return pa.Array.from_buffers(pa.large_binary(), len(self.sizes), [None, pa.py_buffer(begins), pa.py_buffer(self.ids)])

    def whole(self, texts: list[str], at_once: int = 32) -> list[np.ndarray]:
        out = []
        for k in range(0, len(texts), at_once):  # libraries take far more room than the ids they return
            out += [np.array(x, dtype=np.uint32) for x in self.encode_all(texts[k:k + at_once])]
        return out

    def learn(self, joined: list[str], ends: np.ndarray) -> None:
        """Remember pieces that were put together: ``ends`` are theirs in bytes,
        and the ids of each are told apart by their bytes."""
        ids = np.concatenate(self.whole(joined))
        cuts = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends, side="right")
        self.ids = np.concatenate([self.ids, ids])
        self.sizes = np.concatenate([self.sizes, np.diff(cuts, prepend=0)])


class PieceEncoder:
    """Encodes texts with one or more models. ``lead``: every text is meant with
    one more space in front."""

    def __init__(self, models: list[Model], lead: bool = False):
        self.models, self.lead, self.lines = models, lead, all(m.lines for m in models)
        # A piece is meant with a space in front, unless it starts with a newline. The first piece of
        # a text stands after a space, a cut-off mark after MARK: both are meant without that.
        self.known = pa.array([], pa.large_string())
        self.uses = np.zeros(0, np.int32)  # batches that held each piece, since pieces were forgotten last

    def _learn(self, pieces: pa.Array) -> None:
        """Encode pieces and remember them; those that begin with white space make
        one text when put together."""
        alone = pc.or_(pc.starts_with(pieces, " "), pc.starts_with(pieces, MARK))
        bare = pc.or_(pc.starts_with(pieces, "\n"), pc.equal(pieces, ""))
        texts = pc.if_else(alone, pc.utf8_slice_codeunits(pieces, 1), pc.if_else(bare, pieces, _join(" ", pieces)))
        single = np.flatnonzero(alone.to_numpy(zero_copy_only=False))
        cuts = np.unique(np.concatenate([np.arange(0, len(texts), 256), single, single + 1, [len(texts)]]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), texts), pa.scalar("", pa.large_string()))
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        for model in self.models:
            model.learn(joined.to_pylist(), ends)
        self.known = pa.concat_arrays([self.known, pieces])
        self.uses = np.concatenate([self.uses, np.zeros(len(pieces), np.int32)])

    def _forget(self) -> None:
        """Keep the pieces that came in two batches or more; one that is kept
        must come again to be kept the next time."""
        often = np.flatnonzero(self.uses > 1)
        if 2 * len(often) > CACHED_PIECES:
            often = often[:0]
        self.known = self.known.take(pa.array(often))
        for model in self.models:
            model.keep(often)
        self.uses = np.ones(len(often), np.int32)

    def _plain(self, column: pa.Array) -> np.ndarray:
        unsafe = pc.or_(pc.match_substring_regex(column, UNSAFE_SPACE_RE2), pc.match_substring(column, MARK))
        fine = ~unsafe.to_numpy(zero_copy_only=False)
        searches = [m.odd.search for m in self.models]
        for k, t in enumerate(column.to_pylist()):
            if (self.lead and (not t or t[0].isspace())) or any([search(t) for search in searches]):
                fine[k] = False
        return fine

    def encode(self, texts: list[str] | pa.Array) -> list[list[np.ndarray]]:
        """For each model, the ids of each text."""
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        out: list[list] = [[None] * len(column) for _ in self.models]
        fine = self._plain(column)
        plain, odd = np.flatnonzero(fine), np.flatnonzero(~fine)
        if len(odd):
            whole = [" " * self.lead + t for t in column.take(pa.array(odd)).to_pylist()]
            for own, model in zip(out, self.models):
                for k, ids in zip(odd.tolist(), model.whole(whole)):
                    own[k] = ids
        if len(plain):
            for own, found in zip(out, self._by_piece(column.take(pa.array(plain)) if len(odd) else column)):
                for k, ids in zip(plain.tolist(), found):
                    own[k] = ids
        return out

    def _places(self, pieces: list[pa.Array]) -> np.ndarray:
        """Where pieces are remembered; new ones are learnt."""
        def look() -> tuple[np.ndarray, pa.Array]:
            # the pieces known come first in the common dictionary, in their order
            coded = pa.concat_arrays([self.known, *pieces]).dictionary_encode()
            return coded.indices.to_numpy()[len(self.known):], coded.dictionary[len(self.known):]

        at, new = look()
        if len(self.known) + len(new) > CACHED_PIECES and len(self.known):
            self._forget()
            at, new = look()
        if len(new):
            self._learn(new)
        self.uses += np.bincount(at, minlength=len(self.uses)) > 0
        return at

    def _by_piece(self, texts: pa.Array) -> list[list[np.ndarray]]:
        if self.lines:
            cut = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " \n"), *CLOSING_RE2)
            texts = pc.if_else(pc.match_substring_regex(texts, UNSAFE_LINE_RE2), texts, cut)
        split = pc.split_pattern(texts, " ")
        offsets, pieces = split.offsets.to_numpy(), [split.values]
        if not self.lead:
            pieces.append(_join(" ", split.values.take(pa.array(offsets[:-1]))))
        place = self._places(pieces)
        if not self.lead:
            place, first = place[:len(split.values)].copy(), place[len(split.values):]
            place[offsets[:-1]] = first
        place = pa.array(place)
        out = []
        for model in self.models:
            _, ends, ids = model.known().take(place).buffers()
            cuts = (np.frombuffer(ends, np.int64)[offsets] // 4).tolist()
            ids = np.frombuffer(ids, np.uint32) if cuts[-1] else np.zeros(0, np.uint32)
            out.append([ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])])
        return out


def byte_level(path: str, specials: bool) -> tuple[Model, dict[str, int]]:
    """(model, vocabulary) of a byte-level BPE file of the tokenizers library.
    ``specials``: strings of added tokens become those tokens, else plain text."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not specials
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content]
    # one with white space could arise where pieces are put together: then every text goes whole
    odd = re.compile("" if any(c.isspace() for t in added for c in t) else "|".join(map(re.escape, added)) or "(?!)")
    # a character of a byte-level token stands for one byte
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
    token_bytes[list(vocab.values())] = [len(t) for t in vocab]
    split = tokenizer.pre_tokenizer
    lines = isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space and tokenizer.normalizer is None
    return Model(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], token_bytes, odd, lines), vocab
