"""Adaptive context-mixing range coder for token ids.

A segment is a run of ids, cut into blocks of equal length. Every block is
coded on its own: its models start from the segment's id weights, and it
carries a crc32 of its ids, so a damaged block is found and the others still
decode. As blocks do not depend on each other, all of a segment's blocks are
coded side by side, one id of each at a time, as numpy vectors.

The probability of an id mixes three predictions, each learnt within the block:

* order 2: the id that last followed the two ids before,
* order 1: the id that last followed the id before,
* order 0: the segment's id weights plus the block's own counts, which are
  refreshed at fixed places.

How much probability an order-1 or order-2 prediction gets follows from how
often predictions of the same confidence have come true in this block. Orders 2
and 1 have their parts at the low end of the distribution, order 0 shares out
the rest; an id that stands in more than one part is coded in a larger one.
Integers only, so both sides compute the same numbers anywhere.

The range coder keeps 56 bits of the low end and emits 16-bit digits. A carry
out of the low end stays in the digit emitted last and is added up once a
block is complete.

Steps are kept to few calls of numpy and to narrow integers: what of the encoder does
not follow from the step before is computed for many steps at once, and the decoder
finds ids in order 0 from a table. No number exceeds 2 ** 58.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
TOTAL_BITS = 24
TOTAL = 1 << TOTAL_BITS
SPIKES = TOTAL - (1 << 18)  # most that orders 1 and 2 may take together: 252 / 256
PRIOR_TOTAL = 1 << 17
GAIN = 16  # weight of one occurrence within a block
REFRESH = (256, 1024)
SLOT_BITS = 11
SLOT_MASK = (1 << SLOT_BITS) - 1
TOP = 1 << 40
LOW_MASK = TOP - 1
CELLS = 4 << 20  # order-0 cells in memory: lanes x ids
STRETCH = 32  # steps that the encoder computes at once
AT_ONCE = 16  # lanes whose order 0 is refreshed at once
MAGIC = b"IDCM"
VERSION = 2
HEAD = "<4sBIII"

# An entry of orders 1 and 2 is 8 * id + confidence. Confidence 0 stands only where no id has come yet.
NO_ID = 0x7FFFFFF8
# Chance that a prediction of confidence 0 to 7 comes true, in 1/65536.
START_RATES = np.array([0, 2000, 8000, 20000, 30000, 40000, 50000, 58000], dtype=np.int32)
# By state (the confidence after a hit, 8 more after a miss): what the chance moves to, and
# how the entry changes; one whose confidence becomes 0 gives its place to the new id.
HIT_RATE = np.array([65535] * 8 + [0] * 8, dtype=np.int32)
CONF_STEP = np.array([0, 1, 1, 1, 1, 1, 1, 0, 0, -1, -1, -2, -2, -3, -3, -4], dtype=np.int32)


class Lanes:
    """The models of a group of blocks. ``weights``: the segment's id weights,
    largest first, so that the cells used most lie together. Arrays of two rows
    hold orders 1 and 2."""

    def __init__(self, n: int, weights: np.ndarray):
        self.n, self.size = n, len(weights)
        self.first = np.concatenate([[0], np.cumsum(weights)])
        self.total = int(self.first[-1])
        # order 0: weight of the ids below each id; a row of ids per lane
        self.grid = np.empty((n, self.size + 1), dtype=np.int32)
        self.grid[:] = self.first
        self.cells = self.grid.reshape(-1)
        # one row of lanes per slot, as the lanes use much the same few ids
        self.slots = np.full(2 * n << SLOT_BITS, NO_ID, dtype=np.int32)
        self.rates = np.tile(START_RATES, 2 * n)
        self.before = (np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64))
        self.shrink(n)

    def shrink(self, m: int) -> None:
        """Go on with the first ``m`` lanes (the last block is shorter)."""
        lane = np.arange(m, dtype=np.int64)
        self.row = lane * (self.size + 1)
        self.slot_row = np.stack([lane, lane + (self.n << SLOT_BITS)])
        self.rate_row = np.stack([8 * lane, 8 * lane + 8 * self.n]).astype(np.int32)
        self.before = (self.before[0][:m], self.before[1][:m])

    def places(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slots of orders 1 and 2 after ``two`` and ``one`` (any rows of lanes)."""
        at = np.empty((*one.shape[:-1], 2, one.shape[-1]), dtype=np.int64)
        at[..., 0, :] = one
        np.multiply(two, 1265, out=at[..., 1, :])
        at[..., 1, :] += one
        at &= SLOT_MASK
        at *= self.n
        at += self.slot_row
        return at

    def learn(self, at: np.ndarray, entry: np.ndarray, conf: np.ndarray, rate_at: np.ndarray, rate: np.ndarray,
              id8: np.ndarray) -> None:
        """The ids that came, times 8, against the entries that foretold them."""
        state = np.minimum(entry ^ id8, conf | 8)
        moved = HIT_RATE.take(state, mode="clip")
        moved -= rate
        moved >>= 5
        moved += rate
        self.rates[rate_at] = moved
        new = CONF_STEP.take(state, mode="clip")
        new += entry
        np.copyto(new, id8 + 1, where=(new & 7) == 0)
        self.slots[at] = new

    def foretell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, rates) of orders 1 and 2 before each of ``ids``, [step, lane], which are learnt."""
        known = np.concatenate([self.before[1][None], self.before[0][None], ids])
        self.before = (known[-1], known[-2])
        at, id8 = self.places(known[1:-1], known[:-2]), (ids << 3).astype(np.int32)
        entries, rates = np.empty(at.shape, np.int32), np.empty(at.shape, np.int32)
        for place, entry, rate, new in zip(at, entries, rates, id8):
            self.slots.take(place, out=entry, mode="clip")
            conf = entry & 7
            rate_at = conf + self.rate_row
            self.rates.take(rate_at, out=rate, mode="clip")
            self.learn(place, entry, conf, rate_at, rate, new)
        return entries, rates

    def refresh(self, seen: np.ndarray) -> None:
        """Order 0 anew, with the counts of the ids ``seen`` so far: [step, lane]."""
        self.total = int(self.first[-1]) + GAIN * len(seen)
        width = self.size + 1
        for k in range(0, self.n, AT_ONCE):
            part = seen[:, k:k + AT_ONCE]
            m = part.shape[1]
            counts = np.bincount((part + (np.arange(m) * width + 1)).reshape(-1), minlength=width * m)
            counts *= GAIN
            below = np.cumsum(counts.reshape(m, width), axis=1)
            below += self.first
            self.grid[k:k + AT_ONCE] = below


def parts_of(rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of orders 2 and 1; the rates' last axis but one holds orders 1 and 2."""
    second = rate[..., 1, :] * np.int64(SPIKES >> 16)
    first = SPIKES - second
    first *= rate[..., 0, :]
    first >>= 16
    return second, first


class Finder:
    """Finds ids in order 0: a table over equal pieces of the distribution
    (smaller ones towards its end, where ids are rare) tells where to begin."""

    def __init__(self, model: Lanes):
        self.model = model
        self.renew(same=True)

    def _piece(self, x: np.ndarray) -> np.ndarray:
        shift, _, _ = self.scales[0]
        piece = x >> shift
        for shift, start, ahead in self.scales[1:]:
            finer = x - start
            finer >>= shift
            finer += ahead
            np.maximum(piece, finer, out=piece)
        return piece

    def renew(self, same: bool = False) -> None:
        """After order 0 has changed; ``same``: all lanes have the first lane's."""
        model, total = self.model, self.model.total
        widest = max(0, total.bit_length() - 11)
        # (shift, start, pieces ahead): pieces of the last quarter and the last sixteenth are smaller
        self.scales = [(widest, 0, 0)]
        for part, shift in ((2, widest - 2), (4, widest - 5)):
            before, begun, ahead = self.scales[-1]
            start = (total - (total >> part)) >> widest << widest
            self.scales.append((max(0, shift), start, ahead + ((start - begun) >> before)))
        pieces = int(self._piece(np.array([total]))[0]) + 1
        # the last id that begins before each piece, if any
        self.table = np.zeros((model.n, pieces + 1), dtype=np.uint16 if model.size <= 1 << 16 else np.int32)
        grid = model.grid[:1] if same else model.grid
        for k in range(0, len(grid), AT_ONCE):
            piece = self._piece(grid[k:k + AT_ONCE, :-1])
            m = len(piece)
            piece += (np.arange(m, dtype=np.int32) * pieces)[:, None]
            counts = np.bincount(piece.reshape(-1), minlength=m * pieces).reshape(m, pieces)
            begins = np.cumsum(counts, axis=1)
            begins -= 1
            self.table[k:k + AT_ONCE, 1:] = begins
        if same:
            self.table[1:] = self.table[0]
        self.flat = self.table.reshape(-1)
        self.row = np.arange(model.n, dtype=np.int64) * (pieces + 1)

    def find(self, weight: np.ndarray) -> np.ndarray:
        """Cells of the last ids with at most ``weight`` below them."""
        cells, row = self.model.cells, self.model.row
        at = self._piece(weight)
        at += self.row[:len(weight)]
        found = row + self.flat.take(at, mode="clip")
        more = cells.take(found + 1, mode="clip") <= weight
        found += more
        rest = np.flatnonzero(more)
        for _ in range(2):
            if not len(rest):
                return found
            rest = rest[cells.take(found[rest] + 1) <= weight[rest]]
            found[rest] += 1
        if len(rest):
            low, high, weight = found[rest], self.flat.take(at[rest] + 1) + row[rest], weight[rest]
            gap = int((high - low).max())
            while gap > 0:
                middle = (low + high + 1) >> 1
                fits = cells.take(middle) <= weight
                low = np.where(fits, middle, low)
                high = np.where(fits, high, middle - 1)
                gap >>= 1
            found[rest] = low
        return found


def _encode_lanes(ids: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> list[bytes]:
    """ids: [lane, step] as ranks; only the last lane may be shorter."""
    n, steps = ids.shape
    model = Lanes(n, weights)
    low, span = np.zeros(n, np.int64), np.full(n, 1 << 56, np.int64)
    room = steps * TOTAL_BITS // 16 + 8  # an id takes TOTAL_BITS at most
    digits = np.zeros(n * room, dtype=np.int32)
    at = np.arange(n, dtype=np.int64) * room
    columns = np.ascontiguousarray(ids.T)
    last = int(lengths[-1])
    marks = sorted({0, steps, *(x for x in REFRESH if x < steps)})
    for since, until in zip(marks[:-1], marks[1:]):
        if since:
            model.refresh(columns[:since])
        # order 0 stays as it is from mark to mark; lane by lane its cells are near each other
        cell = ids[:, since:until] + (np.arange(n) * (model.size + 1))[:, None]
        begin = model.cells.take(cell)
        cell += 1
        order0 = np.ascontiguousarray(begin.T), np.ascontiguousarray((model.cells.take(cell) - begin).T)
        cuts = sorted({*range(since, until, STRETCH), until, *([last] if since < last < until else [])})
        for a, b in zip(cuts[:-1], cuts[1:]):
            m = n - (a >= last)
            if m < len(model.row):
                model.shrink(m)
            begin, width = (x[a - since:b - since, :m].astype(np.int64) for x in order0)
            _encode_stretch(model, columns[a:b, :m].astype(np.int64), begin, width, low[:m], span[:m], at[:m], digits)
    for _ in range(4):  # the rest of the low end
        digits[at] = low >> 40
        at += 1
        low = (low & LOW_MASK) << 16
    over = np.flatnonzero(digits >> 16)
    while len(over):
        digits[over] &= 0xFFFF
        over -= 1
        digits[over] += 1
        over = over[digits[over] > 0xFFFF]
    out = digits.astype("<u2")
    return [out[k * room:end].tobytes() for k, end in enumerate(at.tolist())]


def _encode_stretch(model: Lanes, ids: np.ndarray, begin: np.ndarray, width: np.ndarray, low: np.ndarray, span: np.ndarray,
                    at: np.ndarray, digits: np.ndarray) -> None:
    """Code ``ids``, [step, lane], which begin and are as wide in order 0 as told."""
    entries, rates = model.foretell(ids)
    second, first = parts_of(rates)
    offset = second + first
    rest = TOTAL - offset
    plain = (width * rest) // model.total
    entries >>= 3
    by_one = (entries[:, 0] == ids) & (first > plain)
    by_two = (entries[:, 1] == ids) & (second > plain)
    by_one &= ~by_two
    # An id begins at offset units and begin shares, and is width shares wide. Units are parts of the
    # span, shares those of order 0 in what is left; in the parts of orders 2 and 1, shares are units.
    for by, start, spike in ((by_one, second, first), (by_two, 0, second)):
        np.copyto(offset, start, where=by)
        np.copyto(begin, 0, where=by)
        np.copyto(width, spike, where=by)
        np.copyto(rest, model.total, where=by)
    for off, left, start, wide in zip(offset, rest, begin, width):
        unit = span >> TOTAL_BITS
        off *= unit
        low += off
        left *= unit
        share = left // model.total
        start *= share
        low += start
        np.multiply(share, wide, out=span)
        # a digit is final where the span is short; elsewhere it will be written again
        digit = low >> 40
        digits[at] = digit
        short = span - TOP
        short >>= 63
        digit <<= 40
        digit &= short
        low -= digit
        at -= short
        short &= 0xFFFF
        short += 1
        low *= short
        span *= short
        if span.min() < TOP:  # a second digit, seldom
            again = np.flatnonzero(span < TOP)
            digits[at[again]] = low[again] >> 40
            at[again] += 1
            low[again] = (low[again] & LOW_MASK) << 16
            span[again] <<= 16


def _decode_lanes(codes: list[bytes], lengths: np.ndarray, weights: np.ndarray) -> np.ndarray:
    n, steps = len(codes), int(lengths.max())
    model = Lanes(n, weights)
    finder = Finder(model)
    room = max(len(c) for c in codes) // 2 + 8
    digits = np.zeros((n, room), dtype=np.int64)
    for k, c in enumerate(codes):
        digits[k, :len(c) // 2] = np.frombuffer(c, "<u2")
    # the first digit stands for bits 40 to 55, and digits are taken 16 bits at a time at an offset of 8 bits
    code = (digits[:, 0] << 40) | (digits[:, 1] << 24) | (digits[:, 2] << 8) | (digits[:, 3] >> 8)
    halves = (((digits[:, :-1] & 0xFF) << 8) | (digits[:, 1:] >> 8)).astype(np.uint16).reshape(-1)
    span = np.full(n, 1 << 56, np.int64)
    at = np.arange(n, dtype=np.int64) * (room - 1) + 3
    out = np.zeros((steps, n), dtype=np.int32)
    for t in range(steps):
        if t == lengths[-1]:
            model.shrink(n - 1)
            code, span, at = code[:-1], span[:-1], at[:-1]
        one, two = model.before
        place = model.places(one, two)
        entry = model.slots.take(place, mode="clip")
        conf = entry & 7
        rate_at = conf + model.rate_row
        rate = model.rates.take(rate_at, mode="clip")
        second, first = parts_of(rate)
        offset = second + first
        unit = span >> TOTAL_BITS
        # order 0, as if all ids stood in its part
        rest = TOTAL - offset
        rest *= unit
        share = rest // model.total
        offset *= unit
        by_one = code < offset
        left = code - offset
        target = np.minimum(left.view(np.uint64) // share.view(np.uint64), np.uint64(model.total - 1)).view(np.int64)
        cell = finder.find(target)
        begin = model.cells.take(cell, mode="clip")
        ids = cell - model.row
        cell += 1
        width = model.cells.take(cell, mode="clip")
        width -= begin
        begin = begin * share
        span = width * share
        # ids in the parts of orders 2 and 1
        second_end = second * unit
        by_two = code < second_end
        guess = entry >> 3
        first *= unit
        for by, k, start, wide in ((by_one, 0, second_end, first), (by_two, 1, 0, second_end)):
            np.copyto(ids, guess[k], where=by)
            np.copyto(left, code - start, where=by)
            np.copyto(begin, 0, where=by)
            np.copyto(span, wide, where=by)
        code = left
        code -= begin
        short = span - TOP
        while True:
            short >>= 63
            digit = halves.take(at, mode="clip") & short
            at -= short
            short &= 0xFFFF
            short += 1
            code *= short
            code += digit
            span *= short
            if span.min() >= TOP:
                break
            short = span - TOP
        out[t, :len(ids)] = ids
        model.learn(place, entry, conf, rate_at, rate, (ids << 3).astype(np.int32))
        model.before = (ids, one)
        if t + 1 in REFRESH and t + 1 < steps:
            model.refresh(out[:t + 1])
            finder.renew()
    return out.T


def _groups(n_blocks: int, n_ids: int) -> list[tuple[int, int]]:
    """Blocks are coded in groups that keep memory bounded."""
    width = max(1, CELLS >> n_ids.bit_length())  # a power of two
    return [(a, min(n_blocks, a + width)) for a in range(0, n_blocks, width)]


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment: head, id weights, block directory, blocks."""
    ids = np.asarray(ids, dtype=np.uint32)
    n = len(ids)
    if not n:
        return struct.pack(HEAD, MAGIC, VERSION, 0, block, 0)
    counts = np.bincount(ids)
    known = np.flatnonzero(counts)
    known = known[np.argsort(-counts[known], kind="stable")]
    weights = 1 + counts[known] * max(0, PRIOR_TOTAL - len(known)) // n
    rank_of = np.zeros(len(counts), dtype=np.int32)
    rank_of[known] = np.arange(len(known))
    table = zlib.compress(known.astype("<u4").tobytes() + weights.astype("<u4").tobytes(), 6)
    n_blocks = -(-n // block)
    lengths = np.full(n_blocks, block)
    lengths[-1] = n - block * (n_blocks - 1)
    padded = np.zeros(n_blocks * block, dtype=np.int32)
    padded[:n] = rank_of[ids]
    grid = padded.reshape(n_blocks, block)
    codes: list[bytes] = []
    for a, b in _groups(n_blocks, len(known)):
        codes += _encode_lanes(grid[a:b, :lengths[a]], lengths[a:b], weights)
    raw = ids.astype("<u4")
    sums = [zlib.crc32(raw[k * block:(k + 1) * block]) for k in range(n_blocks)]
    directory = np.array([[s, len(c)] for s, c in zip(sums, codes)], dtype="<u4").tobytes()
    return struct.pack(HEAD, MAGIC, VERSION, n, block, len(table)) + table + directory + b"".join(codes)


def decode(data: bytes) -> np.ndarray:
    """The ids of one segment; a block whose checksum differs fails."""
    magic, version, n, block, table_size = struct.unpack_from(HEAD, data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of coded ids")
    if not n:
        return np.zeros(0, np.uint32)
    at = struct.calcsize(HEAD)
    table = np.frombuffer(zlib.decompress(data[at:at + table_size]), "<u4").reshape(2, -1)
    at += table_size
    known, weights = table[0], table[1].astype(np.int64)
    n_blocks = -(-n // block)
    directory = np.frombuffer(data, "<u4", 2 * n_blocks, at).reshape(n_blocks, 2)
    at += 8 * n_blocks
    ends = at + np.cumsum(directory[:, 1], dtype=np.int64)
    codes = [data[e - size:e] for e, size in zip(ends.tolist(), directory[:, 1].tolist())]
    lengths = np.full(n_blocks, block)
    lengths[-1] = n - block * (n_blocks - 1)
    out = np.empty(n, np.uint32)
    for a, b in _groups(n_blocks, len(known)):
        ranks = _decode_lanes(codes[a:b], lengths[a:b], weights)
        flat = known[np.minimum(ranks, len(known) - 1)].reshape(-1)
        out[a * block:a * block + lengths[a:b].sum()] = flat[:lengths[a:b].sum()] if b - a > 1 or lengths[a] == block else flat
    raw = out.astype("<u4")
    for k, said in enumerate(directory[:, 0].tolist()):
        if zlib.crc32(raw[k * block:(k + 1) * block]) != said:
            raise ValueError(f"the checksum of block {k} differs")
    return out
