"""Context-mixing range coder for token ids, many blocks at a time.

A block of ``BLOCK`` ids is coded on its own: its models start afresh. For each id the order-2 context (the two ids before
it) and the order-1 context predict one id each, and order 0 predicts the ids lately seen, one for each low byte. The
outcome is order-2 hit, order-1 hit, order-0 hit or none. Its distribution is mixed from three adaptive ones: those kept
for the order-2 confidence, for the order-1 confidence and overall. The weights of the mixture, kept for each pair of
confidences, learn in the block: they move along the gradient of the coding cost of the outcomes. Predictions and confidences
follow every id; distributions, weights and the mixture take up the outcomes of the last ``LEARN`` ids at once (fewer where a
block begins), as they cost more than all else. After an order-0 hit the low byte follows, after none the id, by order-0
counts that are the start of every block's model and stand in the header of the section. Blocks advance in step, one id of
each of ``GROUP`` blocks at a time, as array operations.

The coder keeps a range of 36 to 60 bits, emits words of 24 bits, and settles carries at the end of a block. Ids are below
2**20; others are an error. Decoding repeats the arithmetic of encoding bit by bit: whole numbers, and single float operations
that IEEE 754 rounds alike everywhere.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, GROUP = 2048, 4096
#: Bits of a coder word, least and whole bits of the range; bits of the totals of outcomes, and of ids and low bytes.
WORD, LEAST, STATE, FEW_BITS, ID_BITS = 24, 36, 60, 12, 20
SLOTS_2, SLOTS_1, SLOTS_0, CONFIDENCE, OUTCOMES = 1024, 512, 256, 4, 4
LEARN = 64
#: What an outcome adds to its count, and the total at which counts are halved; of a weight of 256, how far costs move it.
COUNT, MOST, STEP = 16, 4096, 1.2
MAGIC = b"CTXMIX03"

#: The ids of a section are numbered. Where a section has few of them, a number and its confidence take 16 bits.
FEW_IDS = 14
#: Of the hashes of order 2 and order 1: the bits left out below a slot.
_SHIFT = np.array([[32 - SLOTS_2.bit_length() + 1], [32 - SLOTS_1.bit_length() + 1]], np.uint32)
#: After how many ids of a block, and at multiples of LEARN, the mixture is made anew.
_EARLY = {4, 8, 16, 32}
#: Four fields of 16 bits: one in each of the lower three, and their highest bits.
_ONES, _HIGH = np.uint64(0x0000_0001_0001_0001), np.uint64(0x0000_8000_8000_8000)


def counts_to(total_bits: int, counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**total_bits, at least 1 wherever there is a count."""
    seen = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    room = (1 << total_bits) - len(seen)
    share = counts[seen].astype(np.int64) * room // int(counts.sum())
    out[seen] = 1 + share
    out[seen[np.argmax(counts[seen])]] += (1 << total_bits) - int(out.sum())
    return out


class _Model:
    """The models of all lanes, which are the last axis. A prediction is held with its confidence: number + confidence << bits.
    Order 2 and order 1 are two rows of the same arrays, so that a step takes few operations. Outcomes are the first axis of
    counts and odds."""

    def __init__(self, lanes: int, known: int):
        lane, sure = np.arange(lanes), CONFIDENCE
        self.bits, kind = (FEW_IDS, np.uint16) if known <= 1 << FEW_IDS else (ID_BITS, np.int32)
        self.lane, self.outcome_step = lane.astype(np.int32), np.int64(sure * sure * lanes)
        self.of, self.id0 = np.zeros(lanes * (SLOTS_2 + SLOTS_1), kind), np.full(lanes * SLOTS_0, np.iinfo(kind).max, kind)
        self.base, self.base0 = np.stack([lane * SLOTS_2, lanes * SLOTS_2 + lane * SLOTS_1]), lane * SLOTS_0
        self.at, self.hash, self.older = np.zeros((2, lanes), np.int64), np.zeros((2, lanes), np.uint32), np.zeros(lanes, np.uint32)
        self.part = np.array([[sure * lanes], [lanes]], np.int32)
        self.count2, self.count1, self.count0 = (np.full((OUTCOMES, *rows, lanes), COUNT, np.int32) for rows in ((sure,), (sure,), ()))
        two, one = np.array([[40], [96], [136], [168]]), np.array([48, 80, 104, 128])
        self.weight2, self.weight1 = (np.repeat(w[:, :, None], lanes, 2).astype(np.float32) for w in np.broadcast_arrays(two, (256 - two) * one // 192))
        #: Of each outcome for each pair of confidences: where it starts, and its width above 16 bits.
        self.odds = np.zeros((OUTCOMES, sure, sure, lanes), np.uint32)
        self.places, self.steps, self.learned = np.zeros((LEARN, lanes), np.int64), 0, 0
        self._mix()

    def predict(self) -> np.ndarray:
        """The ids that order 2 and order 1 predict, as two rows; sets the place of the pair of confidences among the odds."""
        np.add(self.base, self.hash >> _SHIFT, out=self.at)
        self.now = self.of.take(self.at).astype(np.int32, copy=False)
        k = self.now >> self.bits
        k *= self.part
        self.place = k[0]
        self.place += k[1]
        self.place += self.lane
        return self.now & (1 << self.bits) - 1

    def outcomes(self, few: np.ndarray) -> np.ndarray:
        """The outcomes in whose part of the whole these numbers lie."""
        few = few * _ONES
        few += self.ends.take(self.place)
        few &= _HIGH
        return np.bitwise_count(few)

    def bounds(self, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of outcomes, which are remembered."""
        place = self.places[self.steps % LEARN]
        np.multiply(outcome, self.outcome_step, out=place)
        place += self.place
        both = self.odds.reshape(-1).take(place)
        return (both & np.uint32(0xFFFF)).astype(np.uint64), (both >> np.uint32(16)).astype(np.uint64)

    def update(self, ids: np.ndarray, hits: np.ndarray) -> None:
        """Moves predictions and confidences: a hit makes surer, a miss less sure, and in the end the id is predicted."""
        now, more = self.now, hits.astype(np.int32)
        more <<= self.bits + 1
        more -= 1 << self.bits
        now += more
        np.minimum(now, ids + (CONFIDENCE - 1 << self.bits), out=now)
        np.right_shift(now, 31, out=more)  # all bits where no confidence was left
        more &= now ^ ids
        now ^= more
        self.of[self.at.reshape(-1)] = now.reshape(-1).astype(self.of.dtype, copy=False)
        key = ids.view(np.uint32)
        np.multiply(key, np.uint32(0x9E3779B1), out=self.hash[1])
        np.add(self.hash[1], self.older, out=self.hash[0])
        self.older = key * np.uint32(0x85EBCA77)
        self.steps += 1
        if self.steps % LEARN == 0 or self.steps in _EARLY:
            self._learn()

    def _learn(self) -> None:
        """Takes up the outcomes since the last time."""
        seen = self.places[self.learned % LEARN : (self.steps - 1) % LEARN + 1].reshape(-1)
        self.learned = self.steps
        n = np.bincount(seen, minlength=self.odds.size).astype(np.int32).reshape(self.odds.shape)
        # A weight moves by what its distribution gave the outcomes beyond the overall one, over what the mixture gave them.
        ratio = n.astype(np.float32)
        ratio /= self.width
        overall = self.share0[:, None]
        for weight, more in ((self.weight2, (self.share2 - overall)[:, :, None]), (self.weight1, (self.share1 - overall)[:, None])):
            gain = _sum(ratio * more.astype(np.float32))
            gain *= np.float32(STEP)
            weight += np.clip(gain, np.float32(-16), np.float32(16), out=gain)
        np.clip(self.weight2, np.float32(4), np.float32(248), out=self.weight2)
        np.clip(self.weight1, np.float32(4), np.float32(252) - self.weight2, out=self.weight1)
        n *= COUNT
        by_2, by_1 = n.swapaxes(0, 2), n.swapaxes(0, 1)
        two = _sum(by_2).swapaxes(0, 1)
        self.count2 += two
        self.count1 += _sum(by_1)
        self.count0 += _sum(two.swapaxes(0, 1))
        for count in (self.count2, self.count1, self.count0):
            big = (_sum(count) > MOST).astype(np.int32)
            count >>= big
            count |= big
        self._mix()

    def _mix(self) -> None:
        """Odds from the counts: shares of a whole of 4096, mixed by weights of 256."""
        self.share2, self.share1, self.share0 = (c * ((1 << 24) // _sum(c)) >> 24 - FEW_BITS for c in (self.count2, self.count1, self.count0))
        two, one = self.weight2.astype(np.int32), self.weight1.astype(np.int32)
        some = two * self.share2[:3, :, None]
        some += one * self.share1[:3, None]
        two += one
        some += (256 - two) * self.share0[:3, None, None]
        some -= some >> 6
        some >>= 8
        some += 4
        ends, self.width = np.empty_like(some), np.empty(self.odds.shape, np.float32)
        ends[0] = some[0]
        np.add(some[0], some[1], out=ends[1])
        np.add(ends[1], some[2], out=ends[2])
        self.width[:3] = some
        np.subtract(1 << FEW_BITS, ends[2], out=self.width[3], casting="unsafe")
        some <<= 16
        some[1:] += ends[:2]
        self.odds[:3] = some
        self.odds[3] = ends[2] + ((1 << FEW_BITS) - ends[2] << 16)
        high = ends[2].astype(np.uint64)
        high <<= np.uint64(32)
        ends[1] <<= 16
        ends[1] += ends[0]
        high += ends[1].view(np.uint32)
        self.ends = np.subtract(_HIGH, high, out=high).reshape(-1)


def _sum(x: np.ndarray) -> np.ndarray:
    """The sum of four parts, in an order that is always the same."""
    return (x[0] + x[1]) + (x[2] + x[3])


def _tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts and cumulative counts of the ids and of their low bytes."""
    low = counts_to(ID_BITS, np.bincount(np.arange(len(freq)) & SLOTS_0 - 1, weights=freq, minlength=SLOTS_0).astype(np.int64))
    return freq, np.cumsum(freq) - freq, low, np.cumsum(low) - low


def encode(ids: np.ndarray) -> bytes:
    """A file section: header, counts, block directory and blocks."""
    n, lanes = len(ids), max(1, -(-len(ids) // BLOCK))
    if not n:
        return MAGIC + struct.pack("<QII", 0, 0, 0)
    if int(ids.min()) < 0 or int(ids.max()) >= 1 << ID_BITS:
        raise ValueError(f"ids must be from 0 to {(1 << ID_BITS) - 1}")
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    number = np.zeros(len(counts), np.int32)
    number[used] = np.arange(len(used))
    freq = counts_to(ID_BITS, counts[used])
    size_of, begin_of, low_size, low_begin = _tables(freq)
    # What follows an outcome, as begin + width << 32: nothing (the whole range) after a hit of order 2 or 1, the low byte, the id.
    slot, whole = np.arange(len(freq)) & SLOTS_0 - 1, np.full(len(freq), 1 << ID_BITS)
    parts = np.concatenate([whole << 32, whole << 32, low_begin[slot] + (low_size[slot] << 32), begin_of + (size_of << 32)]).astype(np.uint64)
    padded = np.full(lanes * BLOCK, ids[-1], np.int32)
    padded[:n] = ids
    blocks = number.take(padded).reshape(lanes, BLOCK)
    bodies = [body for k in range(0, lanes, GROUP) for body in _coded(blocks[k : k + GROUP], parts, len(freq))]
    table = zlib.compress(np.concatenate([used, freq]).astype("<u4").tobytes(), 6)
    directory = np.column_stack([[len(b) // 3 for b in bodies], [zlib.crc32(b) for b in bodies], [zlib.crc32(padded[k * BLOCK : min(n, (k + 1) * BLOCK)].astype("<u4").tobytes()) for k in range(lanes)]]).astype("<u4").tobytes()
    return b"".join([MAGIC, struct.pack("<QII", n, lanes, len(table)), table, directory, *bodies])


def _coded(blocks: np.ndarray, parts: np.ndarray, known: int) -> list[bytes]:
    """Coded blocks, given what follows each of the outcomes for each of the known ids."""
    lanes, u = len(blocks), np.uint64
    model, lane = _Model(lanes, known), np.arange(lanes)
    low, span = np.zeros(lanes, u), np.full(lanes, 1 << STATE, u)
    of_lane, words = [], []  # words in the order in which they came, and their lanes
    steps = np.empty((BLOCK, lanes), np.int32)
    for k in range(0, lanes, 32):
        steps[:, k : k + 32] = blocks[k : k + 32].T
    for now in steps:
        hits = model.predict() == now
        at = model.base0 + (now & SLOTS_0 - 1)
        hit0 = model.id0.take(at) == now
        model.id0[at] = now.astype(model.id0.dtype)
        as_8 = hits.view(np.uint8)
        outcome = np.minimum(3 - as_8[0] * 3, 3 - as_8[1] * 2)
        np.minimum(outcome, 3 - hit0.view(np.uint8), out=outcome)
        start, width = model.bounds(outcome)
        at = outcome * np.int64(known)
        at += now
        part = parts.take(at)
        unit = span >> u(FEW_BITS + ID_BITS)
        begin = part & u(0xFFFFFFFF)
        begin *= width
        start <<= u(ID_BITS)
        begin += start
        begin *= unit
        low += begin
        part >>= u(32)
        part *= width
        part *= unit
        span = part
        less = np.flatnonzero(span < u(1 << LEAST))
        while len(less):  # a carry stays above bit 60 and leaves with the next word
            some = low.take(less)
            of_lane.append(less.astype(np.uint16))
            words.append((some >> u(STATE - WORD)).astype(np.int32))
            some &= u((1 << STATE - WORD) - 1)
            some <<= u(WORD)
            low[less] = some
            wide = span.take(less) << u(WORD)
            span[less] = wide
            less = less[wide < u(1 << LEAST)]
        model.update(now, hits)
    for word in (low >> u(36), low >> u(12) & u((1 << WORD) - 1), (low << u(12)) & u((1 << WORD) - 1)):
        of_lane.append(lane.astype(np.uint16))
        words.append(word.astype(np.int32))
    of_lane = np.concatenate(of_lane)
    out = np.concatenate(words).take(np.argsort(of_lane, kind="stable"))
    while len(over := np.flatnonzero(out >> WORD)):
        out[over] &= (1 << WORD) - 1
        out[over - 1] += 1
    as_bytes = np.ascontiguousarray(out.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)[:, :3])
    edges = np.concatenate([[0], np.cumsum(np.bincount(of_lane, minlength=lanes))])
    return [as_bytes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Corrupt(ValueError):
    """A block's checksum doesn't hold."""


def decode(data: bytes) -> np.ndarray:
    """The ids of a file section; ``Corrupt`` if a checksum of stored or decoded blocks doesn't hold."""
    if data[:8] != MAGIC:
        raise Corrupt("not a section of coded ids")
    n, lanes, length = struct.unpack_from("<QII", data, 8)
    if not n:
        return np.zeros(0, np.int32)
    at = 24 + length
    used, freq = np.frombuffer(zlib.decompress(data[24:at]), "<u4").reshape(2, -1).astype(np.int64)
    directory = np.frombuffer(data, "<u4", lanes * 3, at).reshape(lanes, 3)
    edges = at + lanes * 12 + 3 * np.concatenate([[0], np.cumsum(directory[:, 0].astype(np.int64))])
    size_of, begin_of, low_size, low_begin = _tables(freq)
    # Symbols: low bytes, then ids, then that nothing follows. What they cover of the counts, and as begin + width << 32.
    last = SLOTS_0 + len(freq)
    symbols = np.repeat(np.arange(last + 1, dtype=np.uint16 if last < 1 << 16 else np.int32), np.concatenate([low_size, size_of, [1]]))
    parts = np.concatenate([low_begin + (low_size << 32), begin_of + (size_of << 32), [1 << 32 + ID_BITS]]).astype(np.uint64)
    ids = np.empty((lanes, BLOCK), np.int32)
    for first in range(0, lanes, GROUP):
        bodies = [data[edges[k] : edges[k + 1]] for k in range(first, min(first + GROUP, lanes))]
        for k, body in enumerate(bodies, first):
            if zlib.crc32(body) != directory[k, 1]:
                raise Corrupt(f"block {k} was changed")
        _decode(bodies, symbols, parts, ids[first : first + GROUP])
    ids = used.astype(np.int32).take(ids.reshape(-1)[:n])
    for k in range(lanes):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4", copy=False)) != directory[k, 2]:
            raise Corrupt(f"block {k} decodes to other ids")
    return ids


def _decode(bodies: list[bytes], symbols: np.ndarray, parts: np.ndarray, ids: np.ndarray) -> None:
    """Decodes blocks to rows of ids, given the symbol of each count (those of low bytes, of ids, and one for nothing) and what
    each symbol covers."""
    lanes, u = len(bodies), np.uint64
    words = np.zeros((lanes, max(map(len, bodies)) // 3 + 4), np.int32)
    for k, body in enumerate(bodies):
        words[k].view(np.uint8).reshape(-1, 4)[: len(body) // 3, :3] = np.frombuffer(body, np.uint8).reshape(-1, 3)
    model = _Model(lanes, len(parts) - SLOTS_0 - 1)
    # By outcome: the bits of a count that tell the symbol, and where its symbols begin.
    seen, past = np.array([0, 0, (1 << ID_BITS) - 1, (1 << ID_BITS) - 1], u), np.array([2 << ID_BITS, 2 << ID_BITS, 0, 1 << ID_BITS], u)
    span = np.full(lanes, 1 << STATE, u)
    head = words[:, :3].astype(u)
    left, tail = head[:, 0] << u(36) | head[:, 1] << u(12) | head[:, 2] >> u(12), head[:, 2] & u(0xFFF)
    read, words = np.arange(lanes) * words.shape[1] + 3, words.reshape(-1)
    steps = np.zeros((64, lanes), np.int32)
    for t in range(BLOCK):
        guess = model.predict()
        unit = span >> u(FEW_BITS + ID_BITS)
        value = left // unit
        outcome = model.outcomes(value >> u(ID_BITS))
        first, room = model.bounds(outcome)
        value -= first << u(ID_BITS)
        value //= room
        value &= seen.take(outcome)
        value += past.take(outcome)
        symbol = symbols.take(value.view(np.int64))
        part = parts.take(symbol)
        now = symbol.astype(np.int32)
        now -= SLOTS_0
        some = np.flatnonzero(outcome == 2)
        now[some] = model.id0.take(model.base0.take(some) + symbol.take(some))
        for order in (1, 0):
            np.copyto(now, guess[order], where=outcome == order)
        begin = part & u(0xFFFFFFFF)
        begin *= room
        first <<= u(ID_BITS)
        begin += first
        begin *= unit
        left -= begin
        part >>= u(32)
        part *= room
        part *= unit
        span = part
        less = np.flatnonzero(span < u(1 << LEAST))
        while len(less):  # reads on where the range has become small
            at = read.take(less)
            word = words.take(at, mode="clip").astype(u)
            rest = tail.take(less)
            left[less] = left.take(less) << u(WORD) | rest << u(12) | word >> u(12)
            tail[less] = word & u(0xFFF)
            read[less] = at + 1
            wide = span.take(less) << u(WORD)
            span[less] = wide
            less = less[(wide < u(1 << LEAST)) & (wide > 0)]
        steps[t % 64] = now
        if t % 64 == 63:
            ids[:, t - 63 : t + 1] = steps.T
        model.id0[model.base0 + (now & SLOTS_0 - 1)] = now.astype(model.id0.dtype)
        model.update(now, guess == now)
