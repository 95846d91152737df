"""Adaptive context-mixing range coder for token ids below 65,536.

A frame's ids are cut into blocks; each block starts from a fresh model and has
a checksum of its own, so with the frame's header any block stands alone. All
blocks of a frame are coded in step, one lane each, as NumPy rows.

An id is coded as which of the predictions holds: the id that last followed the
two ids before it (order 2), the one that last followed the id before it (order
1), or neither; then it follows by its order-0 share, which the header states.
How far the orders are trusted is learned per state of both predictions, which
mixes the three into one distribution that changes with every id. Its shares sum
to ``TOTAL``, so a range is narrowed once per id, by shifts and products.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 1024
ORDER1, ORDER2 = 1 << 8, 1 << 9
STATES = 32
SHARES = 1 << 16  # order-0 shares sum to this
FLAGS = 1 << 14  # the shares of order 2, of order 1 and of neither sum to this
RATE = 5  # a bound moves by 1 / 2 ** RATE of its way
LEAST = 2  # of a gain; keeps each of the three shares above 0
EACH = ((FLAGS >> RATE) - 1) * 0x10001  # what both bounds of a pair lose: their high bits
# Both bounds gain this if neither order holds, with one, and with order 2.
GAIN = (LEAST << 16 | 2 * LEAST, (FLAGS >> RATE) - 3 * LEAST,
        (FLAGS >> RATE) - 3 * LEAST << 16)
TOTAL_BITS = 30
TOTAL = LOW = FLAGS * SHARES  # a range of at least this width can part any two ids
FIRST_BOUNDS = np.full(STATES, FLAGS // 3 << 16 | 2 * FLAGS // 3, np.int32)
MAGIC = b"TKID4\n"


class Shares:
    """Order-0 shares of a frame's ids: at least one each, summing to ``SHARES``."""

    def __init__(self, ids: np.ndarray, share: np.ndarray):
        self.ids, self.share = ids, share
        ends = np.cumsum(share)
        # by id: what lies below it, and its share less one, in 16 bits each
        self.placed = np.zeros(1 << 16, np.int32)
        self.placed[ids] = (ends - share << 16 | share - 1).astype(np.uint32).view(np.int32)
        self.at = np.repeat(ids.astype(np.uint16), share)

    @classmethod
    def of(cls, ids: np.ndarray) -> Shares:
        count = np.bincount(ids)
        kinds = np.flatnonzero(count)
        count = count[kinds]
        free = SHARES - len(kinds)
        share = 1 + (count * free) // max(int(count.sum()), 1)
        if len(kinds):
            share[np.argmax(count)] += SHARES - share.sum()
        return cls(kinds, share)

    def pack(self) -> bytes:
        return zlib.compress(struct.pack("<I", len(self.ids)) + self.ids.astype("<u2").tobytes()
                             + (self.share - 1).astype("<u2").tobytes())

    @classmethod
    def unpack(cls, data: bytes) -> Shares:
        raw = zlib.decompress(data)
        n = struct.unpack_from("<I", raw)[0]
        return cls(np.frombuffer(raw, "<u2", n, 4).astype(np.int64),
                   np.frombuffer(raw, "<u2", n, 4 + 2 * n).astype(np.int64) + 1)


def mask(hit: np.ndarray) -> np.ndarray:
    """All bits where a hit is, none elsewhere; copies by condition take eight times as long."""
    return -hit.astype(np.int32)


class Model:
    """The adaptive state of n lanes, in flat tables; slots are flat positions.

    A guess is an id times four plus its trust, 0 to 3: how often it came, one after
    the other. ``bounds`` holds for each state of both guesses where the shares of order
    2 and of order 1 end, out of ``FLAGS``; they lose a part and gain that part of what
    came (``GAIN``), so the shares always sum to ``FLAGS``.
    """

    def __init__(self, n: int):
        row = np.arange(n, dtype=np.int32)  # slots fit 32 bits up to 4 Mi lanes, 4 Gi ids
        self.base2, self.base1 = row * ORDER2, row * ORDER1
        self.base_flag = row * STATES
        self.guess2, self.guess1 = np.zeros(n * ORDER2, np.int32), np.zeros(n * ORDER1, np.int32)
        self.bounds = np.tile(FIRST_BOUNDS, n)
        self.last, self.before = np.zeros(n, np.int32), np.zeros(n, np.int32)

    def predict(self, n: int):
        """Slots, guesses with their trust, the ids guessed, and the bounds of their shares."""
        last = self.last[:n] * 40503  # its high bits may wrap
        slot2 = (((last + self.before[:n] * 30011) >> 3 & (ORDER2 - 1))
                 + self.base2[:n]).astype(np.int64)
        slot1 = ((last >> 5 & (ORDER1 - 1)) + self.base1[:n]).astype(np.int64)
        held2, held1 = self.guess2.take(slot2), self.guess1.take(slot1)
        two, one = held2 >> 2, held1 >> 2
        trust2, trust1 = held2 & 3, held1 & 3
        state = ((trust2 << 3 | trust1 << 1) + self.base_flag[:n] | (two == one)).astype(np.int64)
        return slot2, slot1, trust2, trust1, two, one, state, self.bounds.take(state)

    def learn(self, n, seen, hit2, hit1, ids):
        slot2, slot1, trust2, trust1, _, _, state, bounds = seen
        hit2, hit1 = mask(hit2), mask(hit1)
        self.bounds[state] = (bounds - (bounds >> RATE & EACH) + GAIN[0]
                              + ((hit2 | hit1) & GAIN[1]) + (hit2 & GAIN[2]))
        fresh = ids << 2
        self.guess2[slot2] = fresh | np.minimum(trust2 + 1, 3) & hit2
        self.guess1[slot1] = fresh | np.minimum(trust1 + 1, 3) & hit1
        self.before[:n] = self.last[:n]
        self.last[:n] = ids


def interval(order2, guessed, bounds, placed):
    """Where an id lies in 0..TOTAL, and its width there; a literal takes its order-0 share.

    ``order2`` and ``guessed`` (by either order) are masks, ``placed`` is of ``Shares``.
    """
    first, second = bounds >> 16, bounds & 0xFFFF
    literal, order1 = ~guessed, guessed ^ order2
    lo = second & literal | first & order1
    span = (first & order2 | second & order1 | literal & FLAGS) - lo
    below = placed >> 16 & 0xFFFF & literal
    share = (placed & 0xFFFF | guessed & (SHARES - 1)) + 1
    return (lo << 16) + span * below, span * share


class Encoder:
    """Ranges of 62 bits, of which the top 32 are given out once they are settled.

    A 33rd bit is a carry, which is settled at the end.
    """

    def __init__(self, n: int, steps: int):
        self.start = np.zeros(n, np.int64)
        self.width = np.full(n, (1 << 62) - 1, np.int64)
        self.words = np.zeros((steps + 2, n), np.int64)  # lanes use about as many
        self.flat = self.words.reshape(-1)
        self.next = np.arange(n)  # where a lane's next word goes

    def put(self, n, below, share):
        """Narrow the first n lanes' ranges to [below, below + share) of TOTAL."""
        unit = self.width[:n] >> TOTAL_BITS
        start, width = self.start[:n], self.width[:n]
        start += unit * below
        np.multiply(unit, share, out=width)
        thin = np.flatnonzero(width < LOW)
        if len(thin):
            top, at = start.take(thin), self.next.take(thin)
            self.flat[at] = top >> TOTAL_BITS
            self.next[thin] = at + len(self.next)
            start[thin] = (top & (LOW - 1)) << 32
            width[thin] = width.take(thin) << 32

    def finish(self) -> list[bytes]:
        # a range holds a number that ends in 30 zeros
        self.flat[self.next] = (self.start + LOW - 1) >> TOTAL_BITS
        used = self.next // max(len(self.next), 1) + 1
        words = self.words[:int(used.max(initial=0))]
        for at in range(len(words) - 1, 0, -1):
            words[at - 1] += words[at] >> 32
            words[at] &= 0xFFFFFFFF
        flat = np.ascontiguousarray(words.T).astype("<u4")
        return [flat[i, :k].tobytes() for i, k in enumerate(used.tolist())]


class Decoder:
    def __init__(self, payloads: list[bytes]):
        size = [len(p) // 4 for p in payloads]
        words = np.zeros((len(payloads), max(size, default=0) + 3), np.uint32)
        for i, p in enumerate(payloads):
            words[i, :size[i]] = np.frombuffer(p, "<u4", size[i])
        words = words.T.astype(np.int64, order="C")
        self.value = words[0] << 30 | words[1] >> 2
        self.width = np.full(len(payloads), (1 << 62) - 1, np.int64)
        # what follows the first 62 bits, in words of 32
        self.words = ((words[1:-1] & 3) << 30 | words[2:] >> 2).reshape(-1)
        self.next = np.arange(len(payloads))  # a lane's next word

    def peek(self, n):
        """Where in 0..TOTAL the next id lies."""
        self.unit = self.width[:n] >> TOTAL_BITS
        return np.minimum(self.value[:n].view(np.uint64) // self.unit.view(np.uint64),
                          np.uint64(TOTAL - 1)).astype(np.int32)

    def take(self, n, below, share):
        value, width = self.value[:n], self.width[:n]
        value -= self.unit * below
        np.multiply(self.unit, share, out=width)
        thin = np.flatnonzero(width < LOW)
        if len(thin):
            at = self.next.take(thin)
            value[thin] = value.take(thin) << 32 | self.words.take(at, mode="clip")
            width[thin] = width.take(thin) << 32
            self.next[thin] = at + len(self.next)


def encode_blocks(blocks: list[np.ndarray], shares: Shares) -> list[bytes]:
    """Payloads of blocks, given longest first."""
    size = np.array([len(b) for b in blocks])
    steps = int(size.max(initial=0))
    ids = np.zeros((steps, len(blocks)), np.int32)
    for i, b in enumerate(blocks):
        ids[:len(b), i] = b
    model, coder = Model(len(blocks)), Encoder(len(blocks), steps)
    for t in range(steps):
        n = len(size) if t < size[-1] else int((size > t).sum())
        now = ids[t, :n]
        seen = model.predict(n)
        hit2, hit1 = seen[4] == now, seen[5] == now
        coder.put(n, *interval(mask(hit2), mask(hit2 | hit1), seen[7], shares.placed.take(now)))
        model.learn(n, seen, hit2, hit1, now)
    return coder.finish()


def decode_blocks(payloads: list[bytes], size: np.ndarray, shares: Shares) -> list[np.ndarray]:
    steps = int(size.max(initial=0))
    ids = np.zeros((steps, len(payloads)), np.int32)
    model, coder = Model(len(payloads)), Decoder(payloads)
    for t in range(steps):
        n = len(size) if t < size[-1] else int((size > t).sum())
        seen = model.predict(n)
        two, one, bounds = seen[4], seen[5], seen[7]
        at = coder.peek(n)
        first, second = bounds >> 16, bounds & 0xFFFF
        flag = at >> 16
        order2, guessed = flag - first >> 31, flag - second >> 31  # masks, by the sign
        # exact: whole numbers below 2 ** 30 by some below 2 ** 14
        literal = shares.at.take(((at - (second << 16)) / (FLAGS - second)).astype(np.int64),
                                 mode="clip").astype(np.int32)
        now = literal & ~guessed | one & (guessed ^ order2) | two & order2
        coder.take(n, *interval(order2, guessed, bounds, shares.placed.take(literal)))
        model.learn(n, seen, two == now, one == now, now)
        ids[t, :n] = now
    by_block = np.ascontiguousarray(ids.T)
    return [by_block[i, :k] for i, k in enumerate(size.tolist())]


def encode_frame(ids: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """Magic, block count, order-0 shares; per block: ids, bytes, CRC-32 of the ids, payload."""
    blocks = [ids[i:i + block] for i in range(0, len(ids), block)]
    shares = Shares.of(ids)
    packed = shares.pack()
    out = [MAGIC, struct.pack("<II", len(blocks), len(packed)), packed]
    for b, payload in zip(blocks, encode_blocks(blocks, shares)):
        out.append(struct.pack("<III", len(b), len(payload), zlib.crc32(b.astype("<u4"))))
        out.append(payload)
    return b"".join(out)


def decode_frame(data: bytes) -> np.ndarray:
    """The ids of a frame; a block that fails its checksum is an error that names it."""
    if data[:len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id frame")
    at = len(MAGIC)
    n, length = struct.unpack_from("<II", data, at)
    at += 8
    shares = Shares.unpack(data[at:at + length])
    at += length
    size, sums, payloads = [], [], []
    for _ in range(n):
        count, length, crc = struct.unpack_from("<III", data, at)
        at += 12
        size.append(count), sums.append(crc), payloads.append(data[at:at + length])
        at += length
    if not n:
        return np.empty(0, np.int64)
    blocks = decode_blocks(payloads, np.array(size, np.int64), shares)
    for i, (b, crc) in enumerate(zip(blocks, sums)):
        if zlib.crc32(b.astype("<u4")) != crc:
            raise ValueError(f"block {i} does not match its checksum")
    return np.concatenate(blocks)
