"""Token ids in a binary form: an adaptive context-mixing range coder over independent blocks.

Model. Three predictors look at the ids so far: order 2 (the id that last followed this pair),
order 1 (the id that last followed this id), order 0 (how often each id came). Their mix gives
every id a share of 2**20: order 0 has at least an eighth, orders 1 and 2 get what they have
earned, counted for each pair of confidences (how often in a row a prediction held). A range coder
codes each id by its share. All counts change while a block is coded, the same way on both sides.

Layout. A block begins with an empty model and holds everything needed to decode it. Its ids run
in up to `LANES` lanes side by side, each with a range coder of its own, all with one model; the
model learns at fixed steps (after 1, 2, 4 ... 32, then every 32 ids of a lane). So numpy codes
all lanes at once. Header: magic, version, alphabet, ids, lanes, CRC-32 of the ids (little-endian
32-bit), CRC-32 of the rest; then the words of each lane. Both sums are verified when decoding.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"EMID", 2
LANES = 8192
_TOTAL, _BASE = 20, 17  # bits of all shares, and of order 0's
_EIGHTH = 1 << _BASE
_STATE, _LOW = 60, 28  # bits of a coder's range at most; below 2**_LOW it sends a word of 32 bits
_HASH = 16
_HEAD = struct.Struct("<4sHHIIII")
#: Dividing by 1 to 8 as a product, exact for numbers of 20 bits.
_INVERSE = np.array([0] + [-(-(1 << 32) // k) for k in range(1, 9)], dtype=np.int64)


class _Model:
    def __init__(self, alphabet: int):
        if alphabet > 60_000:
            raise ValueError("an alphabet of 60,000 ids at most")
        self.alphabet = alphabet
        self.counts = np.zeros(alphabet, dtype=np.int64)
        #: For each id, and for each pair's slot: the last follower times 4, plus how often in a row it held (3 at most).
        self.one = np.full(alphabet + 1, 4 * alphabet, dtype=np.int32)
        self.two = np.full(1 << _HASH, 4 * alphabet, dtype=np.int32)
        #: For each pair of confidences: ids seen, ids that order 2, and else order 1, had foretold.
        self.seen = np.zeros((16, 3), dtype=np.int64)
        self._settle()

    def _settle(self) -> None:
        """Whole-numbered shares from the counts."""
        spare = _EIGHTH - self.alphabet
        total = int(self.counts.sum())
        freq = np.ones(self.alphabet, dtype=np.int64)
        if total:
            freq += self.counts * (spare * 7 // 8) // total
        left = _EIGHTH - int(freq.sum())
        freq += left // self.alphabet
        freq[: left % self.alphabet] += 1
        self.cum = np.zeros(self.alphabet + 2, dtype=np.int32)
        np.cumsum(freq, out=self.cum[1:-1])
        self.cum[-1] = self.cum[-2]
        self.find = None
        n, two, one = self.seen[:, 0] + 8, self.seen[:, 1], self.seen[:, 2]
        eighths = np.clip(8 * (two + one) // n, 0, 7)
        both = two + one + 1
        self.two_share = (eighths * _EIGHTH * two // both).astype(np.int32)
        self.one_share = (eighths * _EIGHTH - self.two_share).astype(np.int32)
        self.zero_share = (8 - eighths).astype(np.int32)

    def slots(self) -> np.ndarray:
        if self.find is None:
            self.find = np.repeat(np.arange(self.alphabet, dtype=np.int32), np.diff(self.cum[:-1]))
        return self.find

    @staticmethod
    def pair(before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The slot of a pair; 32-bit numbers may wrap, only their low bits count."""
        return (before * np.int32(40_503) + last * np.int32(30_011) + (last >> 7)) & np.int32((1 << _HASH) - 1)

    def mix(self, before: np.ndarray, last: np.ndarray):
        """(what order 2 and order 1 foretell, their shares, how often order 0 counts). Equal forecasts: order 2 has both shares."""
        two, one = self.two[self.pair(before, last)], self.one[last]
        kind = (two & 3) << 2 | one & 3
        two, one = two >> 2, one >> 2
        both, times = self.two_share[kind] + self.one_share[kind], self.zero_share[kind]
        one_share = np.where(two == one, np.int32(0), self.one_share[kind])
        return two, one, both - one_share, one_share, times

    def learn(self, before: np.ndarray, last: np.ndarray, ids: np.ndarray) -> None:
        """All arguments in one fixed order: step by step, lane by lane."""
        at = self.pair(before, last)
        two, one = self.two[at], self.one[last]
        kind = (two & 3) << 2 | one & 3
        by_two, by_one = two >> 2 == ids, one >> 2 == ids
        self.seen[:, 0] += np.bincount(kind, minlength=16)
        self.seen[:, 1] += np.bincount(kind[by_two], minlength=16)
        self.seen[:, 2] += np.bincount(kind[~by_two & by_one], minlength=16)
        # Where a slot comes more than once, numpy keeps the last: the newest follower.
        self.two[at] = 4 * ids + np.where(by_two, np.minimum((two & 3) + 1, 3), 1)
        self.one[last] = 4 * ids + np.where(by_one, np.minimum((one & 3) + 1, 3), 1)
        self.counts += np.bincount(ids, minlength=self.alphabet)
        self._settle()


def _rounds(steps: int):
    """The steps between which the model learns."""
    begin, width = 0, 1
    while begin < steps:
        end = min(steps, begin + width)
        yield begin, end
        begin, width = end, min(32, max(1, end))


def _grid(n: int, lanes: int) -> tuple[int, int]:
    lanes = max(1, min(lanes, n // 64))
    return lanes, -(-n // lanes) if n else 0


def encode_block(ids: np.ndarray, alphabet: int, lanes: int = LANES) -> bytes:
    """A block of any number of ids, each below alphabet."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    n = len(ids)
    lanes, steps = _grid(n, lanes)
    if n and int(ids.max()) >= alphabet:
        raise ValueError("an id is outside the alphabet")
    padded = np.zeros(lanes * steps, dtype=np.int32)
    padded[:n] = ids
    grid = padded.reshape(lanes, steps).T.copy() if n else np.zeros((0, lanes), dtype=np.int32)
    pad = np.full((2, lanes), alphabet, dtype=np.int32)
    past = np.concatenate([pad, grid])
    model = _Model(alphabet)
    low = np.zeros(lanes, dtype=np.uint64)
    span = np.full(lanes, 1 << _STATE, dtype=np.uint64)
    words = np.zeros((lanes, steps + 4), dtype=np.int64)
    sent = np.zeros(lanes, dtype=np.int64)
    mask = np.uint64((1 << _STATE) - 1)
    shift, least, drop = np.uint64(_TOTAL), np.uint64(1 << _LOW), np.uint64(_STATE - 32)
    rest = np.uint64((1 << (_STATE - 32)) - 1)
    for begin, end in _rounds(steps):
        now, last, before = past[begin + 2 : end + 2], past[begin + 1 : end + 1], past[begin:end]
        two, one, w2, w1, times = model.mix(before, last)
        below = model.cum[now]
        freq = (model.cum[now + 1] - below) * times + w2 * (now == two) + w1 * (now == one)
        start = below * times + w2 * (two < now) + w1 * (one < now)
        freq, start = freq.astype(np.uint64), start.astype(np.uint64)
        for k in range(end - begin):
            unit = span >> shift
            low = low + unit * start[k]
            span = unit * freq[k]
            over = np.flatnonzero(low > mask)
            if len(over):
                words[over, sent[over] - 1] += 1  # a carry into the word before
                low[over] &= mask
            small = np.flatnonzero(span < least)
            if len(small):
                words[small, sent[small]] = low[small] >> drop
                sent[small] += 1
                low[small] = (low[small] & rest) << np.uint64(32)
                span[small] <<= np.uint64(32)
        if end < steps:
            model.learn(before.ravel(), last.ravel(), now.ravel())
    # Two more words fix every lane's last range.
    for k in range(2):
        words[np.arange(lanes), sent] = low >> drop
        sent += 1
        low = (low & rest) << np.uint64(32)
    for k in range(words.shape[1] - 1, 0, -1):  # carries run to the left
        words[:, k - 1] += words[:, k] >> 32
        words[:, k] &= 0xFFFFFFFF
    taken = np.arange(words.shape[1])[None, :] < sent[:, None]
    body = sent.astype("<u4").tobytes() + words[taken].astype("<u4").tobytes()
    if not n:
        body = b""
    head = (MAGIC, VERSION, alphabet, n, lanes if n else 0, zlib.crc32(ids.tobytes()))
    return _HEAD.pack(*head, zlib.crc32(body, zlib.crc32(_HEAD.pack(*head, 0)))) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError where a sum doesn't hold."""
    magic, version, alphabet, n, lanes, crc, body_crc = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of this format")
    if zlib.crc32(body, zlib.crc32(_HEAD.pack(magic, version, alphabet, n, lanes, crc, 0))) != body_crc:
        raise ValueError("the block is damaged")
    if not n:
        return np.zeros(0, dtype="<u4")
    steps = -(-n // lanes)
    sent = np.frombuffer(body, dtype="<u4", count=lanes).astype(np.int64)
    data = np.concatenate([np.frombuffer(body, dtype="<u4", offset=4 * lanes), np.zeros(4, dtype="<u4")]).astype(np.uint64)
    at = np.cumsum(sent) - sent
    model = _Model(alphabet)
    drop = np.uint64(_STATE - 32)
    # 60 bits of the code: a word and 28 bits of the next one.
    shift, least, mask = np.uint64(_TOTAL), np.uint64(1 << _LOW), np.uint64((1 << _STATE) - 1)
    part = np.uint64(32 - (_STATE - 32))

    def window(where: np.ndarray) -> np.ndarray:
        return (data[where] << drop) | (data[where + 1] >> part)

    code = window(at)  # relative to low, so that no carry matters here
    span = np.full(lanes, 1 << _STATE, dtype=np.uint64)
    past = np.full((steps + 2, lanes), alphabet, dtype=np.int32)
    top = np.uint64((1 << _TOTAL) - 1)
    for begin, end in _rounds(steps):
        slots, cum = model.slots(), model.cum
        for k in range(begin, end):
            before, last = past[k], past[k + 1]
            two, one, w2, w1, times = model.mix(before, last)
            unit = span >> shift
            value = np.minimum(code // unit, top).astype(np.int32)
            # Take what orders 2 and 1 hold before this value out of it, the lower id first.
            a, b = np.minimum(one, two), np.maximum(one, two)
            wa = np.where(one < two, w1, w2)
            wb = w1 + w2 - wa
            past_a = value >= cum[a + 1] * times + wa
            past_b = value >= cum[b + 1] * times + wa + wb
            in_a = ~past_a & (value >= cum[a] * times) & (a < alphabet)
            in_b = past_a & ~past_b & (value >= cum[b] * times + wa) & (b < alphabet)
            base = (value - wa * past_a - wb * past_b) * _INVERSE[times] >> 32
            got = slots[np.minimum(base, _EIGHTH - 1)]
            got = np.where(in_a, a, np.where(in_b, b, got))
            past[k + 2] = got
            below = cum[got]
            freq = (cum[got + 1] - below) * times + w2 * (got == two) + w1 * (got == one)
            start = below * times + w2 * (two < got) + w1 * (one < got)
            code = code - unit * start.astype(np.uint64)
            span = unit * freq.astype(np.uint64)
            small = np.flatnonzero(span < least)
            if len(small):
                at[small] += 1
                where = at[small]
                fresh = ((data[where] & np.uint64((1 << int(part)) - 1)) << drop) | (data[where + 1] >> part)
                code[small] = ((code[small] << np.uint64(32)) | fresh) & mask
                span[small] <<= np.uint64(32)
        if end < steps:
            model.learn(past[begin:end].ravel(), past[begin + 1 : end + 1].ravel(), past[begin + 2 : end + 2].ravel())
    ids = past[2:].T.ravel()[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("the decoded ids differ from those that were coded")
    return ids
