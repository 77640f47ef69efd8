"""A range coder for token ids driven by mixed predictions of three orders.

For every id, tables remember which id followed the two ids before (order 2) and the one before
(order 1), each with a confidence. The better one is the predicted id. How likely it is right
is mixed from three adaptive estimates - of order 0 (how often predictions came true so far),
of order 1 and of order 2 (how often they did at this confidence) - with weights that move
towards the estimate that was closer. A hit or miss is coded with that probability; after a
miss the id's two bytes follow by adaptive order-0 frequencies, the low byte's by the class of
the high one. The tables change with every id; estimates, weights and frequencies are counted all
along and put into force at fixed places. All arithmetic is in integers, the coder one of 64 bits
that writes 32 at a time.

Ids are below 65536 and are cut into blocks of ``BLOCK``. Every block starts with fresh models
and has a length and a checksum of its own, so that it can be read, or found broken, without any
other. A block is cut into ``LANES`` stretches of ids in a row that share its models and are coded
in step, an id of each at a time, each by a coder of its own; where several of them change the
same slot, the last one's is kept. Blocks do not depend on each other, so the lanes of many are
coded in step, one array element each. A block's bytes are the lengths of its lanes (u16,
little-endian), then the lanes; those of a shorter last block are as long as any other's, but
fewer, and its last one may be shorter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 4096
LANES = 16
PLACES = BLOCK // LANES
#: Blocks coded in step; more of them do not fit the caches.
GROUP = 256
#: Places of the lanes where what was counted so far comes into force, up to the block's end.
RENEWALS = frozenset((4, 8, 16, 32, 64, 96, 128, 160, 192, 224))
SLOTS = (2048, 4096)
BITS = 12
TOTAL = 1 << BITS
#: Confidences of a slot.
TRUSTS = 16
_SMALL, _BITS, _HALF = np.uint64(1 << 32), np.uint64(BITS), np.uint64(32)
_FULL = np.uint64((1 << 64) - 1)
#: The table of the low byte by the high byte's bit length; table 0 is the high byte's own.
_CLASS = np.array([1 + int(h).bit_length() for h in range(256)], dtype=np.int32)
TABLES = 10
#: How a confidence moves: halved by another id than the remembered one, one up by the same.
_MOVES = np.array([(s >> 1) - s for s in range(TRUSTS)] + [1] * (TRUSTS - 1) + [0], dtype=np.int32)
_KEYS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_BYTES = np.tile(np.arange(256, dtype=np.uint8), GROUP * TABLES)


def _at(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``table[places]`` of places that are inside; faster, as they are not looked at first."""
    return table.take(places, mode="clip")


class _Models:
    """Models of the blocks of ``lanes`` lanes."""

    def __init__(self, lanes: int, decoding: bool):
        self.blocks = n = -(-lanes // LANES)
        self.lane = np.arange(lanes, dtype=np.int32) // LANES
        self.row = self.lane * TABLES
        # of each slot its id and, in the last four bits, the confidence
        self.slots = [np.zeros(n * size, dtype=np.int32) for size in SLOTS]
        self.base = [self.lane * size for size in SLOTS]
        self.at = list(self.base)
        self.before = np.zeros(lanes, dtype=np.uint32)
        # misses and hits by the confidences of order 1 and 2, and those since the last renewal
        self.seen = np.zeros((2, TRUSTS, TRUSTS, n), dtype=np.int64)
        self.outcomes: list[np.ndarray] = []
        self.chance: list[np.ndarray] = []
        self.weight = np.full((2, n), 85, dtype=np.int64)
        self.counts = np.ones((n * TABLES, 256), dtype=np.int32)
        self.missed: list[np.ndarray] = []
        self.decoding = decoding
        self.renew()

    def renew(self) -> None:
        """Puts what was counted into force."""
        if self.outcomes:
            self._weigh()
            self._count()
        margins = [self.seen.sum(axis=1).sum(axis=1), self.seen.sum(axis=2), self.seen.sum(axis=1)]
        # order 0, 1 and 2: probability of a hit in 65536ths
        self.chance = [np.clip((hits * 65536 + 32768) // (misses + hits + 2), 64, 65472) for misses, hits in margins]
        (a, b, c), (v, w) = self.chance, self.weight
        mixed = (a * (256 - v - w) + b * v)[:, None] + c * w
        self.p = np.clip(mixed >> (24 - BITS), 1, TOTAL - 1).astype(np.uint64).ravel()
        share = (TOTAL - 256 << 18) // self.counts.sum(axis=1, keepdims=True)
        width = 1 + (self.counts * share >> 18).astype(np.int32)
        ends = np.cumsum(width, axis=1, dtype=np.int32)
        width[:, 255] += TOTAL - ends[:, 255]
        ends[:, 255] = TOTAL
        # where a byte begins and, in the last 16 bits, its width
        self.spans = ((ends - width << 16) + width).ravel()
        if self.decoding:
            self.symbols = np.repeat(_BYTES[: width.size], width.ravel())

    def _weigh(self) -> None:
        """A weight grows while its estimate is closer than the mean of the three."""
        new = np.bincount(np.concatenate(self.outcomes), minlength=self.seen.size).reshape(self.seen.shape)
        self.seen += new
        self.outcomes = []
        margins = [new.sum(axis=1).sum(axis=1), new.sum(axis=2), new.sum(axis=1)]
        off = [misses * p + hits * (65535 - p) for (misses, hits), p in zip(margins, self.chance)]
        off = [off[0], off[1].sum(axis=0), off[2].sum(axis=0)]
        for k in (0, 1):
            self.weight[k] = np.clip(self.weight[k] + ((sum(off) - 3 * off[k + 1]) >> 14), 4, 124)

    def _count(self) -> None:
        missed = np.concatenate(self.missed)
        self.missed = []
        row, high, low = missed >> 16, missed >> 8 & 255, missed & 255
        counts = self.counts.ravel()
        np.add.at(counts, row * 256 + high, np.int32(24))
        np.add.at(counts, (row + _CLASS[high]) * 256 + low, np.int32(24))

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The predicted id and the probability of a hit, from 1 to ``TOTAL - 1``."""
        self.held = [_at(slots, at[:n]) for slots, at in zip(self.slots, self.at)]
        self.sure = [held & TRUSTS - 1 for held in self.held]
        first, second = self.sure
        self.cell = (first * TRUSTS + second) * self.blocks + self.lane[:n]
        return np.where(second > 0, self.held[1], self.held[0]) >> 4, _at(self.p, self.cell)

    def learn(self, n: int, hit: np.ndarray, missed: np.ndarray, ids: np.ndarray) -> None:
        """Takes in the ids of a place; ``missed`` are the lanes without a hit."""
        self.outcomes.append(self.cell + hit * np.int32(self.seen.size // 2))
        self.missed.append(_at(self.row, missed) << 16 | _at(ids, missed))
        own = ids << 4
        for slots, at, held, sure in zip(self.slots, self.at, self.held, self.sure):
            same = (held ^ own) < TRUSTS
            slots[at[:n]] = np.where(sure == 0, own, held) + _at(_MOVES, same * np.int32(TRUSTS) + sure)
        one = ids.view(np.uint32)
        keys = (one * _KEYS[0], one * _KEYS[1] + self.before[:n])
        self.at = [base[:n] + (key >> 32 - size.bit_length() + 1).view(np.int32) for base, key, size in zip(self.base, keys, SLOTS)]
        self.before = one * _KEYS[2]

    def spans_of(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the bytes of these cells begin and how wide they are."""
        span = _at(self.spans, cell)
        return (span >> 16).astype(np.uint64), (span & 0xFFFF).astype(np.uint64)


class _Writer:
    """Coders of ``lanes`` lanes. ``low`` holds the last 64 bits, words before them are written."""

    def __init__(self, lanes: int):
        self.low, self.span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, _FULL)
        # an id narrows a span by 36 bits at most and writes two words at most
        self.width = 2 * PLACES + 2
        self.words, self.carry = (np.zeros(lanes * self.width, dtype=t) for t in (np.uint32, np.uint8))
        self.first = np.arange(lanes, dtype=np.int64) * self.width
        self.at = self.first.copy()

    def _raise(self, lane: np.ndarray, low: np.ndarray, by: np.ndarray) -> np.ndarray:
        raised = low + by
        over = lane[raised < low]
        self.carry[self.at[over] - 1] += 1
        return raised

    def _shift(self, lane: np.ndarray | None, low: np.ndarray, span: np.ndarray) -> None:
        """Writes a word of each coder whose span is small; ``lane`` are the coders, or all."""
        small = np.flatnonzero(span < _SMALL)
        if len(small):
            to, out = small if lane is None else lane[small], low[small]
            at = self.at[to]
            self.words[at] = out >> _HALF
            self.at[to] = at + 1
            low[small] = out << _HALF
            span[small] <<= _HALF

    def write(self, p: np.ndarray, missed: np.ndarray, ids: np.ndarray, models: _Models) -> None:
        """Codes an id of each of the first lanes; ``ids`` are those of the lanes ``missed``."""
        spans = self.span[: len(p)]
        bound = (spans >> _BITS) * p
        low, skipped = _at(self.low, missed), _at(bound, missed)
        span = _at(spans, missed) - skipped
        high, row = ids >> 8, _at(models.row, missed)
        begin, width = models.spans_of(row * 256 + high)
        span >>= _BITS
        low = self._raise(missed, low, skipped + span * begin)
        span *= width
        self._shift(missed, low, span)
        begin, width = models.spans_of((row + _at(_CLASS, high)) * 256 + (ids & 255))
        span >>= _BITS
        low = self._raise(missed, low, span * begin)
        span *= width
        spans[:] = bound
        self.low[missed], spans[missed] = low, span
        self._shift(None, self.low[: len(p)], spans)

    def parts(self) -> list[bytes]:
        """The bytes of each block."""
        lanes = len(self.low)
        # the value inside the span that has the fewest bytes
        free = np.full(lanes, 32, dtype=np.uint64)
        for k in (40, 48, 56):
            free[self.span >> np.uint64(k) > 0] = k
        rest = (np.uint64(1) << free) - np.uint64(1)
        low = self._raise(np.arange(lanes), self.low, rest) & ~rest
        self.words[self.at] = low >> _HALF
        length = 4 * (self.at - self.first) + 8 - free.astype(np.int64) // 8
        last = int((self.at - self.first).max())
        words, carry = self.words.reshape(lanes, -1)[:, : last + 1].astype(np.uint64), self.carry.reshape(lanes, -1)
        over = np.zeros(lanes, dtype=np.uint64)
        for k in range(last, -1, -1):
            raised = words[:, k] + carry[:, k] + over
            words[:, k], over = raised, raised >> _HALF
        data = words.astype(np.uint32).astype(">u4").view(np.uint8).reshape(lanes, -1)
        data = data[np.arange(data.shape[1]) < length[:, None]]
        ends = np.concatenate([[0], np.cumsum(length)])
        bounds = [(k, min(k + LANES, lanes)) for k in range(0, lanes, LANES)]
        return [length[a:b].astype("<u2").tobytes() + data[ends[a] : ends[b]].tobytes() for a, b in bounds]


class _Reader:
    """Coders of ``lanes`` lanes. ``code`` is what was read less the low end of the span."""

    def __init__(self, blocks: list[bytes], lanes: int):
        lengths = []
        for k, block in enumerate(blocks):
            n = min(lanes - k * LANES, LANES)
            if len(block) < 2 * n or 2 * n + int(np.frombuffer(block, dtype="<u2", count=n).sum(dtype=np.int64)) != len(block):
                raise ValueError("a block is broken: its lanes do not have its length")
            lengths.append(np.frombuffer(block, dtype="<u2", count=n))
        length = np.concatenate(lengths).astype(np.int64)
        width = (int(length.max()) + 3) // 4 + 3
        data = np.zeros((lanes, 4 * width), dtype=np.uint8)
        data[np.arange(4 * width) < length[:, None]] = np.frombuffer(b"".join(b[2 * len(n) :] for b, n in zip(blocks, lengths)), dtype=np.uint8)
        self.words = data.view(">u4").astype(np.uint64).ravel()
        self.at = np.arange(lanes, dtype=np.int64) * width
        self.last = self.at + width - 1
        self.code = self.words[self.at] << _HALF | self.words[self.at + 1]
        self.at += 2
        self.span = np.full(lanes, _FULL)

    def _shift(self, lane: np.ndarray | None, code: np.ndarray, span: np.ndarray) -> None:
        """Reads a word of each coder whose span is small; ``lane`` are the coders, or all."""
        small = np.flatnonzero(span < _SMALL)
        if len(small):
            to = small if lane is None else lane[small]
            at = self.at[to]
            code[small] = code[small] << _HALF | self.words[at]
            self.at[to] = np.minimum(at + 1, self.last[to])
            span[small] <<= _HALF

    @staticmethod
    def _byte(code: np.ndarray, span: np.ndarray, row: np.ndarray, models: _Models) -> np.ndarray:
        """The byte by the frequencies of ``row``, to whose part ``code`` and ``span`` are narrowed."""
        span >>= _BITS
        value = np.minimum(code // span, np.uint64(TOTAL - 1)).astype(np.int32)
        byte = _at(models.symbols, row * TOTAL + value).astype(np.int32)
        begin, width = models.spans_of(row * 256 + byte)
        code -= span * begin
        span *= width
        return byte

    def read(self, p: np.ndarray, models: _Models) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the first lanes: whether they hit, which missed, and the ids of those."""
        codes, spans = self.code[: len(p)], self.span[: len(p)]
        bound = (spans >> _BITS) * p
        hit = codes < bound
        missed = np.flatnonzero(~hit)
        skipped, row = _at(bound, missed), _at(models.row, missed)
        code, span = _at(codes, missed) - skipped, _at(spans, missed) - skipped
        high = self._byte(code, span, row, models)
        self._shift(missed, code, span)
        low = self._byte(code, span, row + _at(_CLASS, high), models)
        spans[:] = bound
        codes[missed], spans[missed] = code, span
        self._shift(None, codes, spans)
        return hit, missed, high << 8 | low


def _groups(total: int) -> Iterator[tuple[int, int]]:
    """Bounds of the ids whose blocks are coded in step."""
    count = -(-total // BLOCK)
    if count:
        step = -(-count // -(-count // GROUP)) * BLOCK
        for k in range(0, total, step):
            yield k, min(k + step, total)


def _lanes(total: int) -> tuple[int, int]:
    lanes = -(-total // PLACES)
    return lanes, total - (lanes - 1) * PLACES


def checked(ids: np.ndarray) -> np.ndarray:
    """The ids in 16 bits; an error where one does not fit."""
    if len(ids) and (int(ids.max()) > 65535 or int(ids.min()) < 0):
        raise ValueError("ids have to be below 65536")
    return ids.astype(np.uint16)


def _encode(ids: np.ndarray) -> list[bytes]:
    lanes, tail = _lanes(len(ids))
    padded = np.zeros((lanes, PLACES), dtype=np.uint16)
    padded.ravel()[: len(ids)] = ids
    steps = np.ascontiguousarray(padded.T)
    models, coder = _Models(lanes, decoding=False), _Writer(lanes)
    for t in range(PLACES):
        n = lanes if t < tail else lanes - 1
        if n == 0:
            break
        if t in RENEWALS:
            models.renew()
        own = steps[t, :n].astype(np.int32)
        guess, p = models.predict(n)
        hit = guess == own
        missed = np.flatnonzero(~hit)
        coder.write(p, missed, _at(own, missed), models)
        models.learn(n, hit, missed, own)
    return coder.parts()


def _decode(blocks: list[bytes], total: int) -> np.ndarray:
    lanes, tail = _lanes(total)
    models, coder = _Models(lanes, decoding=True), _Reader(blocks, lanes)
    out = np.zeros((PLACES, lanes), dtype=np.uint16)
    for t in range(PLACES):
        n = lanes if t < tail else lanes - 1
        if n == 0:
            break
        if t in RENEWALS:
            models.renew()
        own, p = models.predict(n)
        hit, missed, ids = coder.read(p, models)
        own[missed] = ids
        out[t, :n] = own
        models.learn(n, hit, missed, own)
    return out.T.ravel()[:total]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The ids in blocks of ``BLOCK`` (the last may be shorter), each coded by itself."""
    ids = checked(np.asarray(ids))
    return [block for a, b in _groups(len(ids)) for block in _encode(ids[a:b])]


def decode_blocks(blocks: list[bytes], total: int) -> np.ndarray:
    """The ``total`` ids of the blocks of one call of ``encode_blocks``."""
    parts = [_decode(blocks[a // BLOCK : -(-b // BLOCK)], b - a) for a, b in _groups(total)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def checksum(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
