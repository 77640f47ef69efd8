"""Periodic runs of words, caught online as squares by dyadic catchers.

A run is a stretch of words that repeat with its smallest period, at least twice and ``least``
words long, and that no neighbouring word continues. Words are appended in pieces. Every
completed block of a power of two words, at a multiple of its size, has a catcher: it compares
the block with the newest words, as a suffix of the same size, while their distance lies in the
range of periods the size stands for. For a period ``p`` a run has ``max(least, 2 p) - p`` words
that equal the word ``p`` ahead, and the size is the largest of which so many words in a row hold
a whole aligned block, so that no run escapes its catchers. An appended word therefore ends one
suffix per size and is compared by two or three catchers of it, whatever the length of the text.
Suffixes are compared by names: the name of a suffix is a 64-bit mix of the names of its halves.

What catchers of one period and neighbouring blocks report is one repetition; squares that touch
merge into it as they come. Its ends, less than a block away, are found by halving steps over the
names. Repetitions of the same words under several periods are one run, of the smallest.

``find`` gives every row its runs; a repeated row has them again, ties are impossible (two runs
differ in begin, end or both). Null and empty texts have none, a table without rows gives none,
columns beside ``doc_id`` and ``text`` are not looked at, whatever their names. Texts come in
slices of a few MB, a longer one by itself, and enter the catchers in pieces of ``PIECE`` words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .tables import arrow_map

LEAST = 12
PIECE = 1 << 18
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_LEFT, _RIGHT, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def period_ranges(size: int, least: int) -> list[tuple[int, int]]:
    """The periods that catchers of this block size stand for, as one or two ranges."""
    low, high = max(1, least - 4 * size + 2), 4 * size - 2
    short, long = (low, min(high, least - 2 * size + 1)), (max(low, 2 * size - 1), high)
    ranges = [(low, high)] if short[1] >= long[0] - 1 else [short, long]
    return [(a, b) for a, b in ranges if a <= b]


class Names:
    """Names of all suffixes of one size, growing at the end."""

    def __init__(self):
        self.values, self.n = np.zeros(1024, dtype=np.uint64), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            grown = np.zeros(max(2 * len(self.values), self.n + len(more)), dtype=np.uint64)
            grown[: self.n] = self.values[: self.n]
            self.values = grown
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)


class Catchers:
    """Catchers over texts that lie one after the other, each closed by a word of its own."""

    def __init__(self, least: int = LEAST):
        self.least, self.n, self.texts = least, 0, 0
        self.names = [Names()]
        self.place = np.zeros(0, dtype=np.int64)  # of each word in its text
        #: chains of caught blocks: period, first and last block, per size
        self.caught: dict[int, np.ndarray] = {}

    def append(self, hashes: np.ndarray, place: np.ndarray) -> None:
        """More words, and their places in their texts; a closing word has the place -1."""
        before, self.n = self.n, self.n + len(hashes)
        closing = np.flatnonzero(place < 0)
        named = words.mix(hashes ^ _LEFT)
        named[closing] = words.mix((self.texts + np.arange(len(closing), dtype=np.uint64)) * _RIGHT + _END)
        self.texts += len(closing)
        self.names[0].extend(named)
        self.place = np.concatenate([self.place, place]) if before else place
        longest, size, level = int(place.max(initial=0)) + 1, 1, 0
        while True:
            ranges = period_ranges(size, self.least)
            for low, high in ranges:
                self._advance(level, low, high, max(before - size + 1, 0))
            size, level = 2 * size, level + 1
            # sizes beyond the longest text so far stay without names
            if period_ranges(size, self.least) and min(a for a, _ in period_ranges(size, self.least)) + size > longest and size > self.least:
                break
            self._name(level)

    def _name(self, level: int) -> None:
        """Names of one more size, up to the newest word."""
        if level == len(self.names):
            self.names.append(Names())
        own, half = self.names[level], self.names[level - 1]
        size = 1 << level
        begin, end = own.n, self.n - size + 1
        if end > begin:
            left, right = half.values[begin:end], half.values[begin + size // 2 : end + size // 2]
            own.extend(words.mix(left * _LEFT + (right ^ (right >> np.uint64(29))) * _RIGHT + np.uint64(level)))

    def _advance(self, level: int, low: int, high: int, begin: int) -> None:
        """Compare the new suffixes with the catchers whose periods are in [low, high]."""
        size, names = 1 << level, self.names[level]
        fresh = np.arange(begin, self.n - size + 1)
        place = self.place[begin : begin + len(fresh)]
        fresh = fresh[place >= low]
        if not len(fresh):
            return
        earliest = fresh - self.place[fresh]
        own = names.values[fresh]
        for back in range(-(-(high - low + 1) // size)):
            block = ((fresh - low) // size - back) * size
            same = (block >= earliest) & (fresh - block <= high)
            same &= names.values[np.maximum(block, 0)] == own
            hit = np.flatnonzero(same)
            if len(hit):
                self._merge(size, fresh[hit] - block[hit], block[hit])

    def _merge(self, size: int, period: np.ndarray, block: np.ndarray) -> None:
        """Squares over neighbouring blocks with one period are one repetition."""
        chains = np.stack([period, block, block])
        if size in self.caught:
            chains = np.concatenate([self.caught[size], chains], axis=1)
        chains = chains[:, np.lexsort((chains[1], chains[0]))]
        new = np.ones(chains.shape[1], dtype=bool)
        new[1:] = (chains[0, 1:] != chains[0, :-1]) | (chains[1, 1:] > chains[2, :-1] + size)
        last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
        self.caught[size] = np.stack([chains[0, new], chains[1, new], chains[2, last]])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and period of all runs, sorted by begin, then period."""
        parts = [self._repetitions(size, *chains) for size, chains in self.caught.items()]
        if not parts:
            none = np.empty(0, dtype=np.int64)
            return none, none, none
        begin, end, period = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((period, end, begin))
        begin, end, period = begin[order], end[order], period[order]
        first = np.ones(len(begin), dtype=bool)
        first[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
        begin, end, period = begin[first], end[first], period[first]
        order = np.lexsort((period, begin))
        return begin[order], end[order], period[order]

    def _repetitions(self, size: int, period: np.ndarray, first: np.ndarray, last: np.ndarray):
        begin, end = first.copy(), last + size
        step = size
        while step > 1:
            step //= 2
            values = self.names[step.bit_length() - 1].values
            count = self.n - step + 1
            at = begin - step
            same = (at >= 0) & (values[np.maximum(at, 0)] == values[np.maximum(at, 0) + period])
            begin = np.where(same, at, begin)
            ahead = np.minimum(end + period, count - 1)
            same = (end + period < count) & (values[np.minimum(end, count - 1)] == values[ahead])
            end = np.where(same, end + step, end)
        end = end + period
        long = end - begin >= np.maximum(self.least, 2 * period)
        return begin[long], end[long], period[long]


def runs_of(found: words.Words, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of several texts: where each text's begin, and begin (word of the text), length and period."""
    counts = np.diff(found.first)
    # a closing word after each text
    hashes = np.insert(found.hashes, found.first[1:], 0)
    ends = found.first[1:] + np.arange(1, len(counts) + 1)
    starts = ends - counts - 1
    place = np.arange(len(hashes)) - np.repeat(starts, counts + 1)
    place[ends - 1] = -1
    catchers = Catchers(least)
    for at in range(0, len(hashes), PIECE):
        catchers.append(hashes[at : at + PIECE], place[at : at + PIECE])
    begin, end, period = catchers.runs()
    owner = np.searchsorted(starts, begin, side="right") - 1
    return np.searchsorted(owner, np.arange(len(counts) + 1)), begin - starts[owner], end - begin, period


def _run_lists(first: np.ndarray, *columns: np.ndarray) -> pa.Array:
    arrays = [pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns]
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(arrays, names=["start", "length", "period"]))


def collapse(text: bytes, begin: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words, joined by one space, that no run holds after its first period."""
    own = text.split()
    if len(begin):
        change = np.zeros(len(own) + 1, dtype=np.int64)
        np.add.at(change, begin + period, 1)
        np.add.at(change, begin + length, -1)
        own = compress(own, (np.cumsum(change[:-1]) == 0).tolist())
    return b" ".join(own)


def find(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id``, ``n_words``, the ``runs`` by start, then period, and the ``collapsed`` text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column("text")
        for i, j in words.slices(texts):
            found = words.words_of(texts.slice(i, j - i), lower=False)
            first, *runs = runs_of(found, least)
            raw, bounds = found.data.tobytes(), found.text_start.tolist()
            kept = [
                collapse(raw[a:b], *(column[x:y] for column in runs))
                for a, b, x, y in zip(bounds, bounds[1:], first.tolist(), first[1:].tolist())
            ]
            kept = pa.array(kept, pa.binary()).cast(pa.string())
            columns = [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(found.first)), _run_lists(first, *runs), kept]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return arrow_map(rows, FOUND, per_batch)


def with_planted_runs(documents: DataFrame, every: int = 10) -> DataFrame:
    """``doc_id`` and ``text``; of one in ``every`` ids, drawn by the checksum of its digits (of none
    if null), the words from a drawn one on repeat with a drawn period, joined by one space."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def planted(doc_id: int | None, text: str | None) -> str | None:
        drawn = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        own = (text or "").encode().split()
        if drawn % every or not own:
            return text
        drawn //= every
        n, begin = len(own), drawn % len(own)
        period = 1 + (n - begin) // (3 + drawn % 8)
        return b" ".join(own[:begin] + [own[begin + k % period] for k in range(n - begin)]).decode()

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for i, j in words.slices(texts):
            made = [planted(*row) for row in zip(ids.slice(i, j - i).to_pylist(), texts.slice(i, j - i).to_pylist())]
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(made, pa.string())], names=["doc_id", "text"])

    return arrow_map(rows, "doc_id long, text string", per_batch)
