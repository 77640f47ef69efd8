"""Words, shingles and signatures of whole texts as numpy arrays, for use inside Spark tasks.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Texts are
handled in slices of a few MB, so that the memory of a task does not grow with its partition;
only a single text longer than a slice makes its slice larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: Everything in ASCII but letters and digits: words without their punctuation.
NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """``base`` to 0, 1, ... modulo 2**64; kept by the worker up to the length of a slice."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hashes`` takes the hash of any span of ``data``."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.multiply(data, _power(_BASE, n), out=sums[1:])
    sums[1:] += _power(_BASE, n)
    return np.cumsum(sums, out=sums)


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [start, end), equal for equal bytes wherever they lie."""
    return mix((sums[end] - sums[start]) * _power(_BASE_INVERSE, len(sums))[start])


@dataclass
class Words:
    """Words of a slice of texts: ``hashes[first[i]:first[i + 1]]`` are those of text ``i``."""

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    text_start: np.ndarray


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [from, to) of texts of about ``limit`` bytes together, one text at least."""
    begin, held = 0, 0
    for i, size in enumerate(np.diff(_offsets(texts)).tolist()):
        if i > begin and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)


def _offset_type(texts: pa.Array):
    return np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = _offset_type(texts)
    width = np.dtype(kind).itemsize
    return np.frombuffer(texts.buffers()[1], dtype=kind, count=len(texts) + 1, offset=texts.offset * width)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row and where each text begins (a null is empty)."""
    texts = texts.fill_null("") if texts.null_count else texts
    offsets = _offsets(texts).astype(np.int64)
    if len(texts) == 0 or offsets[-1] == offsets[0]:
        return np.empty(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(
    data: np.ndarray, text_start: np.ndarray, lower: bool = True, breaks: np.ndarray = _SPACE
) -> Words:
    """Words of texts that lie one after the other in ``data``; ``breaks`` marks bytes between words."""
    n = len(data)
    if n == 0:
        none = np.empty(0, dtype=np.int64)
        return Words(np.empty(0, dtype=np.uint64), np.zeros(len(text_start), dtype=np.int64), none, none, data, text_start)
    word = ~breaks[data]
    change = np.empty(n + 1, dtype=bool)
    change[0], change[n] = word[0], False
    np.logical_and(word[1:], ~word[:-1], out=change[1:n])
    inner = text_start[(text_start > 0) & (text_start < n)]
    change[inner] = word[inner]
    start = np.flatnonzero(change)
    stop = np.zeros(n + 1, dtype=bool)
    stop[n] = word[n - 1]
    np.logical_and(~word[1:], word[:-1], out=stop[1:n])
    stop[inner] = word[inner - 1]
    end = np.flatnonzero(stop)
    hashes = span_hashes(prefix_sums(_LOWER[data] if lower else data), start, end)
    return Words(hashes, np.searchsorted(start, text_start).astype(np.int64), start, end, data, text_start)


def words_of(texts: pa.Array, lower: bool = True, breaks: np.ndarray = _SPACE) -> Words:
    return split_words(*text_bytes(texts), lower, breaks)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each text, and where each text's runs begin.

    A text of fewer words has one run, all its words; a text without words has none.
    """
    counts = np.diff(words.first)
    h = words.hashes
    first = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(np.where(counts >= size, counts - size + 1, np.minimum(counts, 1)), out=first[1:])
    if len(h) == 0:
        return np.empty(0, dtype=np.uint64), first
    m = max(len(h) - size + 1, 0)
    run = np.zeros(m, dtype=np.uint64)
    for j in range(size):
        run *= np.uint64(_BASE)
        run += h[j : j + m]
    run = mix(run + np.uint64(size))
    inside = np.ones(m, dtype=bool)
    # runs that would reach into the next text
    for j in range(1, size):
        over = words.first[1:-1] - j
        inside[over[(over >= 0) & (over < m)]] = False
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short) == 0:
        return run[inside], first
    out = np.empty(first[-1], dtype=np.uint64)
    whole = np.ones(first[-1], dtype=bool)
    for i in short:
        value = 0
        for x in h[words.first[i] : words.first[i + 1]].tolist():
            value = (value * _BASE + x) % (1 << 64)
        value = (value + int(counts[i])) % (1 << 64)
        out[first[i]] = mix(np.array([value], dtype=np.uint64))[0]
        whole[first[i]] = False
    # a run counts for the text that holds all its words
    owner = np.searchsorted(words.first, np.arange(m), side="right") - 1
    inside &= counts[owner] >= size
    out[whole] = run[inside]
    return out, first


def minhash(runs: np.ndarray, first: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` MinHash coordinates per text (rows); texts without runs get the largest value."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.full((len(first) - 1, count), np.iinfo(np.uint64).max, dtype=np.uint64)
    if len(full) == 0:
        return out
    factors = mix(np.arange(seed * 1000 + 1, seed * 1000 + 2 * count + 1, dtype=np.uint64) * np.uint64(_BASE))
    work = np.empty_like(runs)
    for j in range(count):
        np.multiply(runs, factors[2 * j] | np.uint64(1), out=work)
        work ^= factors[2 * j + 1]
        out[full, j] = np.minimum.reduceat(work, first[:-1][full])
    return out


def distinct_runs(runs: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct runs, sorted."""
    return [np.unique(runs[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def set_hash(distinct: np.ndarray) -> bytes:
    """128 bits that are equal for equal sets."""
    a = int(mix(distinct).sum(dtype=np.uint64))
    b = int(mix(distinct ^ np.uint64(_BASE)).sum(dtype=np.uint64))
    return (a << 64 | b).to_bytes(16, "big")


def segments(found: Words) -> np.ndarray:
    """First words of the segments of all texts: a segment ends with its line, or with a full
    stop, question or exclamation mark that white space follows."""
    data, n = found.data, len(found.start)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    stop = data == 10
    stop[:-1] |= ((data[:-1] == 46) | (data[:-1] == 33) | (data[:-1] == 63)) & _SPACE[data[1:]]
    stops = np.cumsum(stop)
    new = np.ones(n, dtype=bool)
    # a stop between the first bytes of two words
    new[1:] = stops[found.start[1:]] > stops[found.start[:-1]]
    new[found.first[:-1][np.diff(found.first) > 0]] = True
    return np.flatnonzero(new)


def within(found: Words, first: np.ndarray) -> Words:
    """The same words, those of each segment as a text."""
    return Words(found.hashes, np.append(first, len(found.hashes)), found.start, found.end, found.data, found.text_start)


def char_places(data: np.ndarray, text_start: np.ndarray, owner: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers of characters before byte ``places``, counted from the start of their text."""
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return chars[places] - chars[text_start[owner]]
