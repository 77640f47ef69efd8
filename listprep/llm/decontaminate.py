"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words: the hash of a window takes the words at the
mask's ones and ignores the others, so that a changed word breaks a hit only where the mask
looks at it. Seeds of the benchmark and of the documents are joined on the hash; around every
hit the item is laid over the document (item word ``i`` on document word ``diagonal + i``) and
the longest stretch of words that agree well enough is measured.

The masks were chosen so that every stretch of ``MIN_WORDS`` to 20 words that reaches
``MIN_AGREEMENT`` has a window in which one of them sees equal words only, wherever the others
are (the tests try all placements); longer stretches have more such windows. An item of fewer
words is searched as a whole, word for word, by one window of its own length.

Words are runs of letters, digits and non-ASCII bytes in lower case; other ASCII characters
separate them. Nulls count as empty texts; a null id takes no part; items without words and
tables without rows give nothing. Rows that repeat an ``item_id`` or a ``doc_id`` count as separate
texts under one id. Of equally good places the first in the document counts. Columns beside
the ids and ``text`` are not looked at, whatever their names. Texts come in slices of a few MB, a
longer one by itself; every hit takes only the words under its item on, however long the text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from . import words
from .tables import arrow_map

MASKS = ("111011", "110100011", "10010111", "1000100111")
MIN_WORDS = 11
MIN_AGREEMENT = 0.75
#: Words of a short item that prove contamination; overlaps with shorter ones are reported only.
LEAST_WORDS = 5
#: Bits of the filter of benchmark hashes that goes to every task: 4 MB for each of two, whatever the benchmark's size.
FILTER_BITS = 22

_SHORT = 1 << 16

HITS = "doc_id long, copy long, seeds array<long>, places array<int>, words binary"
FOUND = "doc_id long, item_id long, doc_word int, item_word int, n_words int, n_agree int, item_words int"


def _hashes(texts: pa.Array) -> words.Words:
    return words.words_of(pc.utf8_lower(texts.fill_null("")), lower=False, breaks=words.NO_LETTER)


def _seeds(found: words.Words, masks: Mapping[int, str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per mask, by its number: the hash of every window that lies within one text, and its first word."""
    out = []
    h, first = found.hashes, found.first
    for number, mask in masks.items():
        span = len(mask)
        m = max(len(h) - span + 1, 0)
        total = np.full(m, number, dtype=np.uint64)
        for j, bit in enumerate(mask):
            if bit == "1":
                total *= np.uint64(words._BASE)
                total += h[j : j + m]
        inside = np.ones(m, dtype=bool)
        for j in range(1, span):
            over = first[1:-1] - j
            inside[over[(over >= 0) & (over < m)]] = False
        place = np.flatnonzero(inside)
        out.append((number, words.mix(total[place]), place))
    return out


def _numbered(masks: Sequence[str], short: Sequence[int]) -> dict[int, str]:
    """The masks from 1 on; those of short items, which see every word, from ``_SHORT`` on."""
    return {k: mask for k, mask in enumerate(masks, 1)} | {_SHORT + n: "1" * n for n in short}


def _short_lengths(benchmark: DataFrame, min_words: int) -> list[int]:
    """Numbers of words, below ``min_words``, that some item has: fewer than ``min_words`` numbers."""

    def per_batch(batch):
        counts = np.diff(_hashes(batch.column("text")).first)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(counts[counts < min_words]))], names=["n"])

    found = arrow_map(benchmark.filter("item_id is not null").select("text"), "n long", per_batch).distinct()
    return sorted(row.n for row in found.collect() if row.n)


def _low(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _high(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def benchmark_seeds(benchmark: DataFrame, masks: Mapping[int, str], min_words: int) -> DataFrame:
    """``seed``, ``item_id``, ``item_place`` of every window of every item, each once."""

    def per_batch(batch):
        found = _hashes(batch.column("text"))
        ids = batch.column("item_id").to_numpy(zero_copy_only=False)
        counts = np.diff(found.first)
        for number, seed, place in _seeds(found, masks):
            owner = np.searchsorted(found.first, place, side="right") - 1
            own = counts[owner] == number - _SHORT if number > _SHORT else counts[owner] >= min_words
            seed, place, owner = seed[own], place[own], owner[own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed.view(np.int64)), pa.array(ids[owner]), pa.array((place - found.first[owner]).astype(np.int32))],
                names=["seed", "item_id", "item_place"],
            )

    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null")
    return arrow_map(items, "seed long, item_id long, item_place int", per_batch).distinct()


def _filters(seeds: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two bit tables of the benchmark's hashes; at most 2**22 numbers each come to the driver."""
    size = 1 << FILTER_BITS
    tables = []
    for bucket in (F.shiftrightunsigned("seed", 64 - FILTER_BITS), F.col("seed").bitwiseAND(F.lit(size - 1))):
        rows = seeds.select(bucket.cast("int").alias("b")).distinct().toArrow().column("b").to_numpy()
        table = np.zeros(size, dtype=bool)
        table[rows] = True
        tables.append(table)
    return tables[0], tables[1]


def _scan(documents: DataFrame, seeds: DataFrame, masks: Mapping[int, str]) -> DataFrame:
    """Documents with a window that may be one of the benchmark's: those windows and all words."""
    shared = documents.sparkSession.sparkContext.broadcast(_filters(seeds))

    def per_batch(batch):
        low, high = shared.value
        texts, ids, copies = (batch.column(name) for name in ("text", "doc_id", "copy"))
        for i, j in words.slices(texts):
            found = _hashes(texts.slice(i, j - i))
            hit_seed, hit_place = [], []
            for _, seed, place in _seeds(found, masks):
                maybe = np.flatnonzero(low[_low(seed)])
                maybe = maybe[high[_high(seed[maybe])]]
                hit_seed.append(seed[maybe])
                hit_place.append(place[maybe])
            seed, place = np.concatenate(hit_seed), np.concatenate(hit_place)
            if len(seed) == 0:
                continue
            order = np.argsort(place, kind="stable")
            seed, place = seed[order], place[order]
            owner = np.searchsorted(found.first, place, side="right") - 1
            for k in np.unique(owner):
                own = owner == k
                a, b = found.first[k], found.first[k + 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i + int(k), 1),
                        copies.slice(i + int(k), 1),
                        pa.array([seed[own].view(np.int64)], pa.list_(pa.int64())),
                        pa.array([(place[own] - a).astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([found.hashes[a:b].tobytes()], pa.binary()),
                    ],
                    names=["doc_id", "copy", "seeds", "places", "words"],
                )

    docs = documents.select(
        F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("copy"), F.coalesce("text", F.lit("")).alias("text")
    ).filter("doc_id is not null")
    return arrow_map(docs, HITS, per_batch)


def _best_stretch(agree: np.ndarray, least: float, min_words: int = 1) -> tuple[int, int]:
    """The longest stretch, and the first of those, of ``min_words`` words at least that begins and
    ends with a word that agrees and whose share of agreement is ``least`` at least; else (0, 0)."""
    share = Fraction(least).limit_denominator(10**6)
    gain = np.where(agree, share.denominator - share.numerator, -share.numerator)
    sums = np.concatenate([[0], np.cumsum(gain)])
    # where the gain of a stretch is not negative, its share is reached; one that ends in a word that differs never is the longest
    begins, ends = np.flatnonzero(agree), np.flatnonzero(agree) + 1
    if len(begins) == 0:
        return 0, 0
    # begins that are lower than all before, and for every end the first of them that is low enough
    low = np.minimum.accumulate(sums[begins])
    first = np.searchsorted(-low, -sums[ends], side="left")
    reached = first < len(begins)
    begin, end = begins[first[reached]], ends[reached]
    length = end - begin
    if len(length) == 0 or length.max() < min_words:
        return 0, 0
    at = int(np.argmax(length))
    return int(begin[at]), int(end[at])


def overlaps(
    documents: DataFrame,
    benchmark: DataFrame,
    masks: Sequence[str] = MASKS,
    min_words: int = MIN_WORDS,
    min_agreement: float = MIN_AGREEMENT,
) -> DataFrame:
    """One row per document and item that share a stretch of at least ``min_words`` words of
    which the share ``min_agreement`` agrees; on one diagonal the longest, of several diagonals the one
    with most agreement. An item of fewer words has to be there word for word. With other masks
    than the default, a stretch in which none of them agrees is not found.

    ``doc_word``, ``item_word``: first word of the stretch in either text; ``n_words``: its
    length; ``n_agree``: words that agree; ``item_words``: length of the item.
    """
    numbered = _numbered(masks, _short_lengths(benchmark, min_words))
    seeds = materialise(benchmark_seeds(benchmark, numbered, min_words), "seeds")
    scanned = materialise(_scan(documents, seeds, numbered), "scanned")
    hits = scanned.select("doc_id", "copy", F.explode(F.arrays_zip("seeds", "places")).alias("hit"))
    hits = hits.select("doc_id", "copy", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("place"))
    laid = (
        hits.join(seeds, "seed")
        .select("doc_id", "copy", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal"))
        .distinct()
    )

    def item_words(batch):
        for i, j in words.slices(batch.column("text")):
            found = _hashes(batch.column("text").slice(i, j - i))
            parts = [found.hashes[a:b].tobytes() for a, b in zip(found.first[:-1], found.first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").slice(i, j - i), pa.array(parts, pa.binary())], names=["item_id", "item"]
            )

    items = arrow_map(
        benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null"),
        "item_id long, item binary",
        item_words,
    )
    # of the document only the words under the item
    pairs = laid.join(materialise(items, "items"), "item_id").join(scanned.select("doc_id", "copy", "words"), ["doc_id", "copy"])
    begin = F.greatest("diagonal", F.lit(0))
    size = F.col("diagonal") + (F.octet_length("item") / 8).cast("int") - begin
    pairs = pairs.select("doc_id", "item_id", "diagonal", F.substring("words", begin * 8 + 1, size * 8).alias("words"), "item")

    def measure(batch):
        out = []
        columns = [batch.column(name).to_pylist() for name in ("doc_id", "item_id", "diagonal", "words", "item")]
        for doc_id, item_id, diagonal, text, item in zip(*columns):
            text, item = np.frombuffer(text, dtype=np.uint64), np.frombuffer(item, dtype=np.uint64)
            low = max(0, -diagonal)
            agree = text == item[low : low + len(text)]
            if len(item) < min_words:
                begin, end = (0, len(item)) if len(text) == len(item) and agree.all() else (0, 0)
            else:
                begin, end = _best_stretch(agree, min_agreement, min_words)
            if end > begin:
                begin, end = begin + low, end + low
                same = int(agree[begin - low : end - low].sum())
                out.append((doc_id, item_id, begin + diagonal, begin, end - begin, same, len(item)))
        if out:
            kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 5
            names = [part.split()[0] for part in FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    found = arrow_map(pairs.select("doc_id", "item_id", "diagonal", "words", "item"), FOUND, measure)
    best = F.max_by(
        F.struct("doc_word", "item_word", "n_words", "n_agree", "item_words"),
        F.struct("n_agree", -F.col("n_words"), -F.col("doc_word"), -F.col("item_word")),
    )
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The ids of documents that overlap with an item in ``LEAST_WORDS`` words at least, each once."""
    return overlaps(documents, benchmark, **options).filter(F.col("n_words") >= LEAST_WORDS).select("doc_id").distinct()
