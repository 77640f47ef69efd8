"""Substring dedup by MinHash banding over paragraphs.

Repeated passages seldom keep to line breaks, so a text is cut into paragraphs at places its
content decides: ends of lines and of sentences. Where pieces of fewer than ``LEAST`` words
follow each other (verse, lists, dialogue), they are joined: of the ends between them those stay
whose two words hash lowest among all ends closer than ``LEAST`` words, so that a copy is cut
like its original but near its edges. A paragraph of more than ``LONG`` words is compared as a
whole and also in parts, cut between any words by the same rule. Every paragraph has a MinHash
signature of its word shingles, in bands tuned so that a pair at the similarity
collides in one of them with probability ``RECALL``. Equal shingle sets are one class; classes
that collide are joined and confirmed by exact Jaccard on the full sets, long lists of them in
blocks, and the confirmed links give components (``neardup.links``, ``components``).

The first paragraph of a component, in the order of ``doc_id``, ``copy`` and place, stays; all
others that do not overlap it are repeats. Repeats with at most ``GAP`` characters between them
are one span, and a span is removed when its repeats have at least ``SPAN`` words: shorter ones
are common phrases. A few words that are too short to be a paragraph, alone between two of them,
count when the first paragraph has the same words before it.

Null and empty texts have no paragraphs. A null ``doc_id`` sorts first. Rows that repeat a
``doc_id`` are documents of their own, told apart by ``copy``, a hash of the text; rows that
agree in both are one document and are treated alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dedup import key_bits, with_bits
from ..storage import drop, materialise, sweep
from . import words
from .components import components
from .neardup import links
from .tables import arrow_map, free_names, ship

#: Fewest words of a paragraph, most of one without parts, fewest words of a span, most characters between two repeats of a span.
LEAST = 6
LONG = 70
SPAN = 20
GAP = 60
SHINGLE = 5
PERCENT = 80
RECALL = 0.995
MOST_HASHES = 24

PLACES = "doc_id long, copy long, segment int, start int, end int, n_words int, lead int, lead_words long, set_a long, set_b long"
BANDED = "doc_id long, copy long, segment int, size int, set_a long, set_b long, bands array<long>"


def tuned_bands(similarity: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows with most rows, of at most ``most`` values, where a pair of that similarity
    collides with probability ``recall`` at least; rows are 1 if nothing else reaches it."""
    best = (most, 1)
    for rows in range(1, most + 1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                best = (bands, rows)
                break
    return best


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.coalesce("text", F.lit("")).alias("text")
    )


def _lowest(keys: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """The places ``at`` whose key is the lowest within fewer than ``least`` words, of equal ones the first."""
    padded = np.concatenate([np.zeros(least, dtype=np.uint64), keys, np.zeros(least, dtype=np.uint64)])
    own, lowest = keys[at], np.ones(len(at), dtype=bool)
    for d in range(1, least):
        lowest &= (padded[at + least - d] > own) & (padded[at + least + d] >= own)
    return at[lowest]


def _starts(found: words.Words, least: int) -> np.ndarray:
    """First words of paragraphs: segments of ``least`` words and more, and joined shorter ones."""
    first = words.segments(found)
    if len(first) == 0:
        return first
    short = np.diff(np.append(first, len(found.hashes))) < least
    opens = np.isin(first, found.first)
    forced = ~short | opens
    forced[1:] |= ~short[:-1]
    keys = np.full(len(found.hashes), np.iinfo(np.uint64).max, dtype=np.uint64)
    inner = first[~forced]
    keys[inner] = _between(found, inner)
    keys[first[forced]] = 0
    return np.sort(np.concatenate([first[forced], _lowest(keys, inner, least)]))


def _between(found: words.Words, at: np.ndarray) -> np.ndarray:
    """A key, never 0, of the two words on either side of each place."""
    return words.mix(found.hashes[at - 1] * np.uint64(words._BASE) + found.hashes[at]) | np.uint64(1)


def _cut(texts: pa.Array, least: int) -> tuple[words.Words, words.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words by text and by paragraph (parts of a long one come after it), the text of each
    paragraph, its place in it, and the words left over before it: how many and their hash."""
    found = words.words_of(texts)
    begin = _starts(found, least)
    end = np.append(begin[1:], len(found.hashes))
    whole = end - begin >= least
    # too few words for a paragraph: noted with the one that follows in the same text
    lead, lead_words = np.zeros(len(begin), dtype=np.int64), np.zeros(len(begin), dtype=np.uint64)
    left = np.flatnonzero(~whole[:-1] & ~np.isin(end[:-1], found.first)) if len(begin) else begin
    lead[left + 1] = end[left] - begin[left]
    for d in range(least - 1):
        has = left[begin[left] + d < end[left]]
        lead_words[has + 1] = words.mix(lead_words[has + 1] + found.hashes[begin[has] + d] + np.uint64(1))
    begin, end, lead, lead_words = begin[whole], end[whole], lead[whole], lead_words[whole]

    long = np.flatnonzero(end - begin > LONG)
    if len(long):
        keys = np.full(len(found.hashes) + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
        inner = _ranges(begin[long] + 1, end[long])
        keys[inner] = _between(found, inner)
        keys[begin[long]] = keys[end[long]] = 0
        cuts = _lowest(keys, inner, least)
        cut = long[np.diff(np.searchsorted(cuts, np.append(begin[long], len(keys)))) > 0]
        part = np.sort(np.concatenate([begin[cut], cuts]))
        of = np.searchsorted(begin, part, side="right") - 1
        stop = np.minimum(np.append(part[1:], len(keys)), end[of])
        leads = part == begin[of]
        begin, end = np.concatenate([begin, part]), np.concatenate([end, stop])
        lead = np.concatenate([lead, np.where(leads, lead[of], 0)])
        lead_words = np.concatenate([lead_words, np.where(leads, lead_words[of], np.uint64(0))])
        order = np.lexsort((-end, begin))
        begin, end, lead, lead_words = begin[order], end[order], lead[order], lead_words[order]
    at = _ranges(begin, end)
    bounds = np.concatenate([[0], np.cumsum(end - begin)])
    parts = words.Words(found.hashes[at], bounds, found.start[at], found.end[at], found.data, found.text_start)
    owner = np.searchsorted(found.first, begin, side="right") - 1
    place = np.arange(len(begin)) - np.searchsorted(owner, np.arange(len(texts)))[owner]
    return found, parts, owner, place, lead, lead_words


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of [begin, end), one range after the other."""
    size = end - begin
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(int(size.sum()))


def _bands(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One value per band of every signature."""
    signature = signature.reshape(-1, bands, rows)
    banded = np.zeros((len(signature), bands), dtype=np.uint64)
    for k in range(rows):
        banded = words.mix(banded + signature[:, :, k] + np.uint64(k + 1))
    return banded + np.arange(bands, dtype=np.uint64)


def _units(documents: DataFrame, shingle: int, least: int, banding: tuple[int, int] | None = None) -> DataFrame:
    """All paragraphs, with their bands or, without ``banding``, with their places."""

    def per_batch(batch):
        texts = batch.column("text")
        for i, j in words.slices(texts):
            found, parts, owner, place, lead, lead_words = _cut(texts.slice(i, j - i), least)
            n_words = np.diff(parts.first)
            if len(n_words) == 0:
                continue
            runs, first = words.shingles(parts, shingle)
            order = np.lexsort((runs, np.repeat(np.arange(len(n_words)), np.diff(first))))
            runs = runs[order]
            new = np.ones(len(runs), dtype=bool)
            new[1:] = runs[1:] != runs[:-1]
            new[first[:-1][np.diff(first) > 0]] = True
            once, bounds = runs[new], np.concatenate([[0], np.cumsum(new)])[first]
            size = np.diff(bounds)
            keys = [np.add.reduceat(words.mix(once ^ np.uint64(salt)), bounds[:-1]) for salt in (0, words._BASE)]
            columns = [batch.column(name).slice(i, j - i).take(pa.array(owner)) for name in ("doc_id", "copy")]
            columns.append(pa.array(place.astype(np.int32)))
            sets = [pa.array(key.view(np.int64)) for key in keys]
            if banding:
                values = _bands(words.minhash(once, bounds, banding[0] * banding[1]), *banding)
                flat = pa.array(values.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, banding[0], dtype=np.int32)), flat)
                columns += [pa.array(size.astype(np.int32)), *sets, lists]
            else:
                begin, end = parts.start[parts.first[:-1]], parts.end[parts.first[1:] - 1]
                chars = [words.char_places(found.data, found.text_start, owner, at).astype(np.int32) for at in (begin, end)]
                columns += [*map(pa.array, chars), *(pa.array(n.astype(np.int32)) for n in (n_words, lead)), pa.array(lead_words.view(np.int64)), *sets]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    schema = BANDED if banding else PLACES
    return arrow_map(_rows(documents), schema, per_batch)


def _sets_of(documents: DataFrame, wanted: DataFrame, shingle: int, least: int) -> DataFrame:
    """``node`` and shingles of wanted paragraphs (``node``, ``doc_id``, ``copy``, ``segment``)."""
    wanted = wanted.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("segment", "node")).alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("of_id"), F.col("copy").alias("of_copy"), "wanted")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("copy") == F.col("of_copy"))

    def per_batch(batch):
        texts, asked = batch.column("text"), batch.column("wanted")
        for i, j in words.slices(texts):
            _, parts, owner, *_ = _cut(texts.slice(i, j - i), least)
            runs, first = words.shingles(parts, shingle)
            begin = np.searchsorted(owner, np.arange(j - i))
            nodes, sets = [], []
            for k in range(j - i):
                for one in asked[i + k].as_py():
                    at = begin[k] + one["segment"]
                    nodes.append(one["node"])
                    sets.append(np.unique(runs[first[at] : first[at + 1]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    rows = _rows(documents).join(wanted, same).select("text", "wanted")
    return arrow_map(rows, "node long, shingles binary", per_batch)


def repeats(
    documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, recall: float = RECALL, least: int = LEAST, span: int = SPAN
) -> DataFrame:
    """Spans to remove: ``doc_id``, ``copy``, ``start`` and ``end`` (characters, the end not
    included), ``n_words``, ``paragraphs`` and ``first_doc_id`` (of the first paragraph's first
    occurrence)."""
    spark = documents.sparkSession
    ship(spark)
    bands, rows = tuned_bands(percent / 100, recall)
    # the bands follow from the set and are carried along; places are not needed before the end, and read from the texts then
    units = _units(documents, shingle, least, (bands, rows))
    # equal sets have equal bands; places are not needed before the end, and read from the texts then
    classes = units.groupBy("set_a", "set_b").agg(
        F.min(F.struct("doc_id", "copy", "segment")).alias("at"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")
    )
    banded = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    del units, classes
    sweep(spark)
    posted = banded.select("node", F.explode("bands").alias("value"))
    lengths = materialise(posted.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1"), "lengths")
    # nearly all values belong to one class; a bitmap of fixed size leaves them in the scan
    lists = materialise(with_bits(posted, "value", key_bits(lengths, "value")).join(lengths, "value"), "lists")
    classes = materialise(banded.drop("bands"), "classes")
    del posted, lengths
    drop(banded)
    sweep(spark)
    # classes that share a list agree on one band at least: no signature is compared
    colliding = classes.join(lists.select("node").distinct(), "node", "left_semi")
    colliding = materialise(colliding.select("node", "size", F.array().cast("array<long>").alias("signature")), "colliding")
    whereabouts = classes.select("node", "at.*")
    edges = links(
        lists, colliding, lambda wanted: _sets_of(documents, whereabouts.join(wanted, "node", "left_semi"), shingle, least), 0, percent
    )
    found = components(materialise(edges, "links"))
    del edges
    sweep(spark)
    # classes that occur once and link with nothing have no repeats
    linked = found.select("node", "component").unionByName(found.select(F.col("component").alias("node"), "component")).distinct()
    groups = classes.select("set_a", "set_b", "node", "copies").join(linked, "node", "left").filter("copies > 1 or component is not null")
    groups = materialise(groups.select("set_a", "set_b", F.coalesce("component", "node").alias("component")), "groups")
    places = _units(documents, shingle, least)
    places = materialise(places.join(groups, ["set_a", "set_b"]).drop("set_a", "set_b"), "places")
    sweep(spark)
    here = F.struct("doc_id", "copy", "start", "end", "lead_words")
    first = materialise(places.groupBy("component").agg(F.min(here).alias("first")), "firsts")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == F.col("first.copy"))
    # a long paragraph and its parts may be alike
    apart = ~same | (F.col("start") >= F.col("first.end"))
    later = places.join(first, "component").filter((here > F.col("first")) & apart)
    return _spans(later.distinct(), span)


def _spans(later: DataFrame, span: int) -> DataFrame:
    """Repeats of one document that lie next to each other, as spans."""
    within = Window.partitionBy("doc_id", "copy").orderBy("segment")
    before = F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    led = (F.col("lead") > 0) & (F.col("lead_words") == F.col("first.lead_words")) & (F.lag("segment").over(within) == F.col("segment") - 1)
    rows = later.withColumn("before", before).withColumn("led", F.coalesce(led, F.lit(False)))
    rows = rows.withColumn("new", F.coalesce((F.col("start") - F.col("before") > GAP) & ~F.col("led"), F.lit(True)).cast("int"))
    rows = rows.withColumn("span", F.sum("new").over(within))
    # parts of a paragraph that is a repeat itself are counted with it
    counted = F.coalesce(F.col("end") > F.col("before"), F.lit(True))
    extra = F.when(F.col("led") & (F.col("new") == 0), F.col("lead")).otherwise(0)
    spans = rows.groupBy("doc_id", "copy", "span").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum(F.when(counted, F.col("n_words") + extra).otherwise(0)).alias("n_words"),
        F.sum(counted.cast("int")).cast("int").alias("paragraphs"),
        F.min_by(F.col("first.doc_id"), "segment").alias("first_doc_id"),
    )
    return spans.filter(F.col("n_words") >= span).drop("span")


def dedup_passages(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` without their spans to remove."""
    of_id, of_copy, copy, spans = free_names(documents, "_of_id", "_of_copy", "_copy", "_spans")
    found = repeats(documents, **options).groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(spans))
    found = found.select(F.col("doc_id").alias(of_id), F.col("copy").alias(of_copy), spans)
    rows = documents.withColumn(copy, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (F.col(copy) == F.col(of_copy))
    rows = rows.join(found, same, "left")

    def kept_part(k):
        begin = F.coalesce(F.get(spans, k - 1).getField("end"), F.lit(0))
        end = F.coalesce(F.get(spans, k).getField("start"), F.length("text"))
        return F.substring("text", begin + 1, end - begin)

    parts = F.transform(F.sequence(F.lit(0), F.size(spans)), kept_part)
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(parts, ""))
    return rows.select(*[text.alias(n) if n == "text" else F.col(f"`{n}`") for n in documents.columns])
