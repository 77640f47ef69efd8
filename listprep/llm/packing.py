"""Best-fit packing of documents into sequences, with certified bin counts.

Documents are tokenised, ended with an id, and cut only when longer than a sequence: into
whole sequences, with what is over as the first piece. Whole pieces are sequences by
themselves. The others are dealt out by a hash to partitions of about ``PARTITION`` pieces,
and each partition packs its own by best-fit decreasing.

A partition's bins are certified when their number equals a lower bound from dual feasible
functions of its lengths: no packing of these pieces has fewer. Partitions with a gap keep the
bins that are full but for ``SLACK`` ids and give the pieces of all others away; these meet in
new partitions and are packed again, round after round, until one partition is left. Certified
partitions give away the bin they filled least, where the rounding of many small sums is.

No task sees more than one partition's lengths; texts and ids are read once and never moved.
Null texts are empty and have the end id alone. Rows that repeat a ``doc_id``, or have none,
are documents of their own; a row of them is told apart by ``copy``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from . import tokens, words
from .tables import arrow_map, ship

CAPACITY = 1024
PARTITION = 4096
SLACK = 8
ROUNDS = 8

PIECES = "doc_id long, copy long, piece int, start long, length int, ids_crc32 long"


def pieces(documents: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of every document."""

    def per_batch(batch) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path, drops_white_space=False)
        texts, ids, copies = (batch.column(name) for name in ("text", "doc_id", "copy"))
        for i, j in words.slices(texts):
            flat, first = encoder.encode(texts.slice(i, j - i))
            out: list[tuple[int, int, int, int, int]] = []
            for k in range(j - i):
                own = np.append(flat[first[k] : first[k + 1]], end_id).astype("<u4")
                head = len(own) % capacity or capacity
                bounds = [0, *range(head, len(own) + 1, capacity)]
                for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    out.append((k, n, a, b - a, zlib.crc32(own[a:b].tobytes())))
            row, piece, start, length, crc = (np.array(column) for column in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(i, j - i).take(pa.array(row)),
                    copies.slice(i, j - i).take(pa.array(row)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int32()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "copy", "piece", "start", "length", "ids_crc32"],
            )

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("copy"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return arrow_map(rows, PIECES, per_batch)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, packed by best-fit decreasing (longest first, fullest bin that fits)."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    levels, opened = 0, 0  # bit f is set when a bin has f free
    for n in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[n])
        fitting = levels >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            where = by_free[free].pop()
            if not by_free[free]:
                levels &= ~(1 << free)
        else:
            free, where, opened = capacity, opened, opened + 1
        bins[n], offsets[n] = where, capacity - free
        left = free - length
        if left:
            by_free[left].append(where)
            levels |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of the bounds that dual feasible functions give for the number of bins."""
    if len(lengths) == 0:
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    # f_e(x): all of a bin above capacity - e, x from e on, nothing below
    for e in range(1, capacity // 2 + 1):
        value = np.where(sizes > capacity - e, capacity, np.where(sizes >= e, sizes, 0))
        best = max(best, -(-int((counts * value).sum()) // capacity))
    # u_k(x): x where (k + 1) x / capacity is whole, else its floor in k-ths of a bin
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def _packed(loose: DataFrame, partitions: int, round_: int, capacity: int, last: bool) -> DataFrame:
    """Each partition packed; ``settled`` says which pieces stay where they are."""
    deal = F.pmod(F.xxhash64("doc_id", "copy", "piece", F.lit(round_)), F.lit(partitions))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "copy", "piece"], ascending=[False, True, True, True], ignore_index=True)
        lengths = group["length"].to_numpy(dtype=np.int64)
        bins, offsets = best_fit(lengths, capacity)
        used = np.bincount(bins, weights=lengths).astype(np.int64)
        bound = lower_bound(lengths, capacity)
        if last:
            stays = np.ones(len(used), dtype=bool)
        elif len(used) > bound:
            stays = used >= capacity - SLACK
        else:
            stays = np.arange(len(used)) != np.argmin(used)
        group["bin"], group["offset"], group["settled"] = bins, offsets, stays[bins]
        group["bins"], group["bound"] = len(used), bound
        return group

    schema = loose.select("doc_id", "copy", "piece", "start", "length", "ids_crc32").schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    ddl += ", part int, bin long, offset long, settled boolean, bins int, bound int"
    rows = loose.select("doc_id", "copy", "piece", "start", "length", "ids_crc32", deal.cast("int").alias("part"))
    return rows.groupBy("part").applyInPandas(pack, ddl)


def pack(
    documents: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = 2,
    partition: int = PARTITION,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``copy``, ``piece``, ``start`` (ids of its document before
    it), ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, and ``round`` (of the packing
    that settled it, -1 for whole sequences), ``bins`` and ``bound`` of the partition it was
    settled in."""
    ship(documents.sparkSession)
    path = path or tokens.vocabulary_path(tokens.BYTE_BPE)
    cut = materialise(pieces(documents, path, capacity, end_id), "pieces")
    columns = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]
    whole = cut.filter(F.col("length") == capacity).select(
        *columns,
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(-1).alias("round"),
        F.lit(1).alias("bins"),
        F.lit(1).alias("bound"),
    )
    settled = [whole]
    loose, count = cut.filter(F.col("length") < capacity), cut.filter(F.col("length") < capacity).count()
    for round_ in range(ROUNDS):
        if not count:
            break
        partitions = -(-count // partition)
        last = partitions == 1 or round_ == ROUNDS - 1
        packed = materialise(_packed(loose, partitions, round_, capacity, last), "packed")
        number = F.lit(round_ << 56) + F.shiftleft(F.col("part").cast("long"), 32) + F.col("bin")
        settled.append(
            packed.filter("settled").select(*columns, number.alias("sequence_id"), "offset", F.lit(round_).alias("round"), "bins", "bound")
        )
        loose = packed.filter("not settled").select(*columns)
        count = 0 if last else loose.count()
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out
