"""Token ids of all documents in compressed binary files, in the order of ``doc_id``.

A file holds the frames of one range of ids, as rows of a Parquet table: ``part`` (of the
range), ``frame`` (from 0 in it), ``n_ids`` and ``data``. A frame's bytes are, all numbers
little-endian: the mark ``LPT2``; the number of documents (u32), their ids (i64), which of them
are null (u8) and their numbers of ids (i64); the number of blocks (u32) and for each its length
in bytes (u32) and the checksum of its ids (u32, see ``codec.checksum``); then the blocks
(``codec``), each of ``codec.BLOCK`` ids but the last. A frame ends with the document that
brings it to ``FRAME`` ids, so that it can be read without any other.

Documents are sorted by ``doc_id`` (null first), rows that repeat one by a hash of their text, so
that an id of many rows is no single task's. Null texts are empty and have the end id alone. A
table without rows gives no frames; columns beside ``doc_id`` and ``text`` are not looked at,
whatever their names. Texts come in slices of a few MB, a longer one by itself and in a frame that
it closes. Ids of 65536 and more are an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import codec, tokens, words
from .tables import arrow_map, ship

FRAME = 8_000_000
MARK = b"LPT2"
WRITTEN = "part int, frame int, n_ids long, data binary"
READ = "part int, frame int, place long, doc_id long, n_tokens long, ids_crc32 long"


def pack_frame(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = codec.encode_blocks(ids)
    sums = [codec.checksum(ids[k * codec.BLOCK : (k + 1) * codec.BLOCK]) for k in range(len(blocks))]
    table = np.array([x for pair in zip(map(len, blocks), sums) for x in pair], dtype="<u4")
    head = [
        MARK,
        struct.pack("<I", len(doc_ids)),
        np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes(),
        np.array([i is None for i in doc_ids], dtype=np.uint8).tobytes(),
        np.asarray(lengths, dtype="<i8").tobytes(),
        struct.pack("<I", len(blocks)),
        table.tobytes(),
    ]
    return b"".join(head + blocks)


def unpack_frame(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a frame; raises ``ValueError`` when a block is broken."""
    if data[:4] != MARK:
        raise ValueError("not a frame of token ids")
    n = struct.unpack_from("<I", data, 4)[0]
    doc_ids = np.frombuffer(data, dtype="<i8", count=n, offset=8)
    null = np.frombuffer(data, dtype=np.uint8, count=n, offset=8 + 8 * n)
    lengths = np.frombuffer(data, dtype="<i8", count=n, offset=8 + 9 * n)
    at = 8 + 17 * n
    count = struct.unpack_from("<I", data, at)[0]
    table = np.frombuffer(data, dtype="<u4", count=2 * count, offset=at + 4).reshape(-1, 2)
    bounds = at + 4 + 8 * count + np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
    ids = codec.decode_blocks([data[a:b] for a, b in zip(bounds, bounds[1:])], int(lengths.sum()))
    for k in range(count):
        if codec.checksum(ids[k * codec.BLOCK : (k + 1) * codec.BLOCK]) != table[k, 1]:
            raise ValueError(f"block {k} of the frame is broken")
    return [None if gone else int(i) for i, gone in zip(doc_ids, null)], lengths, ids


def write(documents: DataFrame, folder: str, path: str | None = None, end_id: int = 1, frame: int = FRAME) -> None:
    """Encode all texts and write their ids to a new folder."""
    ship(documents.sparkSession)
    path = path or tokens.vocabulary_path(tokens.WORD_BPE)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # an id that many rows have, or none, is dealt over several ranges by its texts
    key = F.xxhash64("text").alias("key")
    rows = rows.select("*", key).repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "text").drop("key")

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path, drops_white_space=True)
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0

        def emit() -> pa.RecordBatch:
            data = pack_frame(doc_ids, np.concatenate(lengths), np.concatenate(held))
            return pa.RecordBatch.from_pylist([{"part": part, "frame": number, "n_ids": size, "data": data}], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("frame", pa.int32()), ("n_ids", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            texts = batch.column("text")
            for i, j in words.slices(texts):
                ids, first = encoder.encode(texts.slice(i, j - i))
                # the end id after each document
                held.append(codec.checked(np.insert(ids, first[1:], end_id)))
                lengths.append(np.diff(first) + 1)
                doc_ids += batch.column("doc_id").slice(i, j - i).to_pylist()
                size += len(held[-1])
                if size >= frame:
                    yield emit()
                    doc_ids, lengths, held, size, number = [], [], [], 0, number + 1
        if doc_ids:
            yield emit()

    rows.mapInArrow(per_partition, WRITTEN).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids_crc32``."""
    frames = spark.read.schema(WRITTEN).parquet(folder)

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in range(batch.num_rows):
            doc_ids, lengths, ids = unpack_frame(batch.column("data")[row].as_buffer().to_pybytes())
            ends = np.cumsum(lengths)
            sums = [codec.checksum(ids[b - n : b]) for b, n in zip(ends, lengths)]
            keys = [pa.array(np.full(len(ends), batch.column(name)[row].as_py()), pa.int32()) for name in ("part", "frame")]
            columns = [pa.array(ends - lengths), pa.array(doc_ids, pa.int64()), pa.array(lengths), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([*keys, *columns], names=[c.split()[0] for c in READ.split(", ")])

    rows = arrow_map(frames, READ, per_batch)
    # a row per frame and one per file; the columns of the ids are not read for them
    sizes = frames.select("part", "frame", "n_ids")
    before = (Window.unboundedPreceding, -1)
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("frame").rowsBetween(*before))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    ahead = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(*before))
    starts = sizes.select("part", "frame", F.coalesce(inside, F.lit(0)).alias("inside")).join(
        parts.select("part", F.coalesce(ahead, F.lit(0)).alias("ahead")), "part"
    )
    rows = rows.join(starts, ["part", "frame"])
    return rows.select("doc_id", (F.col("ahead") + F.col("inside") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
