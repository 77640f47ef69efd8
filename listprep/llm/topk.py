"""Exact top-k inner products with pruning by norm and by rotated partial sums.

Each component x becomes the integer floor(256 x); scores are integer inner products. The
rotation to the singular directions of all vectors (eigenvectors of their Gram matrix, a d x d
sum over the table) puts most of every inner product into the first few components. Candidates
lie in blocks of descending length. For a block of queries and a block of candidates, met in one
task, the first components give a partial sum, and the Cauchy-Schwarz inequality on what is left
a bound; only pairs whose bound reaches the query's k-th best score so far are scored exactly,
in integers. The first block of candidates, with the longest vectors, is searched first; with
the scores found there a block of queries meets only the blocks whose longest vector can still
reach one of its queries, and no others.

Vectors that are null, hold a null or non-finite component, or have no id take no part. Of rows
that repeat an id the smallest vector counts. Shorter vectors count as ended by zeros. Scores
have to fit in 64 bits. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .tables import arrow_map, ship, top_ranked, with_first_of

SCALE = 256
BLOCK = 4096
MOST_BLOCKS = 10_000
QUERIES = 1024
STRIP = 512
#: Share of the total of squares that the first rotated components hold.
ENERGY = 0.7

PLACED = "vec_id long, x binary, norm double"
FOUND = "query_id long, vec_id long, score long"


def _prepared(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``x`` (64-bit integers), ``norm`` of the vectors that take part, each id once."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE))
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return with_first_of(rows, "vec_id", ["x"])


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the outer products of all vectors: ``width`` squared numbers."""

    def per_batch(batch):
        total = np.zeros((width, width))
        x = _matrix(batch.column("x"), width).astype(np.float64)
        total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["cells"])

    cells = arrow_map(rows, "cells array<double>", per_batch).select(F.posexplode("cells").alias("cell", "value"))
    found = cells.groupBy("cell").agg(F.sum("value").alias("value")).toArrow().sort_by("cell")
    return found.column("value").to_numpy().reshape(width, width) if found.num_rows else np.zeros((width, width))


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width), dtype=np.int64)
    if pa.types.is_binary(column.type):
        for k, value in enumerate(column):
            own = np.frombuffer(value.as_buffer(), dtype=np.int64)
            out[k, : len(own)] = own
        return out
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    row = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(rows: DataFrame, width: int) -> DataFrame:
    def per_batch(batch):
        x = _matrix(batch.column("x"), width)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        held = [own.tobytes() for own in x]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(held, pa.binary()), pa.array(norm)], names=["vec_id", "x", "norm"])

    return arrow_map(rows, PLACED, per_batch)


def search(queries, q_norms, candidates, c_norms, ids, own, rotation, head, k, floor):
    """Best candidates of each query: lists of (score, id), pruned as the module says.

    ``candidates`` come in descending length; ``floor``: a score of the k-th best known already,
    minus infinity without one. Returns rows (query, id, score) that hold each query's k best
    here and may hold less where they stay below its floor.
    """
    q_turned, c_turned = queries @ rotation, candidates @ rotation
    q_rest = np.sqrt(np.maximum((q_turned[:, head:] ** 2).sum(axis=1), 0))
    c_rest = np.sqrt(np.maximum((c_turned[:, head:] ** 2).sum(axis=1), 0))
    floor = floor.astype(np.float64).copy()
    best: list[list[tuple[int, int]]] = [[] for _ in range(len(queries))]
    for a in range(0, len(candidates), STRIP):
        b = min(a + STRIP, len(candidates))
        # rounding of the float sums is far below this
        slack = 1e-6 * (1 + q_norms * c_norms[a])
        alive = np.flatnonzero(q_norms * c_norms[a] + slack >= floor)
        if len(alive) == 0:
            break
        bound = q_turned[alive, :head] @ c_turned[a:b, :head].T + np.outer(q_rest[alive], c_rest[a:b])
        reach = bound + slack[alive, None] >= floor[alive, None]
        for row in np.flatnonzero(reach.any(axis=1)):
            q = alive[row]
            hit = a + np.flatnonzero(reach[row])
            hit = hit[ids[hit] != own[q]]
            scores = candidates[hit] @ queries[q]
            best[q] += zip((-scores).tolist(), ids[hit].tolist())
            best[q].sort()
            del best[q][k:]
            if len(best[q]) == k:
                floor[q] = max(floor[q], -best[q][-1][0])
    return [(int(own[q]), i, -s) for q in range(len(queries)) for s, i in best[q]]


def _met(queries: DataFrame, candidates: DataFrame, pairs: DataFrame, rotation, head: int, width: int, k: int) -> DataFrame:
    """Every pair (part, block) in a task of its own."""

    def per_pair(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            order = np.lexsort((right.column("vec_id").to_numpy(), -right.column("norm").to_numpy()))
            rows = search(
                _matrix(left.column("x"), width),
                left.column("norm").to_numpy(),
                _matrix(right.column("x"), width)[order],
                right.column("norm").to_numpy()[order],
                right.column("vec_id").to_numpy()[order],
                left.column("vec_id").to_numpy(),
                rotation,
                head,
                k,
                left.column("floor").to_numpy(),
            )
        parts = zip(*rows) if rows else ((), (), ())
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), parts)})

    left = queries.join(pairs, "part").groupBy("part", "block")
    right = candidates.join(pairs, "block").groupBy("part", "block")
    return left.cogroup(right).applyInArrow(per_pair, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the k best candidates of every
    row that ``is_query`` (a condition on ``vec_id``) chooses; candidates are all rows but it."""
    spark = vectors.sparkSession
    ship(spark)
    once = materialise(_prepared(vectors), "vectors")
    count, width = once.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    width = max(width, 1)
    values, turn = np.linalg.eigh(_gram(once, width))
    rotation = turn[:, ::-1].copy()
    share = np.cumsum(values[::-1]) / max(values.sum(), 1e-300)
    head = int(np.clip(np.searchsorted(share, ENERGY) + 1, 1, width))

    size = max(BLOCK, -(-count // MOST_BLOCKS))
    packed = _packed(once, width)
    ordered = packed.repartitionByRange(max(1, -(-count // size)), F.col("norm").desc(), "vec_id")
    ordered = materialise(ordered.withColumn("block", F.spark_partition_id()), "vector-blocks")
    # at most MOST_BLOCKS rows or so
    longest = ordered.groupBy("block").agg(F.max("norm").alias("norm")).toArrow().sort_by("block")
    blocks, norms = longest.column("block").to_numpy(), longest.column("norm").to_numpy()
    chosen = ordered.filter(is_query).select("vec_id", "x", "norm")
    parts = max(1, -(-chosen.count() // QUERIES))
    queries = chosen.repartitionByRange(parts, F.col("norm").desc(), "vec_id").withColumn("part", F.spark_partition_id())
    queries = materialise(queries, "queries")

    lead = int(blocks[0]) if len(blocks) else 0
    start = queries.select("part", F.lit(lead).alias("block")).distinct()
    start = materialise(start, "pairs")
    first = _met(queries.withColumn("floor", F.lit(float("-inf"))), ordered, start, rotation, head, width, k)
    first = materialise(first, "first-scores")
    known = top_ranked(first, "query_id", [F.col("score").desc(), F.col("vec_id")], k)
    known = known.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(float("-inf")).alias("floor"))
    queries = queries.join(known.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    queries = materialise(queries.withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "query-floors")
    # the length a candidate needs to reach any query of the part; lengths are rounded
    need = F.when(F.col("norm") > 0, F.col("floor") / F.col("norm")).otherwise(float("-inf"))
    needs = queries.groupBy("part").agg(F.min(need).alias("need"))
    needs = needs.withColumns({"norms": F.lit(norms[1:].tolist()), "blocks": F.lit(blocks[1:].tolist())})
    reached = F.filter(F.arrays_zip("norms", "blocks"), lambda z: z["norms"] * 1.000001 + 1e-6 >= F.col("need"))
    pairs = materialise(needs.select("part", F.explode(reached).alias("z")).select("part", F.col("z.blocks").alias("block")), "pairs")
    rest = _met(queries, ordered, pairs, rotation, head, width, k)
    ranked = top_ranked(first.unionByName(rest), "query_id", [F.col("score").desc(), F.col("vec_id")], k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: The rows of ``op1`` in DuckDB.
SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
