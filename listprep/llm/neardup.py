"""MinHash near-duplicates by an inverted join of signature coordinates.

A document's signature has ``coordinates`` MinHash values of its word shingles. Documents with
equal shingle sets are one class, stood for by the smallest id. Each class is posted under the
values of its coordinates; values no other class has are dropped. A pair above the similarity
agrees on at least ``matches`` coordinates (but for a chance of ``MISS``), so that

* a class with fewer than ``matches`` shared values is skipped altogether;
* of the others only the rarest values, all but ``matches - 1``, are posted as prefix: two
  classes that agree on ``matches`` values in all have one of the prefix in common;
* what a common prefix value brings together is counted over the whole signature, and pairs
  of too few agreeing coordinates are left out;
* the rest is confirmed on the full shingle sets, exactly.

Lists of up to ``LIST`` classes give their pairs. Longer ones are dealt out in blocks: every
two blocks of a list meet in a task, which holds two blocks at most, walks through the links
from one class to the next and returns a spanning forest of them, so that the links are not
enumerated and yet none is lost between different components. Components of all confirmed
links are found by joins (``components``).

Words are as in ``words``. Null and empty texts, and texts without words, have no shingles and
no links. A row without ``doc_id`` has no links and is its own component. Rows that repeat a
``doc_id`` are documents of their own under one id: each has the links of its text. A table without
rows gives none; columns beside ``doc_id`` and ``text`` are not looked at, whatever their names. Texts
come in slices of a few MB, a longer one by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import fits_broadcast
from ..storage import materialise
from . import words
from .components import components
from .tables import arrow_map, free_names, ship

COORDINATES = 10
MISS = 1e-5
LIST = 32
BLOCK = 512

SIGNED = "doc_id long, copy long, n_shingles long, set_a long, set_b long, signature array<long>"


def matches_needed(similarity: float, coordinates: int, miss: float = MISS) -> int:
    """The most coordinates that two sets of that similarity agree on with a chance of failure
    of at most ``miss``; one at least."""
    below, m = 0.0, 0
    while m < coordinates:
        below += comb(coordinates, m) * similarity**m * (1 - similarity) ** (coordinates - m)
        if below > miss:
            break
        m += 1
    return max(m, 1)


def _signed(documents: DataFrame, size: int, coordinates: int) -> DataFrame:
    def per_batch(batch):
        texts, ids = batch.column("text"), batch.column("doc_id")
        for i, j in words.slices(texts):
            runs, first = words.shingles(words.words_of(texts.slice(i, j - i)), size)
            signature = words.minhash(runs, first, coordinates)
            counts = np.zeros(j - i, dtype=np.int64)
            keys = np.zeros((j - i, 2), dtype=np.int64)
            for k, own in enumerate(words.distinct_runs(runs, first)):
                counts[k] = len(own)
                keys[k] = np.frombuffer(words.set_hash(own), dtype=np.int64)
            flat = pa.array(signature.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(i, j - i),
                    batch.column("copy").slice(i, j - i),
                    pa.array(counts),
                    pa.array(np.ascontiguousarray(keys[:, 0])),
                    pa.array(np.ascontiguousarray(keys[:, 1])),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * coordinates, coordinates, dtype=np.int32)), flat),
                ],
                names=["doc_id", "copy", "n_shingles", "set_a", "set_b", "signature"],
            )

    return arrow_map(_rows(documents).select("doc_id", _copy(), "text"), SIGNED, per_batch)


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _copy() -> Column:
    return F.xxhash64("text").alias("copy")


def _sets(documents: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """``node`` and its sorted distinct shingles, for classes with ``node``, ``first_id``, ``set_a``
    and ``set_b``: of the texts under the id, the one with that set."""

    def per_batch(batch):
        texts, keys = batch.column("text"), batch.column("node").to_pylist()
        wanted = np.stack([batch.column(name).to_numpy() for name in ("set_a", "set_b")], axis=1)
        for i, j in words.slices(texts):
            runs, first = words.shingles(words.words_of(texts.slice(i, j - i)), size)
            nodes, sets = [], []
            for k, own in enumerate(words.distinct_runs(runs, first), i):
                if len(own) and (np.frombuffer(words.set_hash(own), dtype=np.int64) == wanted[k]).all():
                    nodes.append(keys[k])
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    rows = _rows(documents).join(classes.select("node", F.col("first_id").alias("doc_id"), "set_a", "set_b"), "doc_id")
    return arrow_map(rows.select("node", "set_a", "set_b", "text"), "node long, shingles binary", per_batch)


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough."""

    def per_batch(batch):
        us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
        keep = []
        for n, (a, b) in enumerate(zip(batch.column("set_u"), batch.column("set_v"))):
            a = np.frombuffer(a.as_buffer(), dtype=np.uint64)
            b = np.frombuffer(b.as_buffer(), dtype=np.uint64)
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if linked(shared, len(a), len(b), percent):
                    keep.append(n)
        if keep:
            yield pa.RecordBatch.from_arrays(
                [pa.array([us[n] for n in keep], pa.int64()), pa.array([vs[n] for n in keep], pa.int64())], names=["u", "v"]
            )

    return arrow_map(pairs.select("u", "v", "set_u", "set_v"), "u long, v long", per_batch)


def forest(nodes: np.ndarray, side: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray], matches: int, percent: int):
    """A spanning forest of the links between nodes of side 0 and side 1, or of all if there is one side.

    From each node the walk goes to every node not yet reached that it links with, so that a
    group of copies is reached at once and what is left gets ever smaller.
    """
    two = bool(side.any()) and not bool(side.all())
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    flags = np.zeros(codes.max() + 1 if len(codes) else 1, dtype=np.int32)
    free = np.ones(len(nodes), dtype=bool)
    edges = []
    for root in range(len(nodes)):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            near = np.flatnonzero(free & (side != side[x]) if two else free)
            if len(near) == 0:
                continue
            near = near[(signatures[near] == signatures[x]).sum(axis=1) >= matches]
            ratio = 100 * np.minimum(sizes[near], sizes[x]) >= percent * np.maximum(sizes[near], sizes[x])
            near = near[ratio]
            if len(near) == 0:
                continue
            own = codes[first[x] : first[x + 1]]
            flags[own] = 1
            index = np.concatenate([np.arange(first[y], first[y + 1]) for y in near])
            starts = np.concatenate([[0], np.cumsum(sizes[near])[:-1]])
            shared = np.add.reduceat(flags[codes[index]], starts)
            flags[own] = 0
            for y in near[100 * shared >= percent * (sizes[near] + sizes[x] - shared)].tolist():
                edges.append((nodes[x], nodes[y]))
                free[y] = False
                queue.append(y)
    return edges


def _long_lists(lists: DataFrame, facts: DataFrame, matches: int, percent: int) -> DataFrame:
    """Spanning links of lists in blocks; ``lists``: value, node, n (length of the list)."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int")
    rows = lists.select("value", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("value", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))
    rows = rows.join(facts, "node")

    def per_group(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        side = table.column("second").to_numpy().astype(np.int8)
        signatures = np.array(table.column("signature").to_pylist(), dtype=np.int64)
        sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for chunk in table.column("shingles").chunks for s in chunk]
        # two different blocks have links of their own in the tasks of (i, i) and (j, j)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        if i != j and (not side.any() or side.all()):
            edges = []
        else:
            edges = forest(nodes, side, signatures, sets, matches, percent)
        us, vs = zip(*edges) if edges else ((), ())
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return rows.groupBy("value", "i", "j").applyInArrow(per_group, "u long, v long")


def links(
    lists: DataFrame, facts: DataFrame, sets_of: Callable[[DataFrame], DataFrame], matches: int, percent: int
) -> DataFrame:
    """Confirmed links ``u``, ``v`` that connect whatever all links of nodes with a list in common connect.

    ``lists``: value, node and n (nodes of that value); ``facts``: node, size and signature;
    ``sets_of`` gives node and shingles for a table of nodes.
    """
    short, long = lists.filter(F.col("n") <= LIST), lists.filter(F.col("n") > LIST)
    left, right = short.select("value", F.col("node").alias("u")), short.select("value", F.col("node").alias("v"))
    pairs = left.join(right, "value").filter("u < v").select("u", "v").distinct()
    for end in ("u", "v"):
        own = facts.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("signature").alias(f"signature_{end}"))
        pairs = pairs.join(own, end)
    agree = F.zip_with("signature_u", "signature_v", lambda x, y: (x == y).cast("int"))
    enough = F.aggregate(agree, F.lit(0), lambda total, x: total + x) >= matches
    alike = 100 * F.least("size_u", "size_v") >= percent * F.greatest("size_u", "size_v")
    pairs = materialise(pairs.filter(enough & alike).select("u", "v"), "pairs")

    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(long.select("node")).distinct()
    sets = materialise(sets_of(wanted).dropDuplicates(["node"]), "sets")
    candidates = pairs
    for end in ("u", "v"):
        candidates = candidates.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}")), end)
    edges = _confirmed(candidates, percent)
    full = facts.join(sets, "node").select("node", "signature", "shingles")
    return edges.unionByName(_long_lists(long, full, matches, percent))


def near_duplicates(
    documents: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = COORDINATES, miss: float = MISS
) -> DataFrame:
    """Per row of ``documents``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Sets of ``shingle``-word shingles are linked when 100 times their intersection is at least
    ``percent`` times their union; ``component_id`` is the smallest id reachable.
    """
    return _with_copies(documents, shingle, percent, coordinates, miss).drop("copy")


def _with_copies(documents: DataFrame, shingle: int, percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> DataFrame:
    """``near_duplicates`` with ``copy``, a hash of the text, which tells rows of one id apart."""
    spark = documents.sparkSession
    ship(spark)
    matches = matches_needed(percent / 100, coordinates, miss)
    signed = materialise(_signed(documents, shingle, coordinates), "signed")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    # equal sets have equal signatures; written, so that the join on a set that many documents have can be split
    classes = full.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature")
    )
    classes = _with_nodes(materialise(classes, "sets-once"))
    facts = classes.select("node", "size", "signature")

    postings = facts.select("node", F.posexplode("signature").alias("coordinate", "hash"))
    postings = postings.select("node", F.xxhash64("coordinate", "hash").alias("value"))
    common = postings.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    shared = postings.join(common, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("held"))
    prefix = F.slice("held", 1, F.size("held") - (matches - 1))
    posted = shared.filter(F.size("held") >= matches).select("node", F.explode(prefix.getField("value")).alias("value"))
    posted = materialise(posted, "posted")
    lengths = posted.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    lists = materialise(posted.join(lengths, "value"), "lists")
    edges = links(lists, facts, lambda wanted: _sets(documents, classes.join(wanted, "node", "left_semi"), shingle), matches, percent)
    found = components(materialise(edges, "links"))

    named = classes.select("set_a", "set_b", "node", "first_id").join(found, "node", "left")
    named = _named(named, classes.filter("node <> first_id").select("node", "first_id"), found)
    named = full.select("doc_id", "copy", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"]).drop("set_a", "set_b")
    alone = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "copy", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _with_nodes(classes: DataFrame) -> DataFrame:
    """``node``, one for every class: its smallest id, or a hash where that id has other texts as
    well and is the smallest of another class, too."""
    clashing = classes.groupBy("first_id").agg(F.count("*").alias("n")).filter("n > 1").select("first_id", F.lit(True).alias("clash"))
    own = F.when(F.col("clash"), F.xxhash64("first_id", "set_a", "set_b")).otherwise(F.col("first_id"))
    return materialise(classes.join(clashing, "first_id", "left").withColumn("node", own).drop("clash"), "classes")


def _named(named: DataFrame, hashed: DataFrame, found: DataFrame) -> DataFrame:
    """``set_a``, ``set_b`` and the smallest id of the component. That is the component itself but
    for those with a node that is a hash, which are looked through."""
    smallest = F.coalesce("component", "first_id")
    if hashed.isEmpty():
        return named.select("set_a", "set_b", smallest.alias("component_id"))
    members = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    touched = members.join(hashed, "node", "left_semi").select("component").distinct()
    members = members.join(touched, "component", "left_semi").join(hashed.withColumnRenamed("first_id", "own"), "node", "left")
    least = materialise(members.groupBy("component").agg(F.min(F.coalesce("own", "node")).alias("least")), "least")
    least = F.broadcast(least) if fits_broadcast(least) else least
    rows = named.withColumn("label", F.coalesce("component", "node")).join(least.withColumnRenamed("component", "label"), "label", "left")
    return rows.select("set_a", "set_b", F.coalesce("least", smallest).alias("component_id"))


def dedup(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` that are the smallest of their component. Rows that agree in
    ``doc_id`` and text stay once; rows without ``doc_id`` all stay."""
    kept = _with_copies(documents, shingle, percent).filter("kept and doc_id is not null").select("doc_id", "copy").distinct()
    of_id, of_copy, version, again = free_names(documents, "_of_id", "_of_copy", "_version", "_again")
    kept = kept.select(F.col("doc_id").alias(of_id), F.col("copy").alias(of_copy))
    rows = documents.withColumn(version, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = (F.col("doc_id").cast("long") == F.col(of_id)) & (F.col(version) == F.col(of_copy))
    rows = rows.join(kept, same, "left_semi")
    number = F.row_number().over(Window.partitionBy("doc_id", version).orderBy("doc_id"))
    once = rows.withColumn(again, number).filter(F.col(again) == 1).drop(again, version)
    return once.unionByName(documents.filter("doc_id is null"))
