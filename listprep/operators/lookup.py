"""Left joins to reference tables of any size, and first-row-per-key reduction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise

BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows that one task can have of one key without harm.
LEAST_HOT = 100_000


def table_bytes(df: DataFrame) -> int:
    """Size of the values in ``df``, measured by one aggregate."""
    wide = (T.StringType, T.BinaryType)
    fixed = sum(8 for f in df.schema.fields if not isinstance(f.dataType, wide))
    text = [
        F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        for f in df.schema.fields
        if isinstance(f.dataType, wide)
    ]
    per_row = reduce(Column.__add__, text, F.lit(fixed))
    return df.agg(F.sum(per_row.cast("bigint")).alias("bytes")).first()["bytes"] or 0


def fits_broadcast(reference: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the table, and so anything reduced from it, is small enough to broadcast."""
    return table_bytes(reference) <= limit


def lookup(
    df: DataFrame,
    reference: DataFrame,
    on: Sequence[str],
    broadcast: bool,
    spread_by: str = "row_id",
    keys: DataFrame | None = None,
    least_hot: int = LEAST_HOT,
) -> DataFrame:
    """Left join to ``reference``, which has one row per key.

    ``broadcast`` is the outcome of ``fits_broadcast``: a small reference is broadcast, so
    ``df`` is not shuffled. A larger one is joined by a shuffle on the key. Keys that hold more
    rows than a task should get are found by a count first; the rows of each are dealt over as
    many tasks as its share asks for, by the hash of ``spread_by``, and only the reference rows
    of these keys are repeated. ``keys`` is a frame with the keys of ``df`` that is cheaper to count.
    """
    on = list(on)
    if broadcast:
        return df.join(F.broadcast(reference), on, "left")
    # a sort-merge join spills, whatever the planner believes about the size
    hot = hot_keys(df if keys is None else keys, on, least_hot)
    if hot is None:
        return df.join(reference.hint("merge"), on, "left")
    dealt = _met(df, hot, on).withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_salts")), F.lit(0)).cast("int"))
    salts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)).cast("int") - 1)
    salted = _met(reference, hot, on).withColumn("_salt", F.explode(salts)).drop("_salts")
    return dealt.drop("_salts").join(salted.hint("merge"), [*on, "_salt"], "left").drop("_salt")


def hot_keys(df: DataFrame, on: Sequence[str], least: int = LEAST_HOT) -> DataFrame | None:
    """The keys with more rows than the mean task of a shuffle, and than ``least``: ``_hot_`` columns
    and ``_salts``, how many tasks' worth they have. None when there is no such key.

    There are fewer of them than tasks, whatever the table. NULL keys, which match nothing but
    would meet in one task, are one key here.
    """
    counts = materialise(df.groupBy(*on).agg(F.count("*").alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(total / tasks, least)
    hot = counts.filter(F.col("_n") > share)
    if hot.isEmpty():
        return None
    return hot.select(*[F.col(name).alias(f"_hot_{name}") for name in on], F.ceil(F.col("_n") / share).alias("_salts"))


def _met(df: DataFrame, hot: DataFrame, on: Sequence[str]) -> DataFrame:
    same = [df[name].eqNullSafe(hot[f"_hot_{name}"]) for name in on]
    return df.join(F.broadcast(hot), same, "left").drop(*[f"_hot_{name}" for name in on])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], descending: bool = False) -> DataFrame:
    """One whole row per key, the first (or last) in ``order``.

    It is an aggregate, not a window: rows of one key are reduced before the shuffle, so a key
    that holds much of the table costs no more than any other.
    """
    rest = [name for name in df.columns if name not in keys]
    pick = F.max_by if descending else F.min_by
    row = pick(F.struct(*[f"`{n}`" for n in rest]), F.struct(*[f"`{n}`" for n in order]))
    picked = df.groupBy(*keys).agg(row.alias("_row"))
    return picked.select(*[F.col(n) if n in keys else F.col(f"_row.`{n}`") for n in df.columns])
