"""Contiguous numbers over a distributed sort order.

Rows are range-partitioned on the order and sorted inside each partition. Their place in the
partition is written to a table, so that both passes see the same partitions; the partition
sizes then give every partition its first number. No task sees more than its own range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .lookup import BROADCAST_BYTES, fits_broadcast

PANEL_SIZE = 4500
BATCH_SIZE = 1000
PLACE_BITS = 33
OFFSET_BYTES = 64


def _place() -> Column:
    """Place of the row in its partition, from 0."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _offsets(placed: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """Rows before each partition, per group: one row per partition and group in it."""
    sizes = placed.groupBy("_part", *group).agg(F.count("*").alias("_rows"), F.min(f"_{name}").alias("_start"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_start")
    return sizes.select("_part", *group, offset.alias("_offset"))


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    name: str = "seq8",
    start: int = 1,
    group: Sequence[str] = (),
    group_name: str = "panel_row",
    groups: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Number the rows ``start``, ``start`` + 1, ... in ``order``, which has to be unique.

    With ``group``, ``group_name`` numbers the rows of every group from 1 in the same order;
    ``groups`` is the most groups there can be, if that is known. The rows are shuffled as they
    are, so number narrow rows and join the numbers to wide ones.
    """
    spread = (partitions,) if partitions else ()
    placed = df.repartitionByRange(*spread, *order).sortWithinPartitions(*order)
    placed = placed.withColumns({"_part": F.spark_partition_id(), "_all": _place()})
    if group:
        placed = placed.sortWithinPartitions(*group, "_all").withColumn("_group", _place())
    placed = materialise(placed, "placed")
    # one row per partition
    offsets = F.broadcast(_offsets(placed, (), "all"))
    numbered = placed.join(offsets, "_part").withColumn(name, F.col("_all") + F.col("_offset") + F.lit(start))
    if group:
        offsets = _offsets(placed, group, "group")
        if groups is None:
            small = fits_broadcast(offsets)
        else:
            parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            small = parts * groups * OFFSET_BYTES <= BROADCAST_BYTES
        numbered = _number_in_groups(numbered.drop("_offset"), offsets, small, group, group_name)
    return numbered.drop("_part", "_all", "_group", "_offset")


def _number_in_groups(
    df: DataFrame, offsets: DataFrame, small: bool, group: Sequence[str], name: str
) -> DataFrame:
    """One offset per partition and per group that spans it; NULL is a group like any other."""
    for column in ("_part", *group):
        offsets = offsets.withColumnRenamed(column, f"_of_{column}")
    same = [F.col(column).eqNullSafe(F.col(f"_of_{column}")) for column in ("_part", *group)]
    joined = df.join(F.broadcast(offsets) if small else offsets, same)
    return joined.withColumn(name, F.col("_group") + F.col("_offset") + F.lit(1)).drop(
        *[f"_of_{column}" for column in ("_part", *group)]
    )


def chunk_of(row: Column, size: int = PANEL_SIZE) -> Column:
    """Chunk of the row with this number in its group, from 1."""
    return F.floor((row - 1) / F.lit(size)).cast("bigint") + 1


def chunk_count(rows: Column, size: int = PANEL_SIZE) -> Column:
    """Chunks needed for that many rows; none is left empty."""
    return F.ceil(rows / F.lit(size)).cast("bigint")


def vin_batches(df: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Distinct VINs in batches of equal size, for a decoder that takes lists."""
    numbered = number_rows(df.select("vin").dropna().distinct(), ["vin"], name="vin_row")
    return numbered.withColumn("batch", chunk_of(F.col("vin_row"), size))


def merge_batches(outputs: Sequence[DataFrame]) -> DataFrame:
    """Batch outputs as one table without repeated rows."""
    merged = outputs[0]
    for output in outputs[1:]:
        merged = merged.unionByName(output, allowMissingColumns=True)
    return merged.distinct()
