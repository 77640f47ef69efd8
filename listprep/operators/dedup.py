"""Duplicates inside the file and against earlier files.

The survivor of every key is found by an aggregate over ids and keys only, which reduces a
frequent key before the shuffle. Whole rows meet that result by their unique ``row_id``, so no
task ever receives all the rows of one address or VIN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import ADDRESS_KEYS, address_keys
from .lookup import first_per_key

# Fixed values.
DUPLICATE_ADDRESS = "Filter_Duplicate_Address"
DUPLICATE_VIN = "Duplicate VIN in file"
DUPLICATE_RECORD = "Duplicate record"
PENDING = "PENDING"
PENDING_DESCRIPTION = "PENDING DESCRIPTION"

KEYS = list(ADDRESS_KEYS)
#: Size of the filter that the run's VINs put on exclusion lists: 16 MB at most.
FILTER_BITS = 1 << 27


def survivors(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """One ``row_id`` per key: the row that comes first in ``order``."""
    columns = list(dict.fromkeys([*order, row_id]))
    if columns == [row_id]:
        first = F.min(row_id)
    else:
        first = F.min(F.struct(*columns))[row_id]
    return df.groupBy(*keys).agg(first.alias(row_id)).select(row_id)


def lone_blank_key(blank_is_duplicate: bool) -> Column:
    """Extra grouping key that sets every all-blank address apart from the others."""
    blank = F.lit(True)
    for key in KEYS:
        blank = blank & (F.col(key) == "")
    apart = F.lit(False) if blank_is_duplicate else blank
    return F.when(apart, F.col("row_id")).alias("_alone")


def address_survivors(df: DataFrame, blank_is_duplicate: bool = True) -> DataFrame:
    """``row_id`` of the first row of every address."""
    keyed = df.select("row_id", *[expr.alias(key) for key, expr in address_keys().items()])
    return survivors(keyed, [*KEYS, lone_blank_key(blank_is_duplicate)], ["row_id"])


def split_duplicate_addresses(df: DataFrame, blank_is_duplicate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows kept, and their duplicates with ``drop_reason``; both carry the address keys."""
    first = address_survivors(df, blank_is_duplicate)
    keyed = df.withColumns(address_keys())
    dropped = keyed.join(first, "row_id", "left_anti")
    return keyed.join(first, "row_id", "left_semi"), dropped.withColumn("drop_reason", F.lit(DUPLICATE_ADDRESS))


def key_bits(df: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """Which of ``bits`` hash values the keys have, as a bitmap of fixed size: a row per 32768 of them."""
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    marked = df.filter(F.col(key).isNotNull()).select(
        F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit")
    )
    return marked.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))


def with_bits(df: DataFrame, key: str, found: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key has a marked hash value: all that ``found`` was made of, and few others.

    The bitmap has at most ``bits / 8`` bytes, whatever the tables, and is broadcast.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    marked = df.withColumns({"_bucket": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)})
    byte = F.conv(F.hex(F.substring("_bitmap", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
    return marked.join(F.broadcast(found), "_bucket").filter(hit).drop("_bucket", "_bit", "_bitmap")


def exclusion_hits(vins: DataFrame, listed: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(vin, sources) of the VINs that are on a list, with the sorted names of all lists they are on.

    ``listed`` has ``vin`` and ``source``. The lists may be larger than the run by any factor:
    rows of VINs that the run does not have are left out in the scan of the lists.
    """
    near = with_bits(listed, "vin", key_bits(vins, "vin", bits), bits)
    sources = near.groupBy("vin").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    return sources.join(vins.select("vin").distinct(), "vin", "left_semi")


def vin_survivors(
    df: DataFrame, exclusions: DataFrame | None, order: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """The first row of every VIN: its order, ``row_id``, ``carry`` and ``excluded``.

    The exclusions are joined after the reduction, when each VIN is there once and the table is
    already partitioned by it; only those that the run may have are shuffled.
    """
    first = df.groupBy("vin").agg(F.min(F.struct(*order, "row_id", *carry)).alias("_first"))
    if exclusions is None:
        listed = first.withColumn("excluded", F.lit(False))
    else:
        near = with_bits(exclusions.select("vin"), "vin", key_bits(df, "vin")).distinct()
        marks = near.withColumn("_listed", F.lit(True))
        listed = first.join(marks, "vin", "left").withColumn("excluded", F.coalesce("_listed", F.lit(False)))
    return listed.select("_first.*", "excluded")


def mark_duplicate_vins(df: DataFrame, exclusions: DataFrame | None, order: Sequence[str]) -> DataFrame:
    """``dedup_reason`` per row, NULL for the rows kept."""
    first = vin_survivors(df, exclusions, order).select("row_id", "excluded")
    reason = F.when(F.col("excluded").isNull(), DUPLICATE_VIN).when(F.col("excluded"), DUPLICATE_RECORD)
    return df.join(first, "row_id", "left").withColumn("dedup_reason", reason).drop("excluded")


def duplicate_address_groups(df: DataFrame, columns: Sequence[str] = (*ADDRESS_KEYS.values(), "zip_code")) -> DataFrame:
    """Addresses written the same way more than once, with their row counts (A3)."""
    whole = df.dropna("any", subset=list(columns))
    return whole.groupBy(*columns).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def upsert_master(master: DataFrame, missing: DataFrame) -> DataFrame:
    """UCC master with a pending row per missing (cell, modyy); later rows win."""
    columns = ["cell", "modyy", "ucc", "description"]
    pending = missing.select(
        "cell",
        "modyy",
        F.lit(PENDING).alias("ucc"),
        F.lit(PENDING_DESCRIPTION).alias("description"),
        F.lit(1).alias("wave"),
        F.lit(0).cast("bigint").alias("ord"),
    ).distinct()
    rows = master.select(*columns, F.lit(0).alias("wave"), "ord").unionByName(pending)
    return first_per_key(rows, ["cell", "modyy"], ["wave", "ord"], descending=True).select(*columns)
