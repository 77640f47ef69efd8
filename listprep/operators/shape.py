"""Columns derived at ingest: name, address, phone, model code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, is_blank, join_words
from ..sources.headers import add_missing

# Where each manufacturer's files keep the parts of the street address.
ADDRESS_PARTS = {
    "house": ("address_house_no", "address_line1", "address_house_no2"),
    "split": ("address_1", "address_2"),
    "two_line": ("address_line1", "address_line2"),
    "as_is": (),
}
ADDRESS_LAYOUT = {
    "jlr": "house",
    "bmw": "split",
    "mini": "split",
    "nissan": "two_line",
    "infiniti": "two_line",
    "mercedes": "two_line",
    "honda": "as_is",
    "acura": "as_is",
    "volvo": "as_is",
}
PHONE_COLUMNS = ("mobile_phone", "home_phone", "work_phone")
NAME_PARTS = ("first_name", "last_name", "name_prefix", "middle_name", "name_suffix")


def consolidate_address(df: DataFrame, layout: str) -> DataFrame:
    """``address_line1`` from the parts of the layout.

    Applied once; absent parts count as blank. The two-line layout needs both of its columns.
    """
    parts = ADDRESS_PARTS[layout]
    present = [name for name in parts if name in df.columns]
    if not present or (layout == "two_line" and len(present) < len(parts)):
        return df
    return df.withColumn("address_line1", join_words(*map(F.col, present)))


def fill_phone(df: DataFrame) -> DataFrame:
    """First phone number that is not blank."""
    present = [blank_to_null(F.col(name)) for name in PHONE_COLUMNS if name in df.columns]
    return df.withColumn("phone", F.coalesce(*present, F.lit(None).cast("string")))


def fill_extra(df: DataFrame) -> DataFrame:
    """``extra1`` from ``pid_id`` where it has no value."""
    if "pid_id" not in df.columns:
        return df
    df = add_missing(df, ["extra1"])
    return df.withColumn("extra1", F.coalesce("extra1", "pid_id")).drop("pid_id")


def build_name(df: DataFrame, per_row: bool = False) -> DataFrame:
    """``name`` from its parts when the table has none.

    Names are built only if no row has one, which takes a look at the data when the column
    exists; ``per_row`` builds them wherever they are blank instead.
    """
    if {"first_name", "last_name"} <= set(df.columns):
        parts = ["first_name", "last_name"]
    else:
        parts = [name for name in NAME_PARTS if name in df.columns]
    built = join_words(*map(F.col, parts)) if parts else F.lit("")
    if "name" not in df.columns:
        return df.withColumn("name", built)
    if per_row:
        return df.withColumn("name", F.coalesce(blank_to_null(F.col("name")), built))
    if df.filter(~is_blank(F.col("name"))).isEmpty():
        return df.withColumn("name", built)
    return df


def fill_model_code(df: DataFrame) -> DataFrame:
    """``modelid`` and ``bodycode`` stand in for each other when one is absent."""
    if "modelid" not in df.columns and "modelcode" in df.columns:
        df = df.withColumnRenamed("modelcode", "modelid")
    if "modelid" not in df.columns and "bodycode" in df.columns:
        return df.withColumn("modelid", F.col("bodycode"))
    if "bodycode" not in df.columns and "modelid" in df.columns:
        return df.withColumn("bodycode", F.col("modelid"))
    return add_missing(df, ["modelid", "bodycode"])
