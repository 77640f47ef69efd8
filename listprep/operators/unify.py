"""Decoded VIN tables of several sources as one record per VIN."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vin import clean_vin, is_vin, model_year, vin_segments
from .enrich import apply_vin_rules
from .lookup import first_per_key

FIELDS = ("make", "model", "model_year")


def prepare_vins(df: DataFrame, vin: str = "vin") -> DataFrame:
    """Distinct valid VINs of an input list (M1)."""
    cleaned = df.select(clean_vin(F.col(vin)).alias("vin"))
    return cleaned.filter(is_vin(F.col("vin"))).distinct()


def vin_problems(df: DataFrame, vin: str = "vin") -> DataFrame:
    """Every input VIN that cannot be decoded, with the reason (M6)."""
    cleaned = clean_vin(F.col(vin))
    reason = (
        F.when(cleaned.isNull() | (cleaned == ""), "Blank VIN")
        .when(~is_vin(cleaned), "Invalid VIN")
        .when(model_year(F.substring(cleaned, 10, 1)).isNull(), "Unknown year code")
    )
    return df.select("row_id", F.col(vin).alias("vin"), reason.alias("reason")).filter("reason IS NOT NULL")


def decode_vins(vins: DataFrame, rules: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Structured fields of every VIN from the segment rules (M2)."""
    rows = vins.withColumns(vin_segments(F.col("vin"))).withColumns(
        {"bodycode": F.lit(""), "model_year": model_year(F.col("vin10")), "row_id": F.xxhash64("vin")}
    )
    decoded = apply_vin_rules(rows, rules, broadcast=broadcast)
    return decoded.select("vin", F.col("brand").alias("make"), F.col("desc").alias("model"), "model_year", "cell")


def merge_main_secondary(main: DataFrame, secondary: DataFrame, key: str = "vin", order: str = "row_id") -> DataFrame:
    """One row per VIN, from the main output where it has one (M3)."""
    both = main.withColumn("_wave", F.lit(0)).unionByName(secondary.withColumn("_wave", F.lit(1)))
    return first_per_key(both, [key], ["_wave", order]).drop("_wave")


def standard_source(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """A source with its columns renamed to ``vin`` and the decoded fields."""
    return df.select(*[F.col(f"`{source}`").alias(target) for source, target in names.items()])


def by_source(sources: Mapping[str, DataFrame], fields: Sequence[str] = FIELDS, order: str = "row_id") -> DataFrame:
    """One row per VIN with every source's fields side by side: ``{source}_{field}``.

    One aggregate over the union of the sources: each source's first row per VIN counts, and
    repeated rows are reduced before the one shuffle.
    """
    tagged = [
        df.select("vin", order, *fields, F.lit(name).alias("_source")) for name, df in sources.items()
    ]
    union = reduce(DataFrame.unionByName, tagged).dropna("any", subset=["vin"])
    row = F.struct(*fields)
    picked = union.groupBy("vin").agg(
        *[
            F.min_by(row, F.when(F.col("_source") == name, F.col(order))).alias(name)
            for name in sources
        ]
    )
    return picked.select(
        "vin", *[F.col(f"{name}.{field}").alias(f"{name}_{field}") for name in sources for field in fields]
    )


def unify_sources(sources: Mapping[str, DataFrame], fields: Sequence[str] = FIELDS, order: str = "row_id") -> DataFrame:
    """One record per VIN; each field from the first source that has it."""
    wide = by_source(sources, fields, order)
    return wide.select(
        "vin", *[F.coalesce(*[f"{name}_{field}" for name in sources]).alias(field) for field in fields]
    )


def source_conflicts(sources: Mapping[str, DataFrame], fields: Sequence[str] = FIELDS, order: str = "row_id") -> DataFrame:
    """(vin, field, n_values, then each source's value) where sources disagree (M5)."""
    wide = by_source(sources, fields, order)

    def line(field: str):
        values = F.array(*[F.col(f"{name}_{field}").cast("string") for name in sources])
        return F.struct(
            F.lit(field).alias("field"),
            F.size(F.array_distinct(F.array_compact(values))).alias("n_values"),
            *[F.col(f"{name}_{field}").cast("string").alias(f"value_{name}") for name in sources],
        )

    lines = wide.select("vin", F.inline(F.array(*[line(field) for field in fields])))
    return lines.filter("n_values > 1")
