"""Outputs. Each run writes to paths of its own; nothing is overwritten in place."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import spreadsheet_text
from ..sources.headers import quoted


def blank_null(df: DataFrame, name: str) -> Column:
    """Blank in place of NULL text, as list files have it."""
    column = quoted(name)
    is_text = isinstance(df.schema[name].dataType, T.StringType)
    return F.coalesce(column, F.lit("")).alias(name) if is_text else column


def write_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), spreadsheet_ucc: bool = False, **options) -> None:
    """CSV with a header (K1); ``spreadsheet_ucc`` protects long codes from spreadsheets (K9).
    Further options are those of Spark's writer."""
    ucc = next((name for name in df.columns if name.lower() == "ucc"), None)
    if spreadsheet_ucc and ucc:
        df = df.withColumn(ucc, spreadsheet_text(quoted(ucc)))
    df = df.select(*[quoted(n) if n in partition_by else blank_null(df, n) for n in df.columns])
    df.write.options(header=True, escape='"', emptyValue="", **options).partitionBy(*partition_by).csv(path)


def write_rejects(tagged: DataFrame, path: str) -> None:
    """One folder per step (K2, K3)."""
    rejects = tagged.filter(F.col("reject_step").isNotNull())
    rejects.write.partitionBy("reject_step").parquet(path)


def run_name(manufacturer: str, month: str, year: str) -> str:
    return f"{manufacturer.strip().lower().replace(' ', '_')}_{month.strip()}_{year.strip()}"


def write_counts(counts: DataFrame, path: str) -> None:
    """The two-column run summary (K8)."""
    write_csv(counts.select(F.col("metric").alias("Metric"), F.col("n_rows").alias("Count")).coalesce(1), path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A short report as one text file (K7)."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def write_master_version(master: DataFrame, folder: str, stamp: str | None = None) -> str:
    """An updated master goes to a new folder; earlier versions stay as they are."""
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    path = f"{folder}/version={stamp}"
    master.write.parquet(path)
    return path
