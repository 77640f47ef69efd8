"""Text-file scans. Every column is read as text."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank
from ..operators.lookup import fits_broadcast
from ..storage import materialise
from . import headers

DELIMITERS = (",", "\t", ";", "|")
LAYOUT_MARKER = "bapibus1006"
SPLIT_ROWS = 1 << 33
#: Column of a scan that has numbered its rows by file and line.
PLACE = "_place_in_input"


def scan_csv(
    spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", multi_line: bool = False
) -> DataFrame:
    """CSV with a header line (S1). With ``multi_line``, quoted fields may hold line breaks; each
    file is then read by one task."""
    return spark.read.options(header=True, sep=sep, encoding=encoding, escape='"', multiLine=multi_line).csv(path)


def scan_positional(
    spark: SparkSession,
    path: str,
    positions: Mapping[int, str],
    optional: Sequence[str] = (),
    sep: str = ",",
) -> DataFrame:
    """CSV without a header line; columns are named by position.

    There are as many columns as the widest line has fields, so that no field is lost.
    """
    lines = spark.read.text(path).select(decoded(F.col("value")).alias("line"))
    widest = lines.agg(F.max(unquoted_delimiters(F.col("line"), sep))).first()[0]
    places = [f"_c{place}" for place in range(max(widest or 0, *positions) + 1)]
    return name_positions(scan_lines(spark, path, sep, places).drop("bad_line"), positions, optional)


def name_positions(df: DataFrame, positions: Mapping[int, str], optional: Sequence[str] = ()) -> DataFrame:
    names = [positions.get(place, f"col{place}") for place in range(len(df.columns))]
    return headers.add_missing(df.toDF(*names), optional)


def choose_layout(names: Sequence[str], legacy: Mapping, current: Mapping, marker: str = LAYOUT_MARKER):
    """The legacy map when any header holds the marker, else the current one (S3)."""
    return legacy if any(marker in name.strip().lower() for name in names) else current


def file_system(spark: SparkSession, path: str):
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = make(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names anything; other errors than its absence rise."""
    system, place = file_system(spark, path)
    found = system.globStatus(place)
    return bool(found)


def check_paths(spark: SparkSession, paths: Mapping[str, str]) -> None:
    """Name every input that is not given or cannot be found, before any job starts."""
    absent = [role for role, path in paths.items() if not path or not is_there(spark, path)]
    if absent:
        raise ValueError(f"missing inputs: {', '.join(absent)}")


def check_output(spark: SparkSession, path: str) -> None:
    """Raise when the output is there already, or its folder cannot be made and written to."""
    system, place = file_system(spark, path)
    if system.exists(place):
        raise ValueError(f"{path} is there already; outputs are never overwritten")
    folder = path.rstrip("/").rsplit("/", 1)[0]
    _, parent = file_system(spark, folder)
    _, probe = file_system(spark, f"{folder}/.writable-{uuid.uuid4().hex}")
    try:
        before = system.exists(parent)
        system.create(probe, False).close()
        system.delete(probe, False)
        if not before:
            system.delete(parent, False)
    except Exception as error:
        raise ValueError(f"{path} cannot be written: {error}") from error


def header_line(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).limit(1).select(decoded(F.col("value"))).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    return first[0][0].replace("\ufeff", "").rstrip("\r")


def detect_delimiter(line: str, candidates: Sequence[str] = DELIMITERS) -> str:
    """Most frequent candidate in the header line."""
    return max(candidates, key=line.count)


def decoded(line: Column, fallback: str = "ISO-8859-1") -> Column:
    """A raw line as text: UTF-8 where it is valid, the fallback character set elsewhere."""
    return F.when(F.is_valid_utf8(line), line).otherwise(F.decode(line.cast("binary"), fallback))


def unquoted_delimiters(line: Column, sep: str) -> Column:
    """Number of delimiters outside quoted fields."""
    bare = F.regexp_replace(line, '"[^"]*+(?:""[^"]*+)*+"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))


def scan_lines(
    spark: SparkSession, path: str, sep: str | None = None, names: Sequence[str] | None = None
) -> DataFrame:
    """Line-wise CSV scan that decides the character set of every line by itself.

    Returns the text columns and ``bad_line``: the line itself when it has more fields than the
    header or an odd number of quotes, else NULL. Line breaks inside quotes need ``scan_csv``.
    """
    first = header_line(spark, path) if names is None or sep is None else ""
    sep = sep or detect_delimiter(first)
    lines = spark.read.text(path).select(
        F.regexp_replace(decoded(F.col("value")), "^﻿|\r$", "").alias("line")
    )
    if names is None:
        names = headers.tidy_names(split_header(first, sep), case=None)
        lines = lines.filter(F.col("line") != F.lit(first))
    lines = lines.filter(F.col("line") != "")
    fields = ", ".join(f"c{place} string" for place in range(len(names)))
    parsed = F.from_csv(F.col("line"), F.lit(fields), {"sep": sep, "escape": '"'})
    too_many = unquoted_delimiters(F.col("line"), sep) >= len(names)
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    rows = lines.select(parsed.alias("row"), F.when(too_many | (quotes % 2 == 1), F.col("line")).alias("bad_line"))
    return rows.select(
        *[F.col(f"row.c{place}").alias(name) for place, name in enumerate(names)], "bad_line"
    )


def split_header(line: str, sep: str) -> list[str]:
    names = next(csv.reader([line], delimiter=sep))
    return [name or f"_c{place}" for place, name in enumerate(names)]


def split_bad_lines(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the lines with too many fields."""
    good = scanned.filter(F.col("bad_line").isNull()).drop("bad_line")
    return good, scanned.filter(F.col("bad_line").isNotNull()).select("bad_line")


def blanks_to_null(df: DataFrame) -> DataFrame:
    """NULL in place of text without content, at ingest."""
    return df.select(
        *[
            F.when(~is_blank(headers.quoted(f.name)), headers.quoted(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else headers.quoted(f.name)
            for f in df.schema.fields
        ]
    )


def with_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """``row_id`` from a source key, or in the order of file name and place in the file.

    A scan that has numbered its rows (``PLACE``) is taken at its word, else they are numbered here.
    A place is written to a table at once: a second scan that is split another way would count
    differently. The splits, not the rows, are then put in order; there is one line per split.
    """
    if key is not None:
        # written, so that the steps behind, which read the rows several times, do not parse them again
        keyed = materialise(df.withColumn("row_id", headers.quoted(key).try_cast("bigint")).drop(PLACE), "keyed-input")
        total, full, distinct = keyed.agg(F.count("*"), F.count("row_id"), F.count_distinct("row_id")).first()
        if not total == full == distinct:
            raise ValueError(f"{key} is no key: {total - full} of {total} rows lack a number, {full - distinct} repeat one")
        return keyed
    if PLACE in df.columns:
        return df.withColumn("row_id", F.col(PLACE)).drop(PLACE)
    split = {"_file": F.input_file_name(), "_start": F.expr("input_file_block_start()"), "_part": F.spark_partition_id()}
    placed = df.withColumns({**split, "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(SPLIT_ROWS - 1))})
    placed = materialise(placed, "numbered-input")
    splits = placed.select(*split).distinct()
    ranked = splits.withColumn("_rank", F.row_number().over(Window.orderBy(*split)) - 1)
    numbered = placed.join(F.broadcast(ranked) if fits_broadcast(splits) else ranked, list(split))
    row_id = F.col("_rank").cast("bigint") * F.lit(SPLIT_ROWS) + F.col("_place")
    return numbered.withColumn("row_id", row_id).drop(*split, "_place", "_rank")
