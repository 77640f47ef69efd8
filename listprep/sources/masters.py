"""Reference tables: UCC master, description master, exclusion files."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cell_key, match_key, strip
from ..functions.vin import four_digit_year
from . import headers
from .files import detect_delimiter, header_line, scan_csv, scan_lines, split_bad_lines, with_row_id

log = logging.getLogger(__name__)


def drop_empty(df: DataFrame) -> DataFrame:
    """Without the rows, and then the columns, that hold no value at all."""
    df = df.dropna("all")
    counts = df.agg(*[F.count(headers.quoted(name)).alias(name) for name in df.columns]).first()
    return df.select(*[headers.quoted(name) for name in df.columns if counts[name] > 0])


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """A master CSV with tidy headers, without its bad lines, which are counted in the log; an
    empty one is an error (S9)."""
    return read_ordered_master(spark, path).drop("row_id")


def read_ordered_master(spark: SparkSession, path: str) -> DataFrame:
    """``read_master`` written once, with ``row_id`` in the order of file name and place in the
    file, which says which of several rows with one key is the first."""
    rows, bad_lines = split_bad_lines(scan_lines(spark, path))
    if unreadable := bad_lines.count():
        log.warning("%s: %d lines have too many fields or open quotes and are left out", path, unreadable)
    rows = headers.drop_repeated(rows, headers.tidy_names(rows.columns)).dropna("all")
    numbered = with_row_id(rows.drop("row_id"))
    rows = drop_empty(numbered)
    if rows.columns == ["row_id"] or numbered.isEmpty():
        raise ValueError(f"{path} holds no rows")
    return rows


def _order(df: DataFrame, ord_column: str | None) -> Column:
    """The column that says which of several rows with one key is the first."""
    if ord_column is None and "row_id" in df.columns:
        ord_column = "row_id"
    return F.col(ord_column) if ord_column else F.monotonically_increasing_id()


def ucc_master(df: DataFrame, ord_column: str | None = None) -> DataFrame:
    """(ord, cell, modyy, ucc, description) from any accepted header spelling."""
    cell = headers.resolve(df.columns, headers.CELL_NAMES, "cell")
    year = headers.resolve(df.columns, headers.YEAR_NAMES, "model year")
    ucc = headers.resolve(df.columns, headers.UCC_NAMES, "UCC")
    description = headers.resolve(df.columns, ("description",))
    order = _order(df, ord_column)
    text = headers.quoted(description) if description else F.lit(None).cast("string")
    return df.select(
        order.cast("bigint").alias("ord"),
        match_key(headers.quoted(cell)).alias("cell"),
        four_digit_year(headers.quoted(year)).alias("modyy"),
        strip(headers.quoted(ucc)).alias("ucc"),
        strip(text).alias("description"),
    )


def description_master(df: DataFrame, ord_column: str | None = None) -> DataFrame:
    """(ord, cell, description_long); the first header that says description counts."""
    cell = headers.resolve(df.columns, headers.CELL_NAMES, "cell")
    name = next((n for n in df.columns if "description" in n.strip().lower()), None)
    if name is None:
        raise ValueError(f"no description column in {df.columns}")
    order = _order(df, ord_column)
    return df.select(
        order.cast("bigint").alias("ord"),
        cell_key(headers.quoted(cell)).alias("cell"),
        F.coalesce(strip(headers.quoted(name)), F.lit("")).alias("description_long"),
    )


def vin_list(df: DataFrame) -> DataFrame | None:
    """Upper-case VINs of one exclusion table; None when it has no VIN column."""
    spelt = headers.tidy_names(df.columns)
    place = next((n for n, name in enumerate(spelt) if name in headers.VIN_NAMES), None)
    if place is None:
        return None
    vin = headers.quoted(df.columns[place])
    return df.filter(vin.isNotNull()).select(F.upper(vin).alias("vin"))


def exclusion_set(tables: Iterable[DataFrame]) -> DataFrame | None:
    """Distinct VINs of all tables (U4)."""
    lists = [found for found in map(vin_list, tables) if found is not None]
    return reduce(DataFrame.unionByName, lists).distinct() if lists else None


def exclusion_sources(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """(vin, source) of all tables, which a VIN may be in more than once."""
    lists = [(name, vin_list(table)) for name, table in tables.items()]
    named = [found.withColumn("source", F.lit(name)) for name, found in lists if found is not None]
    return reduce(DataFrame.unionByName, named) if named else None


def read_exclusion_sources(spark: SparkSession, paths: Iterable[str]) -> tuple[DataFrame | None, list[str]]:
    """(vin, source) of many CSV files, named by their paths, and the files that could not be used."""
    tables, skipped = {}, []
    for path in paths:
        try:
            table = scan_csv(spark, path, sep=detect_delimiter(header_line(spark, path)))
            usable = vin_list(table) is not None
        except Exception as error:  # a missing or broken file must not end the run
            log.warning("exclusion file %s skipped: %s", path, error)
            usable = False
        if usable:
            tables[path] = table
        else:
            skipped.append(path)
    return exclusion_sources(tables), skipped


def read_exclusions(spark: SparkSession, paths: Iterable[str]) -> tuple[DataFrame | None, list[str]]:
    """Exclusion set of many CSV files, and the files that could not be used."""
    listed, skipped = read_exclusion_sources(spark, paths)
    return None if listed is None else listed.select("vin").distinct(), skipped
