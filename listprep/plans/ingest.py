"""From a manufacturer's raw file to records with standard columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import zip_plus4
from ..operators import shape
from ..sources import files, headers
from ..sources.records import Scan, scan_records

# Manufacturers whose files need a step of their own.
POSITIONAL = ("volvo",)
TWO_LAYOUTS = ("jlr",)
SEVERAL_PHONES = ("bmw",)
EXTRA_FROM_ID = ("honda", "acura")
SPLIT_ZIP = ("honda", "acura", "infiniti", "nissan")
CHECKED_SALES_TYPE = ("mercedes",)
FIXED_DATES = ("mercedes",)


def manufacturer_settings(manufacturer: str) -> dict:
    """The settings of the job that depend on the manufacturer."""
    name = manufacturer.lower().strip()
    return {
        "manufacturer": name,
        "check_sales_type": name in CHECKED_SALES_TYPE,
        "date_layout": "fixed" if name in FIXED_DATES else "general",
    }


def read_raw(spark: SparkSession, path: str, manufacturer: str, config: Mapping, multi_line: bool = False) -> Scan:
    """The files as text columns, and the lines that are no record, whatever the layout.

    With ``multi_line``, quoted fields may hold line breaks.
    """
    if manufacturer.lower().strip() in POSITIONAL:
        columns, optional = config["columns"], config.get("optional_columns", ())
        return scan_records(spark, path, ",", multi_line, columns, optional)
    return scan_records(spark, path, quoted_breaks=multi_line)


def standard_columns(raw: DataFrame, manufacturer: str, config: Mapping) -> DataFrame:
    """Known headers, the configured names, one address line, and every expected column."""
    name = manufacturer.lower().strip()
    if name in POSITIONAL:
        return raw
    columns: Mapping[str, str] = config.get("columns", {})
    layout: Mapping = {}
    if name in TWO_LAYOUTS:
        layout = files.choose_layout(raw.columns, config["legacy_mapping"], config["current_mapping"])
        columns = layout["columns"]
        df = headers.rename_aliases(raw)
        df = headers.drop_repeated(df, headers.tidy_names(df.columns, case=None))
    else:
        df = headers.rename_aliases(raw)
        df = headers.drop_repeated(df, headers.tidy_names(df.columns))
    df = headers.drop_repeated(df, [columns.get(column, column) for column in df.columns])
    df = shape.consolidate_address(df, shape.ADDRESS_LAYOUT.get(name, "as_is"))
    if name in SEVERAL_PHONES:
        df = shape.fill_phone(df)
    if name in EXTRA_FROM_ID:
        df = shape.fill_extra(df)
    if name in TWO_LAYOUTS:
        df = shape.fill_model_code(df)
    df = headers.add_missing(df, [*columns.values(), *config.get("optional_columns", ()), *layout.get("optional_columns", ())])
    if name in SPLIT_ZIP and "zip_code" in df.columns:
        five, four = zip_plus4(F.col("zip_code"))
        df = df.withColumns({"zip_code5": five, "zip4": four})
    return df


def ingest(raw: DataFrame, manufacturer: str, config: Mapping, key: str | None = None) -> DataFrame:
    """Standard records with ``row_id``, blank text as NULL.

    The rows are numbered by file and place unless a key is given, which has to be a number,
    there in every row and unique; columns are checked before anything is written.
    """
    df = files.blanks_to_null(standard_columns(raw, manufacturer, config))
    required(df)
    return files.with_row_id(df, key)


def required(df: DataFrame, names: Sequence[str] = ("address_line1", "city", "state", "purchase_date")) -> None:
    headers.check_columns(df, names)
    headers.resolve(df.columns, headers.EMAIL_NAMES, "email")
    headers.resolve(df.columns, headers.ZIP_NAMES, "ZIP")
    headers.resolve(df.columns, headers.VIN_NAMES, "VIN")
