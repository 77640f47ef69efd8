"""Final table and panel layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.email import channel_of, email_domain, panel_of
from ..sources.headers import quoted
from .numbering import PANEL_SIZE, chunk_count, chunk_of

# The panel layouts, and the columns whose source has another name.
MAIL_LAYOUT = (
    "NAME", "ADDRESS", "CITY", "STATE", "ZIP", "ROTATION", "VERSION", "FILE SOURCE", "SVI CELL",
    "MOD YR", "DESCRIPTION", "VIN", "PURCH/LSE", "MO PURCH", "YR PURCH", "MAIL DATE (MMDD)", "BRAND",
    "SEQUENCE #(8)", "MFG MODEL CODE", "EXTRA1", "UCC", "EXTERNALREFERENCE", "ELECTRIC", "SOS", "DOMAIN",
)
EMAIL_LAYOUT = (*MAIL_LAYOUT[:18], "EMAIL", *MAIL_LAYOUT[18:])
LAYOUT_SOURCES = {
    "ADDRESS": ("address_line1",),
    "ZIP": ("zip", "zip_code", "zipcode"),
    "SVI CELL": ("cell", "svi cell"),
    "MOD YR": ("modyy", "model_year"),
    "PURCH/LSE": ("purch_lse",),
    "SEQUENCE #(8)": ("seq8",),
}
ROTATION = "A"
VERSION = "1.0"
GUARDED = ("Brand", "cell", "email", "ucc", "seq8")
GUARD_VALUE = "MISSING"


def guard_columns(df: DataFrame, names: Sequence[str] = GUARDED) -> DataFrame:
    """``MISSING`` in place of a required column that is absent."""
    present = {name.lower() for name in df.columns}
    absent = [name for name in names if name.lower() not in present]
    return df.withColumns({name: F.lit(GUARD_VALUE) for name in absent}) if absent else df


def merge_case_variants(df: DataFrame, name: str) -> DataFrame:
    """One column ``name`` from all its case variants, the exact spelling first."""
    places = [n for n, column in enumerate(df.columns) if column.lower() == name.lower()]
    if not places:
        return df
    places.sort(key=lambda n: df.columns[n] != name)
    numbered = df.toDF(*[f"c{n}" for n in range(len(df.columns))])
    merged = F.coalesce(*[F.col(f"c{n}") for n in places]).alias(name)
    return numbered.select(
        *[
            merged if n == min(places) else F.col(f"c{n}").alias(column)
            for n, column in enumerate(df.columns)
            if n == min(places) or n not in places
        ]
    )


def panel_metadata(df: DataFrame, file_source: Column | str = "") -> DataFrame:
    """Columns that only the final table has."""
    if isinstance(file_source, str):
        file_source = F.lit(file_source)
    df = guard_columns(df)
    if "bodycode" in df.columns:
        df = df.withColumnRenamed("bodycode", "MFG MODEL CODE")
    else:
        df = df.withColumn("MFG MODEL CODE", F.lit(None).cast("string"))
    return df.withColumns(
        {
            "DOMAIN": email_domain(F.col("email")),
            "ROTATION": F.lit(ROTATION),
            "VERSION": F.lit(VERSION),
            "FILE SOURCE": file_source,
            "EXTERNALREFERENCE": F.col("seq8"),
            "PHONE": F.lit(None).cast("string"),
        }
    )


def final_table(df: DataFrame, file_source: Column | str = "") -> DataFrame:
    """The final list: one spelling per column, metadata, upper-case ``EMAIL``.

    Brand and description are those of the VIN rule that gave the cell.
    """
    if "desc" in df.columns and "description" not in map(str.lower, df.columns):
        df = df.withColumnRenamed("desc", "Description")
    for name in ("Brand", "Description", "MO Purch", "YR Purch"):
        df = merge_case_variants(df, name)
    return panel_metadata(df, file_source).withColumnRenamed("email", "EMAIL")


def with_channel(df: DataFrame) -> DataFrame:
    """V14."""
    return df.withColumn("channel", channel_of(F.col("email")))


def panel_layout(df: DataFrame, layout: Sequence[str], *more: Column) -> DataFrame:
    """Projection to a fixed layout; a column without a source is NULL, blank in a file."""
    spelt: dict[str, str] = {}
    for name in df.columns:
        spelt.setdefault(name.lower(), name)
    columns = []
    for name in layout:
        candidates = (name.lower(), *LAYOUT_SOURCES.get(name, ()))
        source = next((spelt[c] for c in candidates if c in spelt), None)
        value = quoted(source) if source else F.lit(None)
        columns.append(value.cast("string").alias(name))
    return df.select(*columns, *more)


def split_channels(final: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The e-mail and the mail output, each in its layout with ``CHANNEL``."""
    channel = channel_of(F.col("email"))
    email = panel_layout(final.filter(channel == "email"), EMAIL_LAYOUT, F.lit("email").alias("CHANNEL"))
    mail = panel_layout(final.filter(channel == "mail"), MAIL_LAYOUT, F.lit("mail").alias("CHANNEL"))
    return email, mail


def with_panel(df: DataFrame) -> DataFrame:
    """Panel of the e-mail records, NULL for mail."""
    return df.withColumn("panel", F.when(F.col("channel") == "email", panel_of(F.col("email"))))


def with_chunks(df: DataFrame, size: int = PANEL_SIZE) -> DataFrame:
    """Chunk of every e-mail record and the number of chunks of its panel.

    ``panel_row`` comes from the numbering; the panel totals are three rows.
    """
    totals = df.filter("panel IS NOT NULL").groupBy("panel").agg(chunk_count(F.count("*"), size).alias("n_chunks"))
    rows = df.filter("panel IS NOT NULL").withColumn("chunk", chunk_of(F.col("panel_row"), size))
    return rows.join(F.broadcast(totals), "panel")


def panel_files(final: DataFrame) -> DataFrame:
    """The e-mail layout of chunked records, with ``panel_file`` and the row's place in it (K6)."""
    file = F.concat_ws("_", "panel", F.lit("panel"), F.col("chunk"), F.lit("of"), F.col("n_chunks"))
    return panel_layout(
        final, EMAIL_LAYOUT, F.lit("email").alias("CHANNEL"), F.col("panel"), file.alias("panel_file"), F.col("panel_row")
    )
