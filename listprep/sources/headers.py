"""Header resolution. Works on column names alone, so none of it starts a Spark job."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Source header -> standard header, case-sensitive.
COLUMN_ALIASES = {
    "ZIP_CODE": "ZIP",
    "zip_code": "ZIP",
    "CELL": "SVI CELL",
    "MODEL_YEAR": "MOD YR",
    "MODYY": "MOD YR",
    "PURCH_LSE": "PURCH/LSE",
    "SEQUENCE": "SEQUENCE #(8)",
    "model_id": "bodycode",
    "NA_MODEL_CODE": "bodycode",
    "ModelCode": "bodycode",
    "MODEL_DESC": "bodycode",
    "ProductionCode": "bodycode",
    "ModelDescription": "bodycode",
}
# Accepted names of a role, in the order they are looked for.
EMAIL_NAMES = ("email", "email_addr", "email_address")
SALES_TYPE_NAMES = ("veh_acq_type_cd", "purchase_or_lease", "sales_type")
ZIP_NAMES = ("zip_code", "zipcode", "zip")
VIN_NAMES = ("vin", "vehicleid", "usa_vin")
YEAR_NAMES = ("modyy", "model_year", "modelyear", "year", "model year", "mod yr")
CELL_NAMES = ("cell", "sra cell", "svi cell")
UCC_NAMES = ("ucc", "21 digit")
DESCRIPTION_NAMES = ("ldesc", "desc", "description", "mailing description", "mail_desc", "long_desc")


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def tidy_names(names: Iterable[str], case: str | None = "lower") -> list[str]:
    """Stripped names, optionally in one case; a byte-order mark is dropped."""
    names = [name.replace("﻿", "").strip() for name in names]
    return [getattr(name, case)() for name in names] if case else names


def first_of_each(names: Sequence[str]) -> list[int]:
    """Positions to keep when names repeat: the first of each (P5)."""
    first: dict[str, int] = {}
    for place, name in enumerate(names):
        first.setdefault(name, place)
    return list(first.values())


def drop_repeated(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Give ``df`` the names, keeping the first column of each name."""
    keep = first_of_each(names)
    placed = df.toDF(*[f"c{place}" for place in range(len(names))])
    return placed.select(*[F.col(f"c{place}").alias(names[place]) for place in keep])


def rename_aliases(df: DataFrame, aliases: Mapping[str, str] = COLUMN_ALIASES) -> DataFrame:
    """Standard names for known headers.

    When several headers stand for one name, the first non-NULL value counts, with the column
    that already has the name before its aliases.
    """
    present = set(df.columns)
    sources: dict[str, list[str]] = {}
    for name in df.columns:
        sources.setdefault(aliases.get(name, name), [])
    for target in sources:
        if target in present and target not in aliases:
            sources[target].append(target)
        sources[target] += [a for a, standard in aliases.items() if standard == target and a in present]
    return df.select(
        *[
            (F.coalesce(*map(quoted, group)) if len(group) > 1 else quoted(group[0])).alias(target)
            for target, group in sources.items()
        ]
    )


def rename_mapped(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by a configured source -> target map."""
    return df.select(*[quoted(name).alias(mapping.get(name, name)) for name in df.columns])


def add_missing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Append the columns that are absent, as NULL text."""
    absent = [name for name in dict.fromkeys(names) if name not in df.columns]
    return df.withColumns({name: F.lit(None).cast("string") for name in absent}) if absent else df


def resolve(names: Sequence[str], candidates: Sequence[str], required: str | None = None) -> str | None:
    """First candidate present, ignoring case, as it is spelt in ``names``.

    ``required`` names the role in the error raised when there is none.
    """
    spelt = {}
    for name in names:
        spelt.setdefault(name.lower(), name)
    for candidate in candidates:
        if candidate in spelt:
            return spelt[candidate]
    if required:
        raise ValueError(f"no {required} column; looked for {list(candidates)} in {list(names)}")
    return None


def first_listed(names: Sequence[str], wanted: Sequence[str]) -> str | None:
    """First name in table order that is among ``wanted``."""
    return next((name for name in names if name in wanted), None)


def header_differences(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Rows (column_name, problem) for headers that are missing or not expected (P20)."""
    rows = [(name, "missing") for name in expected if name not in df.columns]
    rows += [(name, "unexpected") for name in df.columns if name not in expected]
    return df.sparkSession.createDataFrame(rows, "column_name string, problem string")


def check_columns(df: DataFrame, required: Sequence[str]) -> None:
    """Raise before the first job when a required column is absent."""
    absent = [name for name in required if name not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}; present: {df.columns}")
