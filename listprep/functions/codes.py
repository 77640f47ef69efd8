"""Codes and labels on enriched records."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Fixed values.
SALES_TYPES = ("lease", "retail", "purchase")
ELECTRIC_WORDS = ("electric", "ev", "phev", "hybrid")
UNCODED_CELLS = ("", "DEFAULT", "UNCODED", "MISSING")
MISSING_UCC = "MISSING_UCC"
MISSING_DESCRIPTION = "MISSING DESCRIPTION"
UCC_LENGTH = 21


def purchase_lease_code(sales_type: Column) -> Column:
    """2 for a lease, 1 for anything else."""
    return F.when(F.lower(strip(sales_type)) == "lease", 2).otherwise(1)


def electric_flag(
    columns: Sequence[Column], words: Sequence[str] = ELECTRIC_WORDS, whole_words: bool = False
) -> Column:
    """``1`` when any text names an electric drive.

    A bare word counts anywhere in the text, also inside a longer word, unless
    ``whole_words`` is set.
    """
    pattern = "|".join(re.escape(word) for word in words)
    pattern = rf"(?i)\b(?:{pattern})\b" if whole_words else f"(?i){pattern}"
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(column.rlike(pattern), F.lit(False))
    return F.when(hit, "1").otherwise("0")


def clean_ucc(c: Column) -> Column:
    """Stripped code, ``MISSING_UCC`` when there is none."""
    text = strip(c)
    return F.when(text.isNull() | text.isin("", "nan"), MISSING_UCC).otherwise(text)


def spreadsheet_text(ucc: Column) -> Column:
    """A full-length code in the form a spreadsheet keeps as text (K9)."""
    full = F.coalesce(ucc.rlike(rf"^[0-9]{{{UCC_LENGTH}}}$"), F.lit(False))
    return F.when(full, F.concat(F.lit('="'), ucc, F.lit('"'))).otherwise(ucc)


def is_coded(cell: Column) -> Column:
    """Never NULL."""
    return ~F.upper(strip(F.coalesce(cell, F.lit("")))).isin(list(UNCODED_CELLS))


def tidy_channel(channel: Column | None) -> Column:
    """F25."""
    if channel is None:
        return F.lit("unknown")
    return F.lower(strip(F.coalesce(channel, F.lit("unknown"))))


def year_channel_label(year: Column, channel: Column) -> Column:
    """``Year 2025 Email``."""
    return F.concat(
        F.lit("Year "), strip(F.coalesce(year.cast("string"), F.lit(""))), F.lit(" "), F.initcap(channel)
    )
