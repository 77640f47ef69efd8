"""Vehicle identification numbers and model years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Model years 2001, 2002, ... in the order of their VIN codes, and the
# manufacturer prefixes whose brand is known without a rule.
YEAR_CODES = "123456789ABCDEFGHJKLMNPRSTVWXY"
FIRST_CODED_YEAR = 2001
BRAND_OF_PREFIX = {"SAL": "Land Rover", "SAJ": "Jaguar"}
VIN_LENGTH = 17
VALID_MODEL_YEARS = (2023, 2024, 2025, 2026)


def clean_vin(c: Column) -> Column:
    """Upper-case letters and digits only, without a trailing ``.0``."""
    return F.regexp_replace(F.upper(c), r"\.0$|[^A-Z0-9]", "")


def is_vin(vin: Column) -> Column:
    """A cleaned VIN of seventeen characters; never NULL."""
    return F.coalesce(F.length(vin) == VIN_LENGTH, F.lit(False))


def vin_segments(vin: Column) -> dict[str, Column]:
    """Positions 1-3, 4-8 and 10."""
    return {
        "vin13": F.substring(vin, 1, 3),
        "vin48": F.substring(vin, 4, 5),
        "vin10": F.substring(vin, 10, 1),
    }


def prefix_brand(vin13: Column, brand: Column | None = None) -> Column:
    """Brand known from the prefix, else the brand given."""
    known = F.lit(None).cast("string")
    for prefix, name in BRAND_OF_PREFIX.items():
        known = F.when(vin13 == prefix, name).otherwise(known)
    return F.coalesce(known, brand if brand is not None else F.lit(""))


def model_year(vin10: Column) -> Column:
    """Year of the position-10 code; NULL for a code that stands for no year (F8)."""
    place = F.position(vin10, F.lit(YEAR_CODES))
    return F.when((F.length(vin10) == 1) & (place > 0), place + (FIRST_CODED_YEAR - 1)).cast("int")


def four_digit_year(c: Column) -> Column:
    """``2025.0`` and ``25`` both become 2025."""
    text = strip(c.cast("string"))
    whole = F.when(F.contains(text, F.lit(".")), text.try_cast("double").try_cast("int"))
    short = F.when(F.length(text) == 2, F.concat(F.lit("20"), text).try_cast("int"))
    return F.coalesce(whole, short, text.try_cast("int"))
