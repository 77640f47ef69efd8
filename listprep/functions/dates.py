"""Purchase dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# English month names as written in free-form dates.
MONTH_FORMS = (
    "d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "MMM yyyy",
    "MMMM yyyy", "d MMM yyyy HH:mm", "d MMMM yyyy HH:mm", "d MMM yyyy HH:mm:ss", "d MMMM yyyy HH:mm:ss",
)
ISO_FORM = (
    r"^(\d{4})-(\d{1,2})(?:-(\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d*)?)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
)
DASH_FORM = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"


def _stamp(year: Column, month: Column, day: Column, *clock: Column) -> Column:
    """NULL instead of an error for a date that does not exist. No time zone is involved."""
    parts = [part.try_cast("int") for part in (year, month, day, *clock)]
    parts += [F.lit(0)] * (6 - len(parts))
    parts[5] = parts[5].cast("decimal(8,6)")
    return F.try_make_timestamp_ntz(*parts)


def _cut(text: Column, *spans: tuple[int, int]) -> list[Column]:
    return [F.substring(text, start, length) for start, length in spans]


def fixed_position_date(c: Column) -> Column:
    """``yyyy-mm-dd-hh.mm.ss...`` read by position; the separators are not looked at."""
    text = strip(c)
    parts = _cut(text, (1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))
    return F.when(F.length(text) >= 19, _stamp(*parts))


def slash_date(c: Column) -> Column:
    """``m/d/yyyy``."""
    text = strip(c)
    month, day, year = (F.split_part(text, F.lit("/"), F.lit(n)) for n in (1, 2, 3))
    return F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), _stamp(year, month, day))


def compact_date(c: Column) -> Column:
    """``yyyymmdd``."""
    text = strip(c)
    return F.when(text.rlike(r"^\d{8}$"), _stamp(*_cut(text, (1, 4), (5, 2), (7, 2))))


def _groups(text: Column, form: str, *defaults: str) -> list[Column]:
    """Groups of the form, a default where one is absent."""
    found = [F.nullif(F.regexp_extract(text, form, n), F.lit("")) for n in range(1, len(defaults) + 1)]
    return [F.coalesce(group, F.lit(default)) if default else group for group, default in zip(found, defaults)]


def general_date(c: Column) -> Column:
    """ISO date (to the month, day, minute or second), ``m-d-yyyy``, or an English month name.

    A zone is read and left out: the clock is taken as it is written.
    """
    text = strip(c)
    iso = F.when(text.rlike(ISO_FORM), _stamp(*_groups(text, ISO_FORM, "", "", "1", "0", "0", "0")))
    month, day, year = _groups(text, DASH_FORM, "", "", "")
    dashed = F.when(text.rlike(DASH_FORM), _stamp(year, month, day))
    named = [
        F.when(text.rlike("[A-Za-z]{3}"), F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz"))
        for form in MONTH_FORMS
    ]
    return F.coalesce(iso, dashed, *named)


def parse_purchase_date(c: Column, layout: str = "any") -> Column:
    """Purchase date as a time stamp without zone, NULL when it cannot be read.

    ``fixed`` reads the fixed-position form only, ``general`` the other forms, ``any`` tries
    the fixed-position form on text that has its separators and the other forms otherwise.
    """
    general = F.coalesce(slash_date(c), compact_date(c), general_date(c))
    if layout == "fixed":
        return fixed_position_date(c)
    if layout == "general":
        return general
    if layout != "any":
        raise ValueError(f"unknown date layout {layout!r}")
    dotted = strip(c).rlike(r"^\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}")
    return F.when(dotted, fixed_position_date(c)).otherwise(general)


def purchase_month(stamp: Column) -> Column:
    """Two-digit month, NULL without a date."""
    return F.lpad(F.month(stamp).cast("string"), 2, "0")


def purchase_year(stamp: Column) -> Column:
    return F.lpad(F.year(stamp).cast("string"), 4, "0")
