"""Text clean-up shared by every other function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space, not only the blank that SQL ``trim`` removes.
WHITE_SPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    """Stripped text; NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    """Never NULL, so that its negation is the exact complement."""
    # stripping the left end alone stops at the first character that counts
    return F.coalesce(F.ltrim(c, F.lit(WHITE_SPACE)), F.lit("")) == ""


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank, none at either end."""
    # a single blank is left alone: most of the white space in a name needs no replacement
    return strip(F.regexp_replace(c, r"\s{2,}|[^\S ]", " "))


def join_words(*columns: Column) -> Column:
    return squeeze(F.concat_ws(" ", *columns))


def match_key(c: Column) -> Column:
    """Join key: stripped upper-case text, NULL stays NULL."""
    return F.upper(strip(c))


def drop_point_zero(c: Column) -> Column:
    """Remove the ``.0`` that a number-typed export leaves behind (F16)."""
    return F.regexp_replace(c, r"\.0$", "")


def cell_key(c: Column) -> Column:
    return drop_point_zero(match_key(c))


def drop_invalid_utf8(c: Column) -> Column:
    """Text without the bytes that are not UTF-8."""
    return F.when(F.is_valid_utf8(c), c).otherwise(
        F.replace(F.make_valid_utf8(c), F.lit("�"), F.lit(""))
    )
