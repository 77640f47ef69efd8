"""ZIP codes and address keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

ADDRESS_KEYS = {"naddrs1": "address_line1", "ncity": "city", "nstate": "state"}


def zip5(c: Column, strict: bool = False) -> Column:
    """Five-digit ZIP: left-padded, longer numbers cut, anything else NULL (F2).

    ``ddddd-dddd`` is read as its first five digits; ``strict`` treats it as unusable.
    """
    text = strip(c)
    # lpad also cuts text that is longer than the target length
    result = F.when(text.rlike(r"^\d+$"), F.lpad(text, 5, "0"))
    if strict:
        return result
    return result.when(text.rlike(r"^\d{5}-\d{4}$"), F.substring(text, 1, 5))


def zip2(zip_code: Column) -> Column:
    """F3."""
    return F.substring(zip_code, 1, 2)


def zip_plus4(c: Column) -> tuple[Column, Column]:
    """First five characters, and the four digits after them when present."""
    text = strip(c)
    extra = F.when(text.rlike(r"^\d{5}-?\d{4}$"), F.right(text, F.lit(4)))
    return F.substring(text, 1, 5), extra


def address_key(c: Column) -> Column:
    """NULL and blank compare equal."""
    return F.upper(strip(F.coalesce(c, F.lit(""))))


def address_keys() -> dict[str, Column]:
    return {key: address_key(F.col(source)) for key, source in ADDRESS_KEYS.items()}
