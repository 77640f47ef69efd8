"""Checks on single records.

A check is a step, a condition that is never NULL, and the reason given to the rows that meet
it. Checks need no shuffle, so any number of them is evaluated in the scan. They expect cleaned
columns, so that each text is cleaned once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import SALES_TYPES
from ..functions.email import EMAIL_FORM
from ..functions.geo import zip2
from ..functions.text import is_blank, strip
from ..functions.vin import VALID_MODEL_YEARS, is_vin
from ..sources.rules import BusinessRules, EmailRules, StateZipRules

# Reasons given to rejected rows.
BLANK_NAME = "Blank name"
INVALID_EMAIL = "Invalid email"
INVALID_SALES_TYPE = "Invalid or missing sales type"
INVALID_STATE = "Invalid state code"
STATE_ZIP_MISMATCH = "State/ZIP mismatch"
BUSINESS = "Business"
INVALID_VIN = "Invalid VIN"
INVALID_MODEL_YEAR = "Invalid model year"


@dataclass(frozen=True)
class Check:
    step: str
    failed: Column
    reason: str


def _certain(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def blank_name(name: Column) -> Check:
    """V1."""
    return Check("blank_name", is_blank(name), BLANK_NAME)


def bad_email(email: Column, rules: EmailRules) -> Check:
    """A blank address passes; any other has to be well formed and not ruled out (V2)."""
    bad = ~email.rlike(EMAIL_FORM)
    for pattern in rules.patterns():
        bad = bad | email.rlike(pattern)
    return Check("email", _certain((email != "") & bad), INVALID_EMAIL)


def bad_sales_type(sales_type: Column) -> Check:
    """V4."""
    known = F.lower(strip(sales_type)).isin(list(SALES_TYPES))
    return Check("sales_type", ~_certain(known), INVALID_SALES_TYPE)


def bad_geography(state: Column, zip_code: Column, rules: StateZipRules) -> list[Check]:
    """The state has to list the first two digits of the ZIP.

    The pairs are a literal set probed inside the scan; there are at most a hundred per state.
    """
    known = state.isin(rules.states())
    fits = F.concat(state, F.lit("|"), zip2(zip_code)).isin(rules.pairs())
    return [
        Check("geography", ~_certain(known), INVALID_STATE),
        Check("geography", ~_certain(fits), STATE_ZIP_MISMATCH),
    ]


def names_business(name: Column, rules: BusinessRules) -> Column:
    """A business term anywhere in the name (V6)."""
    pattern = rules.indicator_pattern()
    return F.coalesce(name.rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def names_manufacturer(first_name: Column, last_name: Column, rules: BusinessRules) -> Column:
    """A manufacturer as a whole word of the person's name (V7)."""
    pattern = rules.manufacturer_pattern()
    blank = F.lit("")
    person = F.concat(
        F.lower(F.coalesce(first_name, blank)), F.lit(" "), F.lower(F.coalesce(last_name, blank))
    )
    return person.rlike(pattern) if pattern else F.lit(False)


def is_allowed(name: Column, city: Column, rules: BusinessRules) -> Column:
    """Listed by name, or by name and city, as never a business."""
    blank = F.lit("")
    key = F.coalesce(F.lower(strip(name)), blank)
    place = F.concat(key, F.lit("\n"), F.coalesce(F.lower(strip(city)), blank))
    return key.isin(rules.allowed_names()) | place.isin(rules.allowed_name_cities())


def is_business(
    name: Column, first_name: Column, last_name: Column, city: Column, rules: BusinessRules
) -> Column:
    """V9; never NULL."""
    suspected = names_business(name, rules) | names_manufacturer(first_name, last_name, rules)
    return suspected & ~is_allowed(name, city, rules)


def business(df: DataFrame, rules: BusinessRules) -> Check:
    def column(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    first, last = column("first_name"), column("last_name")
    return Check("business", is_business(column("name"), first, last, column("city"), rules), BUSINESS)


def bad_vin(vin: Column) -> Check:
    """V10."""
    return Check("vin", ~is_vin(vin), INVALID_VIN)


def bad_model_year(year: Column, valid: Sequence[int] = VALID_MODEL_YEARS) -> Check:
    """V11."""
    return Check("model_year", ~_certain(year.isin(list(valid))), INVALID_MODEL_YEAR)


def first_failure(checks: Sequence[Check], offset: int = 0) -> Column:
    """Place of the first check that fails, from ``offset``; NULL when all pass."""
    place = F.when(checks[0].failed, offset)
    for n, check in enumerate(checks[1:], offset + 1):
        place = place.when(check.failed, n)
    return place


def verdict(place: Column, outcomes: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """``reject_step`` and ``reject_reason`` of the outcome at this place."""

    def pick(values: Sequence[str]) -> Column:
        chosen = F.when(place == 0, values[0])
        for n, value in enumerate(values[1:], 1):
            chosen = chosen.when(place == n, value)
        return chosen

    steps, reasons = zip(*outcomes, strict=True)
    return {"reject_step": pick(steps), "reject_reason": pick(reasons)}


def screen(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Fill ``reject_step`` and ``reject_reason`` of the rows not rejected before."""
    placed = df.withColumn("_place", first_failure(checks))
    found = verdict(F.col("_place"), [(check.step, check.reason) for check in checks])
    if "reject_step" in df.columns:
        # an earlier verdict stands
        before = F.col("reject_step").isNotNull()
        found = {name: F.when(before, F.col(name)).otherwise(value) for name, value in found.items()}
    return placed.withColumns(found).drop("_place")


def kept(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_step").isNull())


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_step").isNotNull())


def require_rows(df: DataFrame) -> None:
    """Stop a run that has nothing left (V3)."""
    if df.isEmpty():
        raise ValueError("no records remain")
