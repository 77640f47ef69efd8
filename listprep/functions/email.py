"""E-mail text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The accepted e-mail form and the domains of each panel.
EMAIL_FORM = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
PANELS = {
    "gmail": ["gmail.com", "googlemail.com"],
    "yahoo_aol": ["yahoo.com", "aol.com", "ymail.com", "rocketmail.com"],
}
COARSE_PANELS = {"gmail": ["gmail.com"], "yahoo/aol": ["yahoo.com", "aol.com"]}
OTHER_PANEL = "other"


def clean_email(c: Column) -> Column:
    """F1."""
    return F.lower(strip(c))


def email_domain(c: Column) -> Column:
    """Text after the last ``@``; ``unknown`` when there is none."""
    return F.when(F.contains(c, F.lit("@")), F.substring_index(c, "@", -1)).otherwise("unknown")


def _panel(domain: Column, panels: dict[str, list[str]]) -> Column:
    pairs = [F.lit(text) for name, domains in panels.items() for known in domains for text in (known, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), domain), F.lit(OTHER_PANEL))


def panel_of(email: Column) -> Column:
    """Panel an e-mail record is filed under."""
    return _panel(F.lower(email_domain(email)), PANELS)


def coarse_panel_of(email: Column) -> Column:
    """Three-way class with the shorter domain lists."""
    return _panel(F.lower(email_domain(email)), COARSE_PANELS)


def cleaned_channel(email: Column) -> Column:
    """``email`` when there is a cleaned address, else ``mail``."""
    return F.when(F.coalesce(email, F.lit("")).isin("", "nan"), "mail").otherwise("email")


def channel_of(email: Column) -> Column:
    """The same for an address as it was given."""
    return cleaned_channel(clean_email(email))
