"""Counters taken while rows pass to where they go anyway."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .report import named_counts


class Counted:
    """Counts of rows that meet conditions, observed on the first job that has the frame in it.

    A task that runs again after a lost executor may be observed twice; what is written is not.
    ``of`` therefore compares the count of all rows with the table written, and counts there
    when they differ.
    """

    def __init__(self, conditions: Mapping[str, Column]):
        self.conditions = dict(conditions)
        self.observation = Observation()

    def attach(self, df: DataFrame) -> DataFrame:
        return df.observe(self.observation, *[F.count(F.when(c, 1)).alias(name) for name, c in self.conditions.items()])

    def seen(self, name: str) -> int:
        return self.observation.get[name]

    def of(self, written: DataFrame, every: str) -> dict[str, int]:
        """The counts, checked against the rows of the written table; ``every`` counts all rows."""
        found = dict(self.observation.get)
        if found[every] != written.count():
            found = {row.metric: row.n_rows for row in named_counts(written, self.conditions).collect()}
        return found
