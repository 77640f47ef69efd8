"""Records that arrive as a stream.

The checks and look-ups on single records take a streaming DataFrame as they are. Duplicates,
numbers and reports need all records and belong to the batch job.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from ..operators.validate import screen
from ..plans.pipeline import Settings, early_checks, late_checks, prepare


def screen_stream(records: DataFrame, settings: Settings) -> DataFrame:
    """Cleaned records with the verdict of the single-record checks, in step order."""
    # whether a whole table lacks names cannot be known of a stream
    prepared = prepare(records, replace(settings, name_per_row=True))
    return screen(prepared, [*early_checks(settings), *late_checks(prepared, settings)])
