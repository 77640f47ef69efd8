"""Counts and reports, all derived from the tagged records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import is_coded, tidy_channel, year_channel_label
from ..functions.email import panel_of
from ..functions.text import is_blank, strip
from ..functions.vin import VALID_MODEL_YEARS, clean_vin
from ..sources.headers import DESCRIPTION_NAMES, SALES_TYPE_NAMES, first_listed, quoted, resolve

# The steps in the order they run, and the name of each step's reject table.
STEPS = (
    "blank_name",
    "email",
    "address_dedup",
    "sales_type",
    "geography",
    "business",
    "vin",
    "model_year",
    "dedup",
)
REJECT_SOURCES = {
    "blank_name": "name_removed_blanks",
    "email": "email_rejected",
    "address_dedup": "filtered_out_duplicate_address",
    "sales_type": "sales_type_rejected",
    "geography": "geo_rejected",
    "business": "business_rejected",
    "vin": "vin_rejected",
    "model_year": "vin_rejected",
    "dedup": "duplicates_rejected",
}
UNCODED_CELL = "UNCODED"
UNCODED_DESCRIPTION = "Uncoded – No Cell Assigned"
UNKNOWN_DESCRIPTION = "UNKNOWN"


def choose_value(key: Column, values: Mapping[str, object]) -> Column:
    chosen = F.lit(None)
    for name, value in values.items():
        chosen = F.when(key == name, F.lit(value)).otherwise(chosen)
    return chosen


def reject_report(tagged: DataFrame) -> DataFrame:
    """All rejected rows with ``rejection_source``."""
    rows = tagged.filter(F.col("reject_step").isNotNull())
    return rows.withColumn("rejection_source", choose_value(F.col("reject_step"), REJECT_SOURCES))


def combine_reject_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Reject tables of other runs by column name, each tagged with its name."""
    named = [table.withColumn("rejection_source", F.lit(name)) for name, table in tables.items()]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), named)


def reason_counts(tagged: DataFrame) -> DataFrame:
    """Rejected rows per step and reason (A5)."""
    return (
        tagged.filter(F.col("reject_step").isNotNull())
        .groupBy("reject_step", "reject_reason")
        .agg(F.count("*").alias("n_rows"))
    )


def step_audit(tagged: DataFrame, steps: Sequence[str] = STEPS, unreadable: int = 0) -> DataFrame:
    """Rows before, rejected and after per step, in step order (A1).

    Lines that the scan could not read are a step before all others.

    The table has one row per step, so the running total is over a handful of rows.
    """
    place = choose_value(F.col("reject_step"), {name: n for n, name in enumerate(steps, 1)})
    counts = tagged.agg(
        F.count("*").alias("total"),
        *[F.count(F.when(place == n, 1)).alias(f"s{n}") for n in range(1, len(steps) + 1)],
    )
    lost = F.lit(unreadable).cast("bigint")
    first = F.struct(
        F.lit(0).alias("step_no"), F.lit("unreadable_line").alias("step"), (F.col("total") + lost).alias("records_before"),
        lost.alias("rejected"), F.col("total").alias("records_after"),
    )
    rows = F.array(
        *[first] * bool(unreadable),
        *[
            F.struct(
                F.lit(n).alias("step_no"),
                F.lit(name).alias("step"),
                (F.col("total") - sum((F.col(f"s{m}") for m in range(1, n)), F.lit(0))).alias("records_before"),
                F.col(f"s{n}").alias("rejected"),
                (F.col("total") - sum((F.col(f"s{m}") for m in range(1, n + 1)), F.lit(0))).alias("records_after"),
            )
            for n, name in enumerate(steps, 1)
        ]
    )
    return counts.select(F.inline(rows))


def reconciliation(
    tagged: DataFrame, final: DataFrame | None = None, read: int | None = None, unreadable: int = 0
) -> DataFrame:
    """Start, removed, expected and final counts, and whether they agree.

    The start is what the scan read, unreadable lines included, and the end the final table;
    either is taken from the tagged records where it is not given.
    """
    keep = F.col("reject_step").isNull()
    counts = tagged.agg(
        (F.lit(read) if read is not None else F.count("*")).cast("bigint").alias("start_count"),
        F.count("reject_step").alias("total_removed"),
        F.count(F.when(keep, 1)).alias("kept"),
    )
    if final is not None:
        counts = counts.drop("kept").crossJoin(final.agg(F.count("*").alias("kept")))  # one row each
    start, removed = F.col("start_count") + F.lit(unreadable), F.col("total_removed") + F.lit(unreadable)
    return counts.select(
        start.alias("start_count"),
        removed.alias("total_removed"),
        F.col("kept").alias("final_count"),
        (start - removed).alias("expected_final"),
        F.when(start - removed == F.col("kept"), "Match").otherwise("Mismatch").alias("status"),
    )


def named_counts(df: DataFrame, counters: Mapping[str, Column]) -> DataFrame:
    """(metric, n_rows) for any set of conditions, in one pass."""
    row = df.agg(*[F.count(F.when(condition, 1)).alias(name) for name, condition in counters.items()])
    pairs = [F.struct(F.lit(name).alias("metric"), F.col(f"`{name}`").alias("n_rows")) for name in counters]
    return row.select(F.inline(F.array(*pairs)))


def run_counters(df: DataFrame) -> dict[str, Column]:
    """The counters of the fuller run report over tagged records.

    A ZIP without five digits is blank after cleaning; blank sales types are those of all records.
    """
    step, reason = F.col("reject_step"), F.col("reject_reason")

    def rejected(name: str) -> Column:
        return step == name

    counters = {
        "initial_count": F.lit(True),
        "invalid_sales_type": rejected("sales_type"),
        "invalid_model_year": rejected("model_year"),
        "invalid_emails": rejected("email"),
        "blank_name": rejected("blank_name"),
        "duplicate_addresses": rejected("address_dedup"),
        "bad_state_codes": reason == "Invalid state code",
        "bad_zip_state": reason == "State/ZIP mismatch",
        "geo_rejected": rejected("geography"),
        "business_exclusions": rejected("business"),
        "vin_rejected": rejected("vin"),
        "dedup_removed": rejected("dedup"),
        "duplicate_vins": reason == "Duplicate VIN in file",
        "listed_vins": reason == "Duplicate record",
        "final_valid_records": step.isNull(),
    }
    if "zip_code" in df.columns:
        counters["blank_zip"] = F.col("zip_code").isNull()
    sales_type = resolve(df.columns, SALES_TYPE_NAMES)
    if sales_type:
        counters["blank_sales_type"] = is_blank(quoted(sales_type))
    if "email" in df.columns:
        kept = step.isNull()
        counters["email_count"] = kept & ~is_blank(F.col("email"))
        counters["mail_count"] = kept & is_blank(F.col("email"))
    return counters


def zip_counts(df: DataFrame, raw: Column, clean: Column) -> DataFrame:
    """Blank ZIPs, and ZIPs that are not blank but unusable (A4)."""
    return df.agg(
        F.count(F.when(is_blank(raw), 1)).alias("blank_zip"),
        F.count(F.when(~is_blank(raw) & clean.isNull(), 1)).alias("bad_zip"),
    )


def vin_length_profile(df: DataFrame, vin: str = "vin") -> DataFrame:
    """Rows per length of the cleaned VIN; NULL VINs are a line of their own."""
    return df.groupBy(F.length(clean_vin(F.col(vin))).alias("vin_length")).agg(F.count("*").alias("n_rows"))


def domain_counts(df: DataFrame) -> DataFrame:
    """Kept e-mail records per panel (A10)."""
    with_email = df.filter(~is_blank(F.col("email")))
    return with_email.groupBy(panel_of(F.col("email")).alias("panel")).agg(F.count("*").alias("n_rows"))


def value_counts(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n_rows"))


def invalid_date_rows(df: DataFrame, month: str = "MO Purch", year: str = "YR Purch") -> DataFrame:
    """Report of rows without a purchase date; they stay in the list."""
    return df.filter(is_blank(quoted(month)) | is_blank(quoted(year)))


def year_channel_labels(years: Sequence[int] = VALID_MODEL_YEARS, channels: Sequence[str] = ("email", "mail")) -> list[str]:
    return [f"Year {year} {channel.title()}" for year in years for channel in channels]


def cell_report(df: DataFrame, labels: Sequence[str] | None = None, description: str | None = None) -> DataFrame:
    """VINs per cell and description, one column per year and channel, then their total.

    All uncoded rows are one line. A label outside ``labels`` has no column but counts in the
    total. One aggregate computes every column, so a frequent cell is reduced before the shuffle.
    """
    labels = list(labels or year_channel_labels())
    description = description or first_listed(df.columns, DESCRIPTION_NAMES)
    text = F.coalesce(strip(quoted(description)), F.lit(UNKNOWN_DESCRIPTION)) if description else F.lit(UNKNOWN_DESCRIPTION)
    coded = is_coded(F.col("cell"))
    channel = tidy_channel(F.col("channel") if "channel" in df.columns else None)
    rows = df.select(
        F.when(coded, strip(F.col("cell"))).otherwise(UNCODED_CELL).alias("cell"),
        F.when(coded, text).otherwise(UNCODED_DESCRIPTION).alias("description"),
        year_channel_label(F.col("modyy"), channel).alias("label"),
        "vin",
    )
    return rows.groupBy("cell", "description").agg(
        *[F.count(F.when(F.col("label") == label, F.col("vin"))).alias(label) for label in labels],
        F.count("vin").alias("Total"),
    )


def panel_totals(df: DataFrame) -> DataFrame:
    """Records per channel."""
    return df.groupBy("channel").agg(F.count("*").alias("n_rows"))


def panel_sizes(chunked: DataFrame) -> DataFrame:
    """Records per panel file."""
    return chunked.groupBy("panel", "n_chunks", "chunk").agg(F.count("*").alias("n_rows"))


def final_counters(default_cell: str, missing_ucc: str = "MISSING_UCC", missing_text: str = "MISSING DESCRIPTION") -> dict[str, Column]:
    """Counters over the final list: what the look-ups did not find."""
    return {
        "vin_missing_cell": F.upper(strip(F.col("cell"))) == default_cell.strip().upper(),
        "vin_missing_modelid": is_blank(F.col("modelid")),
        "missing_ucc": F.col("ucc") == missing_ucc,
        "missing_descriptions": F.col("description_long") == missing_text,
    }


# Sections of the run report: title, then label and counter of each line.
SECTIONS = (
    ("Original counts", (("records", "initial_count"), ("blank ZIP codes", "blank_zip"), ("blank names", "blank_name"))),
    (
        "Rejected",
        (
            ("invalid e-mail addresses", "invalid_emails"), ("repeated addresses", "duplicate_addresses"),
            ("blank sales type", "blank_sales_type"), ("invalid sales type", "invalid_sales_type"),
            ("unknown state", "bad_state_codes"), ("state and ZIP differ", "bad_zip_state"), ("geography in all", "geo_rejected"),
            ("businesses", "business_exclusions"), ("invalid VINs", "vin_rejected"), ("invalid model years", "invalid_model_year"),
        ),
    ),
    ("Duplicates", (("VINs repeated in the file", "duplicate_vins"), ("VINs on earlier lists", "listed_vins"), ("in all", "dedup_removed"))),
    (
        "Codes",
        (
            ("without cell", "vin_missing_cell"), ("without model id", "vin_missing_modelid"),
            ("without UCC", "missing_ucc"), ("without description", "missing_descriptions"),
        ),
    ),
    ("Final list", (("e-mail records", "email_count"), ("mail records", "mail_count"), ("in all", "final_valid_records"))),
)


def markdown(
    audit: DataFrame, checks: DataFrame, counts: DataFrame, title: str, period: str, start: int,
    breakdowns: Mapping[str, DataFrame] | None = None,
) -> str:
    """The run report as text, from the few rows of the report tables (K7).

    ``breakdowns`` are short tables by title: a line each per row, its first column and its last two.
    """
    numbers = {row.metric: row.n_rows for row in counts.collect()}
    lines = [f"# {title} data processing report", f"Period: {period}", f"First sequence number: {start}", ""]
    lines += ["## Steps", "", "| step | before | rejected | after |", "| --- | ---: | ---: | ---: |"]
    for row in audit.orderBy("step_no").collect():
        lines.append(f"| {row.step} | {row.records_before:,} | {row.rejected:,} | {row.records_after:,} |")
    named = set()
    for section, counters in SECTIONS:
        present = [(label, name) for label, name in counters if name in numbers]
        named |= {name for _, name in present}
        if present:
            lines += ["", f"## {section}", "", *[f"- {label}: {numbers[name]:,}" for label, name in present]]
    for section, table in (breakdowns or {}).items():
        rows = table.collect()
        lines += ["", f"## {section}", ""]
        lines += [f"- {row[0]}: {row[-2]:,} records, {row[-1]:,} kept" for row in rows] or ["- none"]
    if "blank_name" in numbers:
        before, gone = numbers["initial_count"], numbers["blank_name"]
        lines += ["", "## Blank names", "", f"- records before: {before:,}", f"- taken out: {gone:,}", f"- records after: {before - gone:,}"]
    if others := [name for name in numbers if name not in named]:
        lines += ["", "## Further counts", "", *[f"- {name}: {numbers[name]:,}" for name in others]]
    result = checks.first()
    lines += [
        "",
        "## Reconciliation",
        "",
        f"- start: {result.start_count:,}",
        f"- removed: {result.total_removed:,}",
        f"- final: {result.final_count:,}",
        f"- expected final: {result.expected_final:,}",
        f"- status: {result.status}",
    ]
    return "\n".join(lines) + "\n"
