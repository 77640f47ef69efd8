"""The whole list job: screen, deduplicate, enrich, number, report.

The order of the steps decides which reason a row gets and which of two duplicates survives:
the first step that fails takes the row, and each duplicate step looks only at rows that are
still in the list when it runs.

Shape of the plan. All checks on single rows run in the scan. Two aggregates over narrow
columns find the survivor of every address and of every VIN, and the survivors are numbered
while they are still narrow. The whole rows are shuffled once, on the unique ``row_id``, to meet
these results; the codes are then joined on by broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import purchase_lease_code
from ..functions.dates import parse_purchase_date, purchase_month, purchase_year
from ..functions.email import PANELS, clean_email, cleaned_channel
from ..functions.geo import address_keys, zip2, zip5
from ..functions.text import match_key, strip
from ..functions.vin import VALID_MODEL_YEARS, clean_vin, model_year, prefix_brand, vin_segments
from ..operators import dedup, enrich, panel, profile, report, shape, validate
from ..operators.counting import Counted
from ..operators.lookup import fits_broadcast
from ..operators.numbering import PANEL_SIZE, number_rows
from ..operators.validate import Check
from ..sources import headers
from ..sources.rules import DEFAULT_CELL, BusinessRules, EmailRules, StateZipRules
from ..storage import materialise

ORDER = [*dedup.KEYS, "row_id"]
# the named panels, the rest, and records without e-mail
PANEL_COUNT = len(PANELS) + 2
# how far a row came in the duplicate steps
FIRST_ADDRESS, LISTED_VIN, IN_LIST = 1, 2, 3


@dataclass(frozen=True)
class Settings:
    """One manufacturer's run."""

    manufacturer: str
    email_rules: EmailRules = field(default_factory=EmailRules)
    state_zip_rules: StateZipRules = field(default_factory=StateZipRules)
    business_rules: BusinessRules = field(default_factory=BusinessRules)
    default_cell: str = DEFAULT_CELL
    valid_years: Sequence[int] = VALID_MODEL_YEARS
    date_layout: str = "any"
    check_sales_type: bool = False
    strict_zip: bool = False
    blank_is_duplicate: bool = True
    whole_word_electric: bool = False
    name_per_row: bool = False
    start_number: int = 1
    file_source: str = ""
    panel_size: int = PANEL_SIZE


@dataclass(frozen=True)
class References:
    """Tables joined on, as ``sources.rules`` and ``sources.masters`` return them; ``listed`` is
    ``exclusions`` with the list each VIN is from."""

    vin_rules: DataFrame
    ucc_master: DataFrame
    description_master: DataFrame
    exclusions: DataFrame | None = None
    listed: DataFrame | None = None

    @cached_property
    def broadcast(self) -> dict[str, bool]:
        """Which of the tables joined by key fit a broadcast; measured once."""
        names = ("vin_rules", "ucc_master", "description_master")
        return {name: fits_broadcast(getattr(self, name)) for name in names}


@dataclass(frozen=True)
class Result:
    """``read`` and ``unreadable``: records and bad lines counted at the scan, where there was one;
    ``counted``: the counters of the tagged records, taken while they were written; ``listed``: VINs
    of earlier lists with the list each is from."""

    tagged: DataFrame
    final: DataFrame
    settings: Settings
    read: int | None = None
    unreadable: int = 0
    counted: Mapping[str, int] | None = None
    listed: DataFrame | None = None

    @property
    def rejected(self) -> DataFrame:
        return report.reject_report(self.tagged)

    @property
    def audit(self) -> DataFrame:
        return report.step_audit(self.tagged, unreadable=self.unreadable)

    @property
    def reconciliation(self) -> DataFrame:
        return report.reconciliation(self.tagged, self.final, self.read, self.unreadable)

    @property
    def counts(self) -> DataFrame:
        found = report.named_counts(self.final, report.final_counters(self.settings.default_cell))
        if self.counted is None:
            return report.named_counts(self.tagged, report.run_counters(self.tagged)).unionByName(found)
        rows = [(name, self.counted[name]) for name in report.run_counters(self.tagged)]
        return self.tagged.sparkSession.createDataFrame(rows, "metric string, n_rows bigint").unionByName(found)

    @property
    def domains(self) -> DataFrame:
        return profile.domain_breakdown(self.tagged)

    @property
    def sales_types(self) -> DataFrame | None:
        column = headers.resolve(self.tagged.columns, headers.SALES_TYPE_NAMES)
        return profile.sales_type_breakdown(self.tagged, column) if column else None

    @property
    def exclusion_hits(self) -> DataFrame | None:
        """Records rejected because of an earlier list, per list; a VIN may be on several."""
        if self.listed is None:
            return None
        rejected = self.tagged.filter(F.col("reject_reason") == dedup.DUPLICATE_RECORD).select("vin")
        hits = dedup.exclusion_hits(rejected, self.listed).select(F.explode("sources").alias("source"))
        return hits.groupBy("source").agg(F.count("*").alias("n_rows"))

    @property
    def vin_profile(self) -> DataFrame:
        """Of the VINs as they were cleaned."""
        return profile.text_profile(self.tagged, F.col("vin"))

    @property
    def cell_report(self) -> DataFrame:
        return report.cell_report(self.final, report.year_channel_labels(self.settings.valid_years), description="desc")

    @property
    def missing_ucc(self) -> DataFrame:
        return enrich.unmatched_ucc_pairs(self.final)

    @property
    def missing_descriptions(self) -> DataFrame:
        return enrich.undescribed_cells(self.final)

    @property
    def invalid_dates(self) -> DataFrame:
        return report.invalid_date_rows(self.final)

    @property
    def default_cells(self) -> DataFrame:
        # the UCC look-up tidied the codes
        tidy = F.lit(self.settings.default_cell)
        return enrich.default_cell_rows(self.final, match_key(tidy))

    @property
    def panels(self) -> DataFrame:
        """E-mail records in the panel layout with the panel file each belongs to."""
        return panel.panel_files(panel.final_table(panel.with_chunks(self.final, self.settings.panel_size), self.settings.file_source))


def prepare(df: DataFrame, settings: Settings) -> DataFrame:
    """Canonical columns of the raw records, cleaned. Needs ``row_id`` and a header per column."""
    email = headers.resolve(df.columns, headers.EMAIL_NAMES, "email")
    zip_code = headers.resolve(df.columns, headers.ZIP_NAMES, "ZIP")
    vin = headers.resolve(df.columns, headers.VIN_NAMES, "VIN")
    df = headers.rename_mapped(df, {email: "email", zip_code: "zip_code", vin: "vin"})
    headers.check_columns(df, ["row_id", "address_line1", "city", "state", "purchase_date"])
    df = shape.build_name(df, settings.name_per_row)
    df = shape.fill_model_code(df)
    sales_type = headers.resolve(df.columns, headers.SALES_TYPE_NAMES)
    has_type = settings.check_sales_type and sales_type
    # two projections: what is derived from a cleaned text must not clean it again
    cleaned = df.withColumns(
        {
            **address_keys(),
            "email": clean_email(F.col("email")),
            "state": F.upper(strip(F.col("state"))),
            "zip_code": zip5(F.col("zip_code"), settings.strict_zip),
            "vin": clean_vin(F.col("vin")),
            "purch_lse": purchase_lease_code(F.col(sales_type)) if has_type else F.lit(1),
        }
    )
    segments = vin_segments(F.col("vin"))
    derived = cleaned.withColumns(
        {
            **segments,
            "zip2": zip2(F.col("zip_code")),
            "modyy": model_year(segments["vin10"]),
            "true_brand": prefix_brand(segments["vin13"], F.coalesce(F.col("brand"), F.lit("")) if "brand" in df.columns else None),
            "channel": cleaned_channel(F.col("email")),
        }
    )
    return panel.with_panel(derived)


def early_checks(settings: Settings) -> list[Check]:
    """Checks that run before the address duplicates."""
    return [
        validate.blank_name(F.col("name")),
        validate.bad_email(F.col("email"), settings.email_rules),
    ]


def late_checks(df: DataFrame, settings: Settings) -> list[Check]:
    """Checks that run after the address duplicates."""
    checks = []
    sales_type = headers.resolve(df.columns, headers.SALES_TYPE_NAMES)
    if settings.check_sales_type and sales_type:
        checks.append(validate.bad_sales_type(F.col(sales_type)))
    return [
        *checks,
        *validate.bad_geography(F.col("state"), F.col("zip_code"), settings.state_zip_rules),
        validate.business(df, settings.business_rules),
        validate.bad_vin(F.col("vin")),
        validate.bad_model_year(F.col("modyy"), settings.valid_years),
    ]


def tag(df: DataFrame, settings: Settings, exclusions: DataFrame | None = None, read: Counted | None = None) -> DataFrame:
    """All records with the step and the reason that rejected them; ``read`` counts them on the way.

    Both are NULL for the rows kept. Those have ``seq8``, their number in the list, and
    ``panel_row``, their number in the panel.
    """
    prepared = prepare(df, settings)
    early = early_checks(settings)
    late = late_checks(prepared, settings)
    outcomes = [(check.step, check.reason) for check in [*early, *late]]
    outcomes += [
        ("address_dedup", dedup.DUPLICATE_ADDRESS),
        ("dedup", dedup.DUPLICATE_VIN),
        ("dedup", dedup.DUPLICATE_RECORD),
    ]
    again_address, again_vin, listed_vin = range(len(outcomes) - 3, len(outcomes))
    first_early = validate.first_failure(early)
    first_late = validate.first_failure(late, len(early))

    narrow = prepared.select(
        "row_id", *dedup.KEYS, F.struct(F.when(first_late.isNull(), F.col("vin")).alias("vin"), "panel").alias("live"),
        first_early.isNull().alias("_alive"),
    )
    # the filter stays above the count
    narrow = (read.attach(narrow) if read else narrow).filter("_alive").drop("_alive")
    by_address = narrow.groupBy(*dedup.KEYS, dedup.lone_blank_key(settings.blank_is_duplicate)).agg(
        F.min("row_id").alias("row_id"), F.min_by("live", "row_id").alias("live")
    )
    # each of the two is read twice: by the next step, and for the outcome
    first_rows = materialise(by_address.select("row_id", *dedup.KEYS, "live.*"), "address-survivors")
    live = first_rows.filter("vin IS NOT NULL")
    first_vins = materialise(dedup.vin_survivors(live, exclusions, dedup.KEYS, ["panel"]), "vin-survivors")
    numbers = number_rows(
        first_vins.filter("NOT excluded"), ORDER, name="seq8", start=settings.start_number,
        group=["panel"], group_name="panel_row", groups=PANEL_COUNT,
    )
    met = prepared.withColumns({"_early": first_early, "_late": first_late}).join(
        reached(first_rows, first_vins.filter("excluded"), numbers), "row_id", "left"
    )
    place = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.col("_reached").isNull(), again_address)
        .when(F.col("_late").isNotNull(), F.col("_late"))
        .when(F.col("_reached") == FIRST_ADDRESS, again_vin)
        .when(F.col("_reached") == LISTED_VIN, listed_vin)
    )
    tagged = met.withColumn("_place", place).withColumns(validate.verdict(F.col("_place"), outcomes))
    return tagged.drop("_early", "_late", "_reached", "_place")


def reached(first_rows: DataFrame, listed: DataFrame, numbers: DataFrame) -> DataFrame:
    """How far each row came in the duplicate steps, and its numbers: one narrow row per ``row_id``.

    The whole rows meet this one table, which is already partitioned for that join.
    """
    none = F.lit(None).cast("bigint")
    stages = [
        first_rows.select("row_id", F.lit(FIRST_ADDRESS).alias("_reached"), none.alias("seq8"), none.alias("panel_row")),
        listed.select("row_id", F.lit(LISTED_VIN).alias("_reached"), none.alias("seq8"), none.alias("panel_row")),
        numbers.select("row_id", F.lit(IN_LIST).alias("_reached"), "seq8", "panel_row"),
    ]
    union = stages[0].unionByName(stages[1]).unionByName(stages[2])
    return union.groupBy("row_id").agg(*[F.max(name).alias(name) for name in ("_reached", "seq8", "panel_row")])


def enrich_kept(kept: DataFrame, settings: Settings, references: References) -> DataFrame:
    """Codes, flags and dates of the surviving records; same rows."""
    small = references.broadcast
    df = enrich.apply_vin_rules(kept, references.vin_rules, settings.default_cell, small["vin_rules"])
    df = enrich.add_ucc(df, references.ucc_master, broadcast=small["ucc_master"])
    df = enrich.add_electric(df, settings.whole_word_electric)
    df = enrich.add_description(df, references.description_master, small["description_master"])
    stamp = parse_purchase_date(F.col("purchase_date"), settings.date_layout)
    return df.withColumns(
        {"purchase_date": stamp, "MO Purch": purchase_month(stamp), "YR Purch": purchase_year(stamp)}
    )


def survivors(tagged: DataFrame) -> DataFrame:
    return validate.kept(tagged).drop("reject_step", "reject_reason")


def run(df: DataFrame, settings: Settings, references: References) -> Result:
    """The job. The tagged rows and the final list are written once and read by every output;
    the records are counted by the pass that looks for duplicates, the outcomes while the tagged
    rows are written."""
    read = Counted({"read": F.lit(True)})
    whole = tag(df, settings, references.exclusions, read)
    outcomes = Counted(report.run_counters(whole))
    tagged = materialise(outcomes.attach(whole), "tagged")
    counted = outcomes.of(tagged, "initial_count")
    final = materialise(enrich_kept(survivors(tagged), settings, references), "final")
    return Result(tagged, final, settings, read=read.seen("read"), counted=counted, listed=references.listed)
