"""One manufacturer's run from files to files."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..operators import panel, profile, report
from ..operators.numbering import PANEL_SIZE
from ..operators.validate import require_rows
from ..sinks import files as sinks
from ..sinks import ordered
from ..sources import files, masters, rules
from ..storage import materialise
from . import ingest, pipeline

log = logging.getLogger(__name__)

#: Lines of a breakdown in the report; the tables beside it are whole.
MOST_FREQUENT = 20


@dataclass(frozen=True)
class Inputs:
    """Paths of a run; any file system that Spark reaches."""

    manufacturer: str
    records: str
    column_map: str
    vin_rule_files: Sequence[str]
    email_rules: str
    state_zip_rules: str
    business_terms: str
    ucc_master: str
    description_master: str
    output: str
    month: str
    year: str
    start_number: int
    exclusions: Sequence[str] = ()
    row_key: str | None = None
    multi_line: bool = False
    panel_base: str = ""
    panel_size: int = PANEL_SIZE

    def required_paths(self) -> dict[str, str]:
        names = (
            "records", "column_map", "email_rules", "state_zip_rules", "business_terms", "ucc_master", "description_master",
        )
        return {name: getattr(self, name) for name in names}


def load_settings(spark: SparkSession, inputs: Inputs) -> tuple[pipeline.Settings, DataFrame]:
    """Settings from the rule files, and the VIN rules."""
    vin_rules, default_cell = rules.vin_rules(
        spark, rules.load_yaml(spark, rules.rule_file(inputs.vin_rule_files, inputs.manufacturer))
    )
    settings = pipeline.Settings(
        **ingest.manufacturer_settings(inputs.manufacturer),
        email_rules=rules.EmailRules.from_config(rules.load_yaml(spark, inputs.email_rules)),
        state_zip_rules=rules.StateZipRules.from_config(rules.load_yaml(spark, inputs.state_zip_rules)),
        business_rules=rules.BusinessRules.from_config(rules.load_yaml(spark, inputs.business_terms)),
        default_cell=default_cell,
        start_number=inputs.start_number,
        file_source=inputs.records.rstrip("/").rsplit("/", 1)[-1],
        panel_size=inputs.panel_size,
    )
    business = settings.business_rules
    rules.check_patterns(
        spark, [*settings.email_rules.patterns(), business.indicator_pattern(), business.manufacturer_pattern()]
    )
    return settings, vin_rules


def preflight(spark: SparkSession, inputs: Inputs) -> None:
    """Everything that can be known before the first job: inputs, the manufacturer's rule file,
    the output (S12). Earlier lists that are not there are left out, and said so in the log."""
    rule_file = rules.rule_file(inputs.vin_rule_files, inputs.manufacturer)
    files.check_paths(spark, {**inputs.required_paths(), "vin_rules": rule_file})
    for path in inputs.exclusions:
        if not files.is_there(spark, path):
            log.warning("exclusion file %s is not there", path)
    files.check_output(spark, f"{inputs.output.rstrip('/')}/{sinks.run_name(inputs.manufacturer, inputs.month, inputs.year)}")


def process(spark: SparkSession, inputs: Inputs) -> pipeline.Result:
    """Read, run, and write every output under ``inputs.output``."""
    preflight(spark, inputs)
    settings, vin_rules = load_settings(spark, inputs)
    config = rules.load_yaml(spark, inputs.column_map)
    scan = ingest.read_raw(spark, inputs.records, settings.manufacturer, config, inputs.multi_line)
    records = ingest.ingest(scan.records, settings.manufacturer, config, inputs.row_key)
    listed, _ = masters.read_exclusion_sources(spark, inputs.exclusions)
    references = pipeline.References(
        vin_rules=vin_rules,
        ucc_master=masters.ucc_master(masters.read_ordered_master(spark, inputs.ucc_master)),
        description_master=masters.description_master(masters.read_ordered_master(spark, inputs.description_master)),
        exclusions=listed and listed.select("vin"),
        listed=listed,
    )
    result = pipeline.run(records, settings, references)
    require_rows(result.final)
    folder = run_folder(inputs, settings)
    bad_lines = materialise(scan.bad_lines, "bad-lines")
    sinks.write_csv(bad_lines, f"{folder}/bad_lines")
    result = replace(result, unreadable=bad_lines.count())
    write(spark, inputs, settings, result)
    return result


def run_folder(inputs: Inputs, settings: pipeline.Settings) -> str:
    return f"{inputs.output.rstrip('/')}/{sinks.run_name(settings.manufacturer, inputs.month, inputs.year)}"


def write(spark: SparkSession, inputs: Inputs, settings: pipeline.Settings, result: pipeline.Result) -> None:
    base = sinks.run_name(settings.manufacturer, inputs.month, inputs.year)
    folder = run_folder(inputs, settings)
    final = panel.final_table(result.final, settings.file_source)
    ordered.write_final(final, folder, settings.manufacturer, inputs.month, inputs.year, spreadsheet_ucc=True)
    ordered.write_channels(*panel.split_channels(final), folder, base, spreadsheet_ucc=True)
    ordered.write_panels(result.panels, f"{folder}/panels", inputs.panel_base or base, settings.panel_size)
    sinks.write_rejects(result.tagged, f"{folder}/rejects")
    breakdowns = {"E-mail domains": materialise(result.domains, "domains")}
    if (sales_types := result.sales_types) is not None:
        breakdowns["Sales types"] = materialise(sales_types, "sales-types")
    if (hits := result.exclusion_hits) is not None:
        sinks.write_csv(hits, f"{folder}/exclusion_hits")
    for name, table in {
        "cellcode_report": result.cell_report,
        "missing_cell_codes": result.default_cells,
        "missing_ucc": result.missing_ucc,
        "missing_descriptions": result.missing_descriptions,
        "invalid_dates": result.invalid_dates,
        "vin_profile": result.vin_profile,
        **{f"{title.lower().replace(' ', '_')}": table for title, table in breakdowns.items()},
    }.items():
        sinks.write_csv(table, f"{folder}/{name}")
    sinks.write_counts(result.counts, f"{folder}/pipeline_summary")
    text = report.markdown(
        result.audit, result.reconciliation, result.counts, settings.manufacturer.title(),
        f"{inputs.month}/{inputs.year}", settings.start_number,
        {title: profile.most(table, MOST_FREQUENT) for title, table in breakdowns.items()},
    )
    sinks.write_text(spark, text, f"{folder}/final_report")
