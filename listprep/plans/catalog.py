"""Registered queries: every operator over the derived records, one entry each."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, dates, email, geo, text, vin
from ..operators import dedup, enrich, numbering, panel, profile, report, shape, unify, validate
from ..sinks import ordered
from ..sources import files, headers, masters, records
from ..storage import materialise, new_path
from . import ingest, pipeline
from .derived import BUSINESS_RULES, EMAIL_RULES, SETTINGS, STATE_ZIP_RULES
from .derived import decode_sources, exclusion_tables, references, vehicle_sales

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def query(build: Query) -> Query:
    REGISTERED[build.__name__] = build
    return build


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.prepare(vehicle_sales(spark, sf_dir), SETTINGS)


def valid_vins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).filter(vin.is_vin(F.col("vin")))


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a valid VIN and model year, with their cell."""
    rows = valid_vins(spark, sf_dir).filter(F.col("modyy").isin(list(SETTINGS.valid_years)))
    tables = references(spark, sf_dir)
    return enrich.apply_vin_rules(rows, tables.vin_rules, SETTINGS.default_cell, tables.broadcast["vin_rules"])


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.tag(vehicle_sales(spark, sf_dir), SETTINGS, references(spark, sf_dir).exclusions)


def final(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = pipeline.survivors(tagged(spark, sf_dir))
    return pipeline.enrich_kept(kept, SETTINGS, references(spark, sf_dir))


# --- scalar functions and checks ---------------------------------------------------------


@query
def email_clean(spark, sf_dir):
    address = email.clean_email(F.col("email_addr"))
    return vehicle_sales(spark, sf_dir).select("row_id", address.alias("email"))


@query
def email_verdict(spark, sf_dir):
    rows = email_clean(spark, sf_dir)
    return validate.screen(rows, [validate.bad_email(F.col("email"), EMAIL_RULES)])


@query
def zip_normalize(spark, sf_dir):
    code, strict = geo.zip5(F.col("zip_code")), geo.zip5(F.col("zip_code"), strict=True)
    return vehicle_sales(spark, sf_dir).select(
        "row_id", code.alias("zip_code"), geo.zip2(code).alias("zip2"), strict.alias("strict_zip")
    )


@query
def zip_plus4(spark, sf_dir):
    five, four = geo.zip_plus4(F.col("zip_code"))
    return vehicle_sales(spark, sf_dir).select("row_id", five.alias("zip_code5"), four.alias("zip4"))


@query
def zip_counts(spark, sf_dir):
    rows = vehicle_sales(spark, sf_dir)
    return report.zip_counts(rows, F.col("zip_code"), geo.zip5(F.col("zip_code"), strict=True))


@query
def text_keys(spark, sf_dir):
    return vehicle_sales(spark, sf_dir).select(
        "row_id",
        text.match_key(F.col("state")).alias("state_key"),
        text.squeeze(F.concat("first_name", F.lit("  "), "last_name")).alias("squeezed"),
        text.drop_point_zero(F.col("vin")).alias("no_point_zero"),
        text.drop_invalid_utf8(F.col("last_name")).alias("readable"),
    )


@query
def name_build(spark, sf_dir):
    return shape.build_name(vehicle_sales(spark, sf_dir)).select("row_id", "name")


@query
def name_build_per_row(spark, sf_dir):
    some = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("Given "), "city")).otherwise(" ")
    return shape.build_name(vehicle_sales(spark, sf_dir).withColumn("name", some), per_row=True).select("row_id", "name")


@query
def blank_name(spark, sf_dir):
    rows = validate.screen(name_build(spark, sf_dir), [validate.blank_name(F.col("name"))])
    return validate.rejected(rows)


@query
def sales_type_verdict(spark, sf_dir):
    kind = F.col("veh_acq_type_cd")
    rows = vehicle_sales(spark, sf_dir).select("row_id", kind, codes.purchase_lease_code(kind).alias("purch_lse"))
    return validate.screen(rows, [validate.bad_sales_type(kind)])


@query
def sales_type_counts(spark, sf_dir):
    kind = F.coalesce(F.lower(text.strip(F.col("veh_acq_type_cd"))), F.lit("unknown"))
    return report.value_counts(vehicle_sales(spark, sf_dir), kind, "sales_type")


@query
def geo_verdict(spark, sf_dir):
    rows = vehicle_sales(spark, sf_dir).select(
        "row_id", F.upper(text.strip(F.col("state"))).alias("state"), geo.zip5(F.col("zip_code")).alias("zip_code")
    )
    return validate.screen(rows, validate.bad_geography(F.col("state"), F.col("zip_code"), STATE_ZIP_RULES))


@query
def geo_reason_counts(spark, sf_dir):
    return report.reason_counts(geo_verdict(spark, sf_dir))


@query
def business_verdict(spark, sf_dir):
    rows = shape.build_name(vehicle_sales(spark, sf_dir))
    name, first, last, city = (F.col(n) for n in ("name", "first_name", "last_name", "city"))
    return rows.select(
        "row_id",
        "name",
        validate.names_business(name, BUSINESS_RULES).alias("has_term"),
        validate.names_manufacturer(first, last, BUSINESS_RULES).alias("has_manufacturer"),
        validate.is_allowed(name, city, BUSINESS_RULES).alias("is_allowed"),
        validate.is_business(name, first, last, city, BUSINESS_RULES).alias("is_business"),
    )


@query
def vin_clean(spark, sf_dir):
    return vehicle_sales(spark, sf_dir).select("row_id", vin.clean_vin(F.col("vin")).alias("vin"))


@query
def vin_verdict(spark, sf_dir):
    rows = prepared(spark, sf_dir).select("row_id", "vin", "modyy")
    return validate.screen(rows, [validate.bad_vin(F.col("vin")), validate.bad_model_year(F.col("modyy"))])


@query
def vin_segments(spark, sf_dir):
    return valid_vins(spark, sf_dir).select("row_id", "vin13", "vin48", "vin10")


@query
def vin_model_year(spark, sf_dir):
    return valid_vins(spark, sf_dir).select("row_id", "vin10", F.col("modyy").alias("model_year"))


@query
def year_forms(spark, sf_dir):
    year = F.year(F.try_to_timestamp(F.substring("purchase_date", 1, 10), F.lit("yyyy-MM-dd"))).cast("string")
    forms = F.when(F.col("row_id") % 2 == 0, F.concat(year, F.lit(".0"))).otherwise(F.substring(year, 3, 2))
    return vehicle_sales(spark, sf_dir).select("row_id", vin.four_digit_year(forms).alias("modyy"))


@query
def wmi_brand(spark, sf_dir):
    brand = vin.prefix_brand(F.col("vin13"), F.col("city"))
    return valid_vins(spark, sf_dir).select("row_id", "vin13", brand.alias("true_brand"))


@query
def vin_length_profile(spark, sf_dir):
    return report.vin_length_profile(vehicle_sales(spark, sf_dir))


@query
def ev_flag(spark, sf_dir):
    rows = enrich.add_electric(vehicle_sales(spark, sf_dir))
    whole = codes.electric_flag([F.col("model")], whole_words=True)
    return rows.select("row_id", "model", "electric", whole.alias("electric_word"))


@query
def ev_listed(spark, sf_dir):
    rows = vehicle_sales(spark, sf_dir).withColumn("electric", F.lit("0")).select("row_id", "vin", "electric")
    listed = vehicle_sales(spark, sf_dir).filter("row_id % 7 = 1").select("vin")
    return enrich.add_listed_electric(rows, listed, "vin")


@query
def purchase_date_parts(spark, sf_dir):
    stamp = dates.parse_purchase_date(F.col("purchase_date"))
    rows = vehicle_sales(spark, sf_dir).select("row_id", stamp.alias("stamp"))
    return rows.select(
        "row_id",
        F.date_format("stamp", "yyyy-MM-dd HH:mm:ss").alias("purchased"),
        dates.purchase_month(F.col("stamp")).alias("MO Purch"),
        dates.purchase_year(F.col("stamp")).alias("YR Purch"),
    )


@query
def invalid_dates(spark, sf_dir):
    return report.invalid_date_rows(purchase_date_parts(spark, sf_dir)).select("row_id")


@query
def channel_split(spark, sf_dir):
    return panel.with_channel(email_clean(spark, sf_dir)).select("row_id", "channel")


@query
def domain_panel(spark, sf_dir):
    address = F.col("email")
    return email_clean(spark, sf_dir).select(
        "row_id",
        email.email_domain(address).alias("domain"),
        email.panel_of(address).alias("panel"),
        email.coarse_panel_of(address).alias("coarse_panel"),
    )


@query
def domain_counts(spark, sf_dir):
    return report.domain_counts(email_clean(spark, sf_dir))


# --- duplicates --------------------------------------------------------------------------


@query
def address_dedup_kept(spark, sf_dir):
    rows = vehicle_sales(spark, sf_dir).select("row_id", *geo.ADDRESS_KEYS.values())
    return dedup.split_duplicate_addresses(rows)[0].select("row_id", *dedup.KEYS)


@query
def address_dedup_rejected(spark, sf_dir):
    rows = vehicle_sales(spark, sf_dir).select("row_id", *geo.ADDRESS_KEYS.values())
    return dedup.split_duplicate_addresses(rows)[1].select("row_id", *dedup.KEYS, "drop_reason")


@query
def address_dedup_blanks_apart(spark, sf_dir):
    blank = F.col("row_id") % 3 == 0
    rows = vehicle_sales(spark, sf_dir).select(
        "row_id", *[F.when(~blank, F.col(n)).alias(n) for n in geo.ADDRESS_KEYS.values()]
    )
    return dedup.split_duplicate_addresses(rows, blank_is_duplicate=False)[0].select("row_id")


@query
def address_dup_groups(spark, sf_dir):
    return dedup.duplicate_address_groups(vehicle_sales(spark, sf_dir))


@query
def vin_dedup(spark, sf_dir):
    rows = valid_vins(spark, sf_dir).select("row_id", "vin", *dedup.KEYS)
    marked = dedup.mark_duplicate_vins(rows, references(spark, sf_dir).exclusions, dedup.KEYS)
    return marked.select("row_id", "vin", "dedup_reason")


@query
def exclusion_hits(spark, sf_dir):
    rows = valid_vins(spark, sf_dir).select("row_id", "vin", *dedup.KEYS)
    found = dedup.vin_survivors(rows, references(spark, sf_dir).exclusions, dedup.KEYS)
    return found.filter("excluded").select("row_id")


@query
def exclusion_hits_by_source(spark, sf_dir):
    """The lists every record is on; one of them is of other records for the greater part."""
    sales = vehicle_sales(spark, sf_dir)
    first, second = exclusion_tables(sales)
    foreign = sales.select(F.concat(F.lit("X"), vin.clean_vin(F.col("vin"))).alias("vin"))
    third = foreign.unionByName(sales.filter("row_id % 26 = 0").select(vin.clean_vin(F.col("vin")).alias("vin")))
    listed = masters.exclusion_sources({"earlier": first, "other": second, "third": third, "earlier again": first})
    rows = valid_vins(spark, sf_dir).select("row_id", "vin")
    hits = dedup.exclusion_hits(rows, listed).withColumn("sources", F.array_join("sources", ", "))
    return rows.join(hits, "vin").select("row_id", "vin", "sources")


@query
def exclusion_set(spark, sf_dir):
    return masters.exclusion_set(exclusion_tables(vehicle_sales(spark, sf_dir)))


# --- codes -------------------------------------------------------------------------------


@query
def vin_rule_lookup(spark, sf_dir):
    return coded(spark, sf_dir).select("row_id", "vin", "cell", "brand", "desc", "modelid")


@query
def vin_rule_lookup_large(spark, sf_dir):
    """The same lookup on the path for rule tables that are too large to broadcast."""
    rows = valid_vins(spark, sf_dir).filter(F.col("modyy").isin(list(SETTINGS.valid_years)))
    found = enrich.apply_vin_rules(rows, references(spark, sf_dir).vin_rules, SETTINGS.default_cell, broadcast=False)
    return found.select("row_id", "vin", "cell", "brand", "desc", "modelid")


@query
def brand_relookup(spark, sf_dir):
    rows = valid_vins(spark, sf_dir).select("row_id", *enrich.SEGMENTS)
    tables = references(spark, sf_dir)
    found = enrich.look_up_brand(rows, tables.vin_rules, tables.broadcast["vin_rules"])
    return found.select("row_id", "Brand", "Description")


@query
def default_cell_report(spark, sf_dir):
    return enrich.default_cell_rows(coded(spark, sf_dir), SETTINGS.default_cell)


@query
def ucc_missing(spark, sf_dir):
    return enrich.missing_ucc_pairs(coded(spark, sf_dir), references(spark, sf_dir).ucc_master)


@query
def ucc_enrich(spark, sf_dir):
    tables = references(spark, sf_dir)
    rows = enrich.add_ucc(coded(spark, sf_dir), tables.ucc_master, broadcast=tables.broadcast["ucc_master"])
    return rows.select("row_id", "cell", "modyy", "ucc", codes.spreadsheet_text(F.col("ucc")).alias("ucc_text"))


@query
def ucc_unmatched(spark, sf_dir):
    return enrich.unmatched_ucc_pairs(ucc_enrich(spark, sf_dir))


@query
def ucc_upsert(spark, sf_dir):
    return dedup.upsert_master(references(spark, sf_dir).ucc_master, ucc_missing(spark, sf_dir))


@query
def desc_enrich(spark, sf_dir):
    tables = references(spark, sf_dir)
    small = tables.broadcast["description_master"]
    rows = enrich.add_description(coded(spark, sf_dir), tables.description_master, small)
    return rows.select("row_id", "cell", "description_long")


@query
def desc_missing(spark, sf_dir):
    return enrich.undescribed_cells(desc_enrich(spark, sf_dir))


# --- numbers -----------------------------------------------------------------------------


@query
def sequence_numbers(spark, sf_dir):
    rows = vehicle_sales(spark, sf_dir).select("row_id", *[e.alias(k) for k, e in geo.address_keys().items()])
    return numbering.number_rows(rows, pipeline.ORDER, start=501).select("row_id", "seq8")


def numbered_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vehicle_sales(spark, sf_dir).select(
        "row_id", email.clean_email(F.col("email_addr")).alias("email"), *[e.alias(k) for k, e in geo.address_keys().items()]
    )
    rows = panel.with_panel(panel.with_channel(rows))
    return panel.with_chunks(numbering.number_rows(rows, pipeline.ORDER, group=["panel"], groups=pipeline.PANEL_COUNT))


@query
def panel_chunks(spark, sf_dir):
    return numbered_panels(spark, sf_dir).select("row_id", "panel", "panel_row", "chunk", "n_chunks")


@query
def panel_sizes(spark, sf_dir):
    return report.panel_sizes(numbered_panels(spark, sf_dir))


@query
def vin_batches(spark, sf_dir):
    return numbering.vin_batches(unify.prepare_vins(vehicle_sales(spark, sf_dir)))


# --- whole job ---------------------------------------------------------------------------

FINAL_COLUMNS = (
    "row_id", "seq8", "name", "email", "zip_code", "vin", "modyy", "true_brand", "cell", "brand", "desc", "modelid",
    "ucc", "electric", "description_long", "MO Purch", "YR Purch", "channel", "panel", "panel_row", "purch_lse",
)


@query
def full_job(spark, sf_dir):
    return final(spark, sf_dir).select(*FINAL_COLUMNS)


@query
def reject_report(spark, sf_dir):
    return report.reject_report(tagged(spark, sf_dir)).select("row_id", "reject_step", "reject_reason", "rejection_source")


@query
def reject_reason_counts(spark, sf_dir):
    return report.reason_counts(tagged(spark, sf_dir))


@query
def step_audit(spark, sf_dir):
    return report.step_audit(tagged(spark, sf_dir))


@query
def reconciliation(spark, sf_dir):
    return report.reconciliation(tagged(spark, sf_dir))


@query
def run_counters(spark, sf_dir):
    rows = tagged(spark, sf_dir)
    return report.named_counts(rows, report.run_counters(rows))


@query
def vin_profile(spark, sf_dir):
    return profile.text_profile(vehicle_sales(spark, sf_dir), F.col("vin"))


@query
def domain_breakdown(spark, sf_dir):
    return profile.domain_breakdown(tagged(spark, sf_dir))


@query
def sales_type_breakdown(spark, sf_dir):
    return profile.sales_type_breakdown(tagged(spark, sf_dir), "veh_acq_type_cd")


@query
def cellcode_pivot(spark, sf_dir):
    return report.cell_report(panel.with_channel(coded(spark, sf_dir)), description="desc")


@query
def panel_totals(spark, sf_dir):
    return report.panel_totals(pipeline.survivors(tagged(spark, sf_dir)))


@query
def final_table(spark, sf_dir):
    table = panel.final_table(final(spark, sf_dir), SETTINGS.file_source)
    return table.select(
        "row_id", "EMAIL", "DOMAIN", "MFG MODEL CODE", "ROTATION", "VERSION", "FILE SOURCE", "EXTERNALREFERENCE", "PHONE",
        "Brand", "Description",
    )


def channel_outputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return panel.split_channels(panel.final_table(final(spark, sf_dir), SETTINGS.file_source))


@query
def panel_layout_email(spark, sf_dir):
    return channel_outputs(spark, sf_dir)[0]


@query
def panel_layout_mail(spark, sf_dir):
    return channel_outputs(spark, sf_dir)[1]


@query
def panel_files(spark, sf_dir):
    # read twice: for the panel totals, and for the rows
    chunked = panel.with_chunks(materialise(final(spark, sf_dir), "final"))
    return panel.panel_files(panel.final_table(chunked, SETTINGS.file_source)).drop("panel")


@query
def final_in_order(spark, sf_dir):
    """The final table as its files say it, read by name: ``n`` is the place of a row in the list."""
    table = panel.final_table(final(spark, sf_dir), SETTINGS.file_source).select("row_id", "EXTERNALREFERENCE", "EMAIL")
    path = ordered.write_final(table, new_path(spark, "final"), "Acme", "06", "2025")
    read = files.with_row_id(files.scan_csv(spark, path).withColumnRenamed("row_id", "record"))
    return numbering.number_rows(read, ["row_id"], name="n").select("n", "record", "EXTERNALREFERENCE", "EMAIL")


@query
def panel_file_index(spark, sf_dir):
    """Names and sizes of panel files of 100 rows, as they were found after writing."""
    chunked = panel.with_chunks(materialise(final(spark, sf_dir), "final"), 100)
    rows = panel.panel_files(panel.final_table(chunked, SETTINGS.file_source))
    return ordered.write_panels(rows, new_path(spark, "panel-files"), "acme_06_2025", 100)


# --- several decoders --------------------------------------------------------------------


@query
def vin_prepare(spark, sf_dir):
    return unify.prepare_vins(vehicle_sales(spark, sf_dir))


@query
def vin_problems(spark, sf_dir):
    return unify.vin_problems(vehicle_sales(spark, sf_dir))


@query
def vin_decode(spark, sf_dir):
    tables = references(spark, sf_dir)
    vins = unify.prepare_vins(vehicle_sales(spark, sf_dir))
    return unify.decode_vins(vins, tables.vin_rules, tables.broadcast["vin_rules"])


@query
def unify_sources(spark, sf_dir):
    return unify.unify_sources(decode_sources(vehicle_sales(spark, sf_dir)))


@query
def source_conflicts(spark, sf_dir):
    return unify.source_conflicts(decode_sources(vehicle_sales(spark, sf_dir)))


@query
def main_secondary_merge(spark, sf_dir):
    sources = decode_sources(vehicle_sales(spark, sf_dir))
    return unify.merge_main_secondary(sources["b"], sources["c"])


# --- ingest ------------------------------------------------------------------------------


@query
def column_aliases(spark, sf_dir):
    raw = vehicle_sales(spark, sf_dir).select(
        "row_id",
        F.when(F.col("row_id") % 2 == 0, F.col("zip_code")).alias("zip_code"),
        F.col("bodycode").alias("MODEL_DESC"),
        F.col("model").alias("ModelDescription"),
        F.col("vin").alias("CELL"),
        F.col("city"),
    )
    return headers.rename_aliases(raw)


@query
def address_consolidation(spark, sf_dir):
    line = F.col("address_line1")
    raw = vehicle_sales(spark, sf_dir).select(
        "row_id", line.alias("kept_line"), line.alias("address_1"), F.concat(F.lit("  Unit   "), "city").alias("address_2")
    )
    split = shape.consolidate_address(raw, "split").select(
        "row_id", line.alias("split_line"), F.col("kept_line").alias("address_line1"), F.lit("No 7").alias("address_house_no")
    )
    return shape.consolidate_address(split, "house").select("row_id", "split_line", line.alias("house_line"))


@query
def contact_columns(spark, sf_dir):
    row = F.col("row_id")
    raw = vehicle_sales(spark, sf_dir).select(
        "row_id",
        F.when(row % 4 == 0, F.col("vin")).otherwise(" ").alias("mobile_phone"),
        F.when(row % 3 == 0, F.col("city")).alias("home_phone"),
        F.when(row % 5 == 0, F.col("model")).alias("extra1"),
        F.col("state").alias("pid_id"),
        F.col("bodycode"),
    )
    filled = shape.fill_model_code(shape.fill_extra(shape.fill_phone(raw)))
    return filled.select("row_id", "phone", "extra1", "modelid")


CSV_COLUMNS = ("row_id", "first_name", "last_name", "email_addr", "address_line1", "state", "zip_code", "vin")


def written_csv(df: DataFrame, name: str, header: bool = True, **options) -> str:
    path = new_path(df.sparkSession, name)
    exact = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    df.write.options(header=header, **exact, **options).csv(path)
    return path


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vehicle_sales(spark, sf_dir).select(*CSV_COLUMNS)
    return rows.withColumn("row_id", F.col("row_id").cast("string"))


@query
def csv_scan(spark, sf_dir):
    """Header clean-up on a scanned CSV: case, stray blanks, a repeated name."""
    rows = text_rows(spark, sf_dir).select(
        F.col("row_id").alias("Row_ID "), F.col("vin").alias("USA_VIN"), F.col("state").alias(" State"), F.col("zip_code").alias("ZIP_CD")
    )
    scanned = files.scan_csv(spark, written_csv(rows, "csv"))
    named = headers.drop_repeated(scanned, headers.tidy_names(scanned.columns))
    mapped = headers.rename_mapped(named, {"usa_vin": "vin", "zip_cd": "zip_code"})
    return files.with_row_id(headers.add_missing(mapped, ["extra1"]), "row_id")


@query
def positional_columns(spark, sf_dir):
    path = written_csv(text_rows(spark, sf_dir).select("row_id", "vin", "state"), "positional", header=False)
    return files.scan_positional(spark, path, {0: "row_id", 1: "vin"}, optional=["extra1"])


@query
def csv_layout(spark, sf_dir):
    rows = text_rows(spark, sf_dir).select("row_id", F.col("vin").alias("XBAPIBUS1006"), F.col("zip_code").alias("PLZ"))
    scanned = files.scan_csv(spark, written_csv(rows, "layout"))
    layout = files.choose_layout(
        scanned.columns, legacy={"XBAPIBUS1006": "vin", "PLZ": "zip_code"}, current={"XBAPIBUS1006": "order_no"}
    )
    return headers.rename_mapped(scanned, layout)


@query
def csv_mixed_encoding(spark, sf_dir):
    """Some files in UTF-8, some in Latin-1; every line is decoded on its own."""
    rows = text_rows(spark, sf_dir).select("row_id", F.concat(F.lit("José Müller "), "row_id").alias("name"))
    folder = new_path(spark, "encodings")
    for name, part, encoding in (("utf8", 0, "UTF-8"), ("latin1", 1, "ISO-8859-1")):
        half = rows.filter(F.pmod(F.col("row_id").cast("bigint"), F.lit(2)) == part)
        half.write.options(header=True, encoding=encoding).csv(f"{folder}/{name}")
    good, _ = files.split_bad_lines(files.scan_lines(spark, f"{folder}/*"))
    return good


def ragged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.col("row_id")
    line = (
        F.when(row % 13 == 0, F.concat(row.cast("string"), F.lit(',"a,b",c,d')))
        .when(row % 17 == 0, row.cast("string"))
        .otherwise(F.concat(row.cast("string"), F.lit(',"x,""y""",z')))
    )
    path = new_path(spark, "ragged")
    vehicle_sales(spark, sf_dir).select(line.alias("value")).write.text(path)
    return files.scan_lines(spark, path, sep=",", names=["row_id", "middle", "last"])


@query
def csv_good_lines(spark, sf_dir):
    return files.split_bad_lines(ragged_lines(spark, sf_dir))[0]


@query
def csv_bad_lines(spark, sf_dir):
    return files.split_bad_lines(ragged_lines(spark, sf_dir))[1]


@query
def exclusion_files(spark, sf_dir):
    """Files with different headers and delimiters; one is missing and one has no VINs."""
    first, second = exclusion_tables(vehicle_sales(spark, sf_dir))
    paths = [
        written_csv(first.withColumn("note", F.lit("n")), "earlier"),
        written_csv(second.withColumn("note", F.lit("n")), "other", sep=";"),
        new_path(spark, "absent"),
        written_csv(vehicle_sales(spark, sf_dir).select("city"), "no-vin"),
    ]
    return masters.read_exclusions(spark, paths)[0]


@query
def master_scan(spark, sf_dir):
    """A UCC master from CSV, with an empty column, empty rows and other headers."""
    rows = references(spark, sf_dir).ucc_master
    raw = rows.select(
        F.concat(F.lit(" "), "cell").alias("SRA Cell"), F.concat(F.col("modyy").cast("string"), F.lit(".0")).alias("Model Year"),
        F.col("ucc").alias("21 Digit"), F.lit(None).cast("string").alias("Notes"), F.col("ord").cast("string").alias("Line"),
    )
    path = written_csv(raw, "master", nullValue="", emptyValue="")
    return masters.ucc_master(masters.read_master(spark, path), "line").select("ord", "cell", "modyy", "ucc")


@query
def ingest_columns(spark, sf_dir):
    """A raw file with its own headers and a two-line address, as standard columns."""
    rows = text_rows(spark, sf_dir).join(
        vehicle_sales(spark, sf_dir).select(F.col("row_id").cast("string"), "city", "purchase_date"), "row_id"
    )
    raw = rows.select(
        F.col("row_id").alias("ORDER_NO"),
        F.col("first_name").alias("FIRST_NM"),
        F.col("address_line1").alias("ADDR_LINE1"),
        F.when(F.col("state") == "TX", F.concat(F.lit(" Unit "), "row_id")).alias("ADDR_LINE2"),
        F.col("zip_code").alias("ZIP_CODE"),
        F.col("vin").alias("MODEL_DESC"),
        F.col("vin").alias("USA_VIN"),
        F.col("email_addr").alias("EMAIL_ADDR"),
        F.col("city").alias("Town"),
        F.col("state").alias(" STATE_CD "),
        F.col("purchase_date").alias("EFF_DT"),
    )
    config = {
        "columns": {
            "first_nm": "first_name", "addr_line1": "address_line1", "addr_line2": "address_line2", "phone_no": "phone",
            "town": "city", "state_cd": "state", "eff_dt": "purchase_date",
        },
        "optional_columns": ["extra1"],
    }
    scanned = ingest.read_raw(spark, written_csv(raw, "raw"), "mercedes", config)
    return ingest.ingest(scanned.records, "mercedes", config, key="order_no")


@contextmanager
def small_splits(spark: SparkSession, size: int):
    """Files are cut into splits of at most that many bytes."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Lines of one written file, the work of one task, where there are more than the least number of files.
FILE_LINES = 500_000
#: Splits that files written for a query are cut into, where these are neither very small nor very large.
MANY_SPLITS = 256


def written_lines(df: DataFrame, line: Column, path: str, n_files: int = 2, header: str | None = None, charset: str = "UTF-8") -> str:
    """Text files of one line per row, as they are, in the order of ``row_id``, each with the header;
    ``n_files``, or more where they would grow beyond ``FILE_LINES``."""
    n_files = max(n_files, -(-df.count() // FILE_LINES))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(files.SPLIT_ROWS - 1)) == 0
    # the lines, not the rows, are sorted
    ordered = df.select("row_id", line.alias("_line")).repartitionByRange(n_files, "row_id").sortWithinPartitions("row_id")
    value = F.when(first, F.concat(F.lit(f"{header}\n"), F.col("_line"))).otherwise(F.col("_line")) if header else F.col("_line")
    ordered.select(F.encode(value, charset).cast("string").alias("value")).write.text(path)
    return path


def split_bytes(spark: SparkSession, folder: str, least: int = 4096, most: int = 128 << 20) -> int:
    """The size of splits that cuts the files of a folder into some ``MANY_SPLITS``."""
    system, place = files.file_system(spark, folder)
    return min(max(least, system.getContentSummary(place).getLength() // MANY_SPLITS), most)


@query
def quoted_line_breaks(spark, sf_dir):
    """Fields over several lines, in files of two character sets that are cut into many splits.

    Their number is bounded, as each is a task of every pass over the lines.
    """
    row = F.col("row_id")
    note = F.when(row % 3 == 0, F.concat(F.lit('"Zürich\n, ""'), row, F.lit('""\n\nend"'))).when(row % 3 == 1, '5" pipe').otherwise('""')
    line, folder = F.concat_ws(",", row, note, F.col("city")), new_path(spark, "quoted-breaks")
    for part, charset in enumerate(("UTF-8", "ISO-8859-1")):
        half = vehicle_sales(spark, sf_dir).filter(row % 2 == part)
        written_lines(half, line, f"{folder}/{charset}", header="row_id,note,city", charset=charset)
    with small_splits(spark, split_bytes(spark, folder)):
        scan = records.scan_records(spark, f"{folder}/*", quoted_breaks=True)
        return materialise(scan.records.drop(files.PLACE), "read-quoted")


@query
def mixed_headers(spark, sf_dir):
    """Files of one folder whose headers have other columns in another order."""
    rows = text_rows(spark, sf_dir)
    folder, part = new_path(spark, "mixed-headers"), F.pmod(F.col("row_id").cast("bigint"), F.lit(3))
    kinds = (
        ("row_id", F.col("vin").alias("VIN"), F.col("zip_code").alias("zip")),
        ("row_id", F.col("zip_code").alias("zip"), F.col("vin").alias(" vin")),
        (F.col("state").alias("st"), F.col("row_id"), F.col("vin").alias("Vin")),
    )
    exact = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    for k, kind in enumerate(kinds):
        rows.filter(part == k).select(*kind).write.options(**exact).csv(f"{folder}/{k}")
    return records.scan_records(spark, f"{folder}/*").records.drop(files.PLACE)


def _positional_lines(spark: SparkSession, sf_dir: str) -> records.Scan:
    row = F.col("row_id")
    line = F.when(row % 7 == 0, F.concat_ws(",", row, F.lit('"'), "vin")).otherwise(F.concat_ws(",", row, "vin", F.lit('5" x')))
    path = written_lines(vehicle_sales(spark, sf_dir), line, new_path(spark, "positional-lines"), n_files=1)
    return records.scan_records(spark, path, ",", positions={0: "row_id", 1: "vin"}, parts=True)


@query
def positional_bad_lines(spark, sf_dir):
    """Lines of a file without header that leave a quote open, with their numbers in the file,
    which comes in parts when it is large."""
    return _positional_lines(spark, sf_dir).bad_lines.select("line_no", "reason", "line")


@query
def positional_records(spark, sf_dir):
    return _positional_lines(spark, sf_dir).records.drop(files.PLACE)


@query
def audit_with_bad_lines(spark, sf_dir):
    """The audit of a run from raw lines, some with a field too many, some with an open quote."""
    sales = vehicle_sales(spark, sf_dir)
    fields = [F.coalesce(F.concat(F.lit('"'), F.col(name).cast("string"), F.lit('"')), F.lit("")) for name in sales.columns]
    row, line = F.col("row_id"), F.concat_ws(",", *fields)
    line = F.when(row % 97 == 0, F.concat(line, F.lit(",more"))).when(row % 101 == 0, F.regexp_replace(line, '"$', "")).otherwise(line)
    path = written_lines(sales, line, new_path(spark, "raw-lines"), 3, header=",".join(sales.columns))
    scan = records.scan_records(spark, path)
    table = files.with_row_id(files.blanks_to_null(scan.records), "row_id")
    listed = F.col("row_id") % 11 * (F.col("row_id") % 13) == 0
    exclusions = table.filter(listed).select(vin.clean_vin(F.col("vin")).alias("vin")).dropna().distinct()
    return report.step_audit(pipeline.tag(table, SETTINGS, exclusions), unreadable=scan.bad_lines.count())
