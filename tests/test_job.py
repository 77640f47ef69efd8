from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from listprep.operators import report
from listprep.plans import ingest, job
from listprep.sources.files import check_paths, scan_csv

RECORDS = """﻿INDIVIDUAL_ID,FIRST_NM,LAST_NM,ADDR_LINE1,ADDR_LINE2,CITY,STATE,ZIP_CD,EFF_DT,VEH_ACQ_TYPE_CD,USA_VIN,MODEL_DESC,EMAIL_ADDR,,
1,Susan,One,1 Main St,,Town,MA,2459,2025-06-17-09.36.08.000000000   ,Retail,W1N4DA30PS0000001,GX1,a@gmail.com,u,v
2,Maria,Two,2 Main St,Unit 4,Town,MA,02459,2025-06-17-09.36.08.000000000   ,Lease,W1N4DA30PS0000002,,,u,v
3,Arie,Three,2 MAIN ST,Unit  4,TOWN,ma,02459,bad,Lease,W1N4DA30PS0000003,,x@y.com,u,v
4,Jo,LLC,4 Main St,,Town,MA,02459,bad,Lease,W1N4DA30PS0000004,,x@y.com,u,v
5,Al,Five,5 Main St,,Town,MA,02459,bad,Lease,w1n4da30ps0000005,,x@y.com,u,v,too,many
6,Ed,Six,6 Main St,,Town,MA,02459,bad,Lease,W1N4DA30PS0000006,,x@y.com,u,v
7,Di,Seven,7 Main St,,Town,MA,90001,bad,Lease,W1N4DA30PS0000007,,x@y.com,u,v
8,Di,Eight,8 Main St,,Town,MA,02459,bad,gift,W1N4DA30PS0000008,,x@y.com,u,v
9,José,Nine,9 Main St,,Town,MA,02459,n/a,purchase,W1N99999PS0000009,,x@aol.com,u,v
"""
COLUMN_MAP = """
columns: {first_nm: first_name, last_nm: last_name, addr_line1: address_line1, addr_line2: address_line2,
  zip_cd: zip_code, eff_dt: purchase_date, usa_vin: vin, email_addr: email, trim: trimline}
optional_columns: [extra1]
"""
VIN_RULES = """
default_cell_code: NOCELL
vin_mappings:
  - {vin13: W1N, vin48: 4DA30, vin10: S, cell: 11, brand: 290, desc: Any, modelid: ""}
  - {vin13: W1N, vin48: 4DA30, vin10: S, cell: 12, brand: 290, desc: Special, modelid: gx1}
"""


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("job")

    def file(name: str, text: str, encoding: str = "utf-8") -> str:
        (folder / name).write_text(text, encoding=encoding)
        return str(folder / name)

    return job.Inputs(
        manufacturer="Mercedes",
        records=file("records.csv", RECORDS),
        column_map=file("columns.yaml", COLUMN_MAP),
        vin_rule_files=[file("mercedes.yaml", VIN_RULES)],
        email_rules=file("email.yml", "full_domain_rejects: [bad.com]\npartial_matches: [noreply]\n"),
        state_zip_rules=file("zip.yml", "valid_combinations: {MA: ['01', '02']}\n"),
        business_terms=file("business.yml", "business_indicators: [LLC]\noem_manufacturers: [ford]\n"),
        ucc_master=file("ucc.csv", f"Cell,Year,UCC\n12,2025.0,{'1' * 21}\n"),
        description_master=file("desc.csv", "cell,Mailing Description\n12, Long \n"),
        output=str(folder / "out"),
        month="06",
        year="2025",
        start_number=100,
        exclusions=[file("earlier.csv", "VehicleID\nW1N4DA30PS0000006\n"), str(folder / "absent.csv")],
        row_key="individual_id",
    )


@pytest.fixture(scope="module")
def result(spark, inputs):
    return job.process(spark, inputs)


def test_verdicts(result):
    found = {r.row_id: r.reject_reason for r in result.tagged.collect()}
    assert found == {
        1: None, 2: None, 3: "Filter_Duplicate_Address", 4: "Business", 6: "Duplicate record", 7: "State/ZIP mismatch",
        8: "Invalid or missing sales type", 9: None,
    }


def test_final(result):
    first, second, last = result.final.orderBy("seq8").collect()
    assert (first.cell, first.ucc, first.description_long, first.seq8) == ("12", "1" * 21, "Long", 100)
    assert (first["MO Purch"], first["YR Purch"], first.zip_code, first.trimline) == ("06", "2025", "02459", None)
    assert (second.cell, second.purch_lse, second.channel, second.address_line1) == ("11", 2, "mail", "2 Main St Unit 4")
    assert (last.cell, last.name, last.panel, last.purchase_date) == ("NOCELL", "José Nine", "yahoo_aol", None)


def test_files(spark, inputs, result):
    folder = f"{inputs.output}/mercedes_06_2025"
    final = scan_csv(spark, f"{folder}/mercedes_06_2025_FINAL_OUTPUT")
    assert final.count() == 3 and final.filter(F.col("FILE SOURCE") == "records.csv").count() == 3
    assert scan_csv(spark, f"{folder}/mercedes_06_2025_mail").count() == 1
    assert scan_csv(spark, f"{folder}/panels").count() == 2
    bad = scan_csv(spark, f"{folder}/bad_lines").first()
    assert bad.line.startswith("5,Al") and bad.reason == "too many fields" and bad.file.endswith("records.csv") and int(bad.line_no) > 1
    assert spark.read.parquet(f"{folder}/rejects").count() == 5
    assert scan_csv(spark, f"{folder}/missing_ucc").count() == 2
    assert "status: Match" in "".join(r[0] for r in spark.read.text(f"{folder}/final_report").collect())


def test_missing_inputs_are_named(spark, inputs):
    with pytest.raises(ValueError, match="gone, none"):
        check_paths(spark, {"records": inputs.records, "gone": "/nowhere/x", "none": ""})


def test_other_manufacturers(spark, rows):
    jlr = {"legacy_mapping": {"columns": {"XBAPIBUS1006": "vin"}}, "current_mapping": {"columns": {}}, "optional_columns": ["extra1"]}
    df = ingest.standard_columns(rows(" XBAPIBUS1006, address_house_no, address_line1, modelcode", ("v", "1", "Main", "m")), "jlr", jlr)
    assert df.first().asDict() == {
        "vin": "v", "address_house_no": "1", "address_line1": "1 Main", "modelid": "m", "bodycode": "m", "extra1": None,
    }
    honda = ingest.standard_columns(rows("pid_id, zip5", ("p", "44236-1122")), "honda", {"columns": {"zip5": "zip_code"}}).first()
    assert (honda.extra1, honda.zip_code5, honda.zip4) == ("p", "44236", "1122")
    bmw = ingest.standard_columns(rows("Address_1, Home_Phone", (" 1  Main ", "5")), "bmw", {"columns": {}}).first()
    assert (bmw.address_line1, bmw.phone) == ("1 Main", "5")
    assert ingest.manufacturer_settings("Mercedes")["check_sales_type"] and not ingest.manufacturer_settings("mini")["check_sales_type"]


def test_reports_follow_the_settings_of_the_run(result):
    assert result.default_cells.count() == 1
    years = {name for name in result.cell_report.columns if name.startswith("Year ")}
    assert years == set(report.year_channel_labels(result.settings.valid_years))


def test_unreadable_lines_are_the_first_step(result):
    first = result.audit.orderBy("step_no").first()
    assert (first.step, first.rejected, first.records_before) == ("unreadable_line", 1, 9)
    counts = result.reconciliation.first()
    assert (counts.start_count, counts.total_removed, counts.final_count, counts.status) == (9, 6, 3, "Match")


def test_a_lost_record_is_a_mismatch(result):
    lost = replace(result, final=result.final.limit(2)).reconciliation.first()
    more = replace(result, read=result.read + 1).reconciliation.first()
    assert (lost.status, lost.final_count, more.status) == ("Mismatch", 2, "Mismatch")


def test_columns_are_checked_before_anything_is_written(spark, inputs, tmp_path):
    (tmp_path / "records.csv").write_text("id,name\n1,x\n")
    with pytest.raises(ValueError):
        job.process(spark, replace(inputs, records=str(tmp_path / "records.csv"), output=str(tmp_path / "out")))
    assert not (tmp_path / "out").exists()


def test_preflight(spark, inputs, result, tmp_path, caplog):
    fresh = replace(inputs, output=str(tmp_path / "out"))
    job.preflight(spark, replace(fresh, exclusions=("/nowhere/list.csv",)))
    assert "/nowhere/list.csv" in caplog.text and not list((tmp_path / "out").glob("*"))
    with pytest.raises(ValueError, match="there already"):
        job.preflight(spark, inputs)
    with pytest.raises(FileNotFoundError, match="no rule file"):
        job.preflight(spark, replace(fresh, manufacturer="nobody"))
    gone = [path.replace("mercedes", "MERCEDES") + ".gone/mercedes.yaml" for path in inputs.vin_rule_files]
    with pytest.raises(ValueError, match="vin_rules"):
        job.preflight(spark, replace(fresh, vin_rule_files=gone))
    (tmp_path / "file").write_text("x")
    with pytest.raises(ValueError, match="cannot be written"):
        job.preflight(spark, replace(fresh, output=str(tmp_path / "file" / "under")))
