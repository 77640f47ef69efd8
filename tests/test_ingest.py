import pytest
from pyspark.sql import functions as F

from conftest import column
from listprep.operators import enrich, shape
from listprep.plans import ingest
from listprep.sources import files, headers, masters, rules


def test_headers():
    assert headers.tidy_names(["﻿ A ", "b"]) == ["a", "b"]
    assert headers.first_of_each(["a", "b", "a"]) == [0, 1]
    assert headers.resolve(["X", "Zip"], headers.ZIP_NAMES) == "Zip"
    assert headers.resolve(["ZIP", "zip_code"], headers.ZIP_NAMES) == "zip_code"
    assert headers.resolve(["a"], headers.ZIP_NAMES) is None
    with pytest.raises(ValueError):
        headers.resolve(["a"], headers.EMAIL_NAMES, "email")
    assert headers.first_listed(["cell", "description", "desc"], headers.DESCRIPTION_NAMES) == "description"


def test_aliases_of_one_name_are_merged(rows):
    df = headers.rename_aliases(rows("row_id, ZIP_CODE, zip_code2, ModelCode, MODEL_DESC, bodycode", ("1", "a", "z", "m", "d", None)))
    assert df.columns == ["row_id", "ZIP", "zip_code2", "bodycode"]
    assert df.first()["bodycode"] == "m" and df.first()["ZIP"] == "a"
    assert headers.rename_aliases(rows("bodycode, MODEL_DESC", ("own", "d"))).first()[0] == "own"


def test_repeated_and_missing_columns(spark, rows):
    df = headers.drop_repeated(rows("a, b, c", ("1", "2", "3")), ["x", "y", "x"])
    assert df.columns == ["x", "y"] and tuple(df.first()) == ("1", "2")
    more = headers.add_missing(df, ["y", "z", "z"])
    assert more.columns == ["x", "y", "z"] and more.first()["z"] is None
    found = {tuple(r) for r in headers.header_differences(df, ["x", "w"]).collect()}
    assert found == {("w", "missing"), ("y", "unexpected")}
    with pytest.raises(ValueError):
        headers.check_columns(df, ["w"])


def test_layout_and_delimiter():
    assert files.choose_layout([" XBapiBus1006"], "old", "new") == "old"
    assert files.choose_layout(["other"], "old", "new") == "new"
    assert files.detect_delimiter("a;b;c,d") == ";"
    assert files.split_header('"a,b",c,', ",") == ["a,b", "c", "_c2"]


def test_scan_with_mark_and_unnamed_columns(spark, tmp_path):
    (tmp_path / "in.csv").write_text('﻿ID,Name,,\n1,"a, ""b""",x,y\n', encoding="utf-8")
    df = files.scan_csv(spark, str(tmp_path / "in.csv"))
    assert df.columns == ["ID", "Name", "_c2", "_c3"]
    assert tuple(df.first()) == ("1", 'a, "b"', "x", "y")


def test_lines_in_two_character_sets(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("id,name\n1,José\n".encode() + "2,José\n3,a,b\n4\n".encode("latin-1"))
    good, bad = files.split_bad_lines(files.scan_lines(spark, str(tmp_path / "in.csv")))
    assert sorted(map(tuple, good.collect())) == [("1", "José"), ("2", "José"), ("4", None)]
    assert [r[0] for r in bad.collect()] == ["3,a,b"]


def test_row_ids(spark, rows):
    assert column(files.with_row_id(rows("k", ("7",), ("8",)), "k"), "row_id") == [7, 8]
    numbered = files.with_row_id(spark.range(0, 1000, numPartitions=4).select(F.col("id").cast("string")))
    assert numbered.select("row_id").distinct().count() == 1000
    assert column(numbered, "id") == [str(n) for n in range(1000)]


def test_row_ids_follow_file_names(spark, tmp_path):
    for name, rows_in_file in (("a", 3), ("b", 500), ("c", 2)):
        lines = "".join(f"{name}{n:03}\n" for n in range(rows_in_file))
        (tmp_path / f"{name}.csv").write_text("k\n" + lines)
    numbered = files.with_row_id(files.split_bad_lines(files.scan_lines(spark, str(tmp_path)))[0])
    assert numbered.columns == ["k", "row_id"]
    keys = column(numbered, "k")
    assert len(keys) == 505 and keys == sorted(keys)


def test_blank_text_becomes_null(rows):
    assert tuple(files.blanks_to_null(rows("a, b", (" ", "x "))).first()) == (None, "x ")


def test_address_layouts(rows):
    house = rows("address_house_no, address_line1, address_house_no2", ("1", " Main  St", None))
    assert shape.consolidate_address(house, "house").first()["address_line1"] == "1 Main St"
    assert shape.consolidate_address(rows("address_1", (" A  B ",)), "split").first()["address_line1"] == "A B"
    two = rows("address_line1, address_line2", ("A", "Unit 2"))
    assert shape.consolidate_address(two, "two_line").first()["address_line1"] == "A Unit 2"
    one = rows("address_line1", (" A ",))
    assert shape.consolidate_address(one, "two_line").first()[0] == " A "
    assert shape.consolidate_address(two, "as_is").first()["address_line1"] == "A"


def test_name_parts(rows):
    assert shape.build_name(rows("first_name, last_name", ("A", None))).first()["name"] == "A"
    assert shape.build_name(rows("name_prefix, last_name", ("Dr", "B"))).first()["name"] == "B Dr"
    kept = shape.build_name(rows("name, first_name, last_name", (" ", "A", "B"), ("N", "C", "D")))
    assert sorted(r["name"] for r in kept.collect()) == [" ", "N"]
    filled = shape.build_name(rows("name, first_name, last_name", (" ", "A", "B"), (None, "C", "D")))
    assert sorted(r["name"] for r in filled.collect()) == ["A B", "C D"]
    per_row = shape.build_name(rows("name, first_name, last_name", (" ", "A", "B"), ("N", "C", "D")), per_row=True)
    assert sorted(r["name"] for r in per_row.collect()) == ["A B", "N"]
    assert shape.build_name(rows("x", ("1",))).first()["name"] == ""


def test_contact_and_model_columns(rows):
    assert shape.fill_phone(rows("home_phone, mobile_phone", ("2", " "))).first()["phone"] == "2"
    assert shape.fill_phone(rows("x", ("1",))).first()["phone"] is None
    extra = shape.fill_extra(rows("pid_id", ("9",)))
    assert extra.columns == ["extra1"] and extra.first()[0] == "9"
    assert shape.fill_model_code(rows("modelcode", ("m",))).columns == ["modelid", "bodycode"]
    assert shape.fill_model_code(rows("bodycode", ("m",))).first()["modelid"] == "m"
    assert shape.fill_model_code(rows("modelid", ("m",))).first()["bodycode"] == "m"
    assert shape.fill_model_code(rows("x", ("1",))).columns == ["x", "modelid", "bodycode"]


RULES = """
default_cell_code: ZZZ
vin_mappings:
  - {vin13: ABC, vin48: D12EF, vin10: 5, cell: 100, brand: 7, desc: Car, modelid: ""}
  - {vin13: ABC, vin48: D12EF, vin10: 5, cell: 200, brand: 7, desc: Car two}
"""


def test_rule_files(spark, tmp_path):
    path = tmp_path / "acme.yaml"
    path.write_text(RULES)
    table, default = rules.vin_rules(spark, rules.load_yaml(spark, str(path)))
    first, second = table.orderBy("ord").collect()
    assert default == "ZZZ" and (first.cell, first.vin10, second.modelid) == ("100", "5", None)
    assert rules.rule_file([str(path)], " ACME ") == str(path)
    assert rules.manufacturers(["/x/b.yaml", "/x/A.yaml"]) == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        rules.rule_file([str(path)], "other")


def test_rule_patterns(spark):
    config = {"business_indicators": ["CLUB", "L.C"], "oem_manufacturers": ["Ford"]}
    business = rules.BusinessRules.from_config(config)
    rules.check_patterns(spark, [business.indicator_pattern(), business.manufacturer_pattern(), None])
    with pytest.raises(ValueError):
        rules.check_patterns(spark, ["(unclosed"])
    assert rules.EmailRules.from_config({}).patterns() == []
    assert rules.StateZipRules.from_config({"valid_combinations": {"MA": ["01"]}}).pairs() == ["MA|01"]


def test_masters(spark, tmp_path):
    path = tmp_path / "ucc.csv"
    path.write_text("SRA Cell,Model Year,21 Digit,Empty\n a1 ,2025.0,123,\n,,,\nb2,24,,\nx,2024,1,,9,9\n")
    master = masters.read_master(spark, str(path))
    assert master.columns == ["sra cell", "model year", "21 digit"] and master.count() == 2
    found = {(r.cell, r.modyy, r.ucc) for r in masters.ucc_master(master).collect()}
    assert found == {("A1", 2025, "123"), ("B2", 2024, None)}
    empty = tmp_path / "empty.csv"
    empty.write_text("a,b\n,\n")
    with pytest.raises(ValueError):
        masters.read_master(spark, str(empty))


def test_description_master(rows):
    found = masters.description_master(rows("Cell, Mailing Description", (" a1.0", " text "), ("b", None))).collect()
    assert {(r.cell, r.description_long) for r in found} == {("A1", "text"), ("B", "")}
    with pytest.raises(ValueError):
        masters.description_master(rows("cell, other", ("a", "b")))


def test_exclusion_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("USA_VIN,x\nabc,1\n,2\nABC,3\n")
    (tmp_path / "b.csv").write_text("x;VehicleId\n1;def\n")
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    paths = [str(tmp_path / name) for name in ("a.csv", "b.csv", "c.csv", "absent.csv")]
    found, skipped = masters.read_exclusions(spark, paths)
    assert sorted(r[0] for r in found.collect()) == ["ABC", "DEF"]
    assert skipped == paths[2:]
    assert masters.read_exclusions(spark, paths[2:])[0] is None


def test_a_key_has_to_be_complete_and_unique(rows):
    for values in ((("7",), ("7",)), (("7",), (None,)), (("7",), ("x",))):
        with pytest.raises(ValueError, match="is no key"):
            files.with_row_id(rows("k", *values), "k")


def test_headerless_scan_keeps_the_fields_of_wider_lines(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes('1,V1\n2,V2,EXTRA\n3,"José, B"\n'.encode("latin-1"))
    found = files.scan_positional(spark, str(tmp_path / "in.csv"), {0: "id", 1: "vin"}, optional=["more"])
    assert found.columns == ["id", "vin", "col2", "more"]
    assert sorted(map(tuple, found.collect())) == [("1", "V1", None, None), ("2", "V2", "EXTRA", None), ("3", "José, B", None, None)]


def test_a_header_in_latin_1_is_no_record(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("id,Prénom\n1,José\n".encode("latin-1"))
    found = files.scan_lines(spark, str(tmp_path / "in.csv"))
    assert found.columns == ["id", "Prénom", "bad_line"] and found.count() == 1


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,name\n1,"two\nlines"\n2,one\n')
    assert {r.bad_line for r in files.scan_lines(spark, str(tmp_path / "in.csv")).collect()} == {'1,"two', 'lines"', None}
    scan = ingest.read_raw(spark, str(tmp_path / "in.csv"), "kia", {}, multi_line=True)
    assert scan.bad_lines.count() == 0
    assert sorted(map(tuple, scan.records.drop(files.PLACE).collect())) == [("1", "two\nlines"), ("2", "one")]


def test_the_first_row_of_a_master_is_the_first_by_file_name(spark, tmp_path, caplog):
    (tmp_path / "a.csv").write_text("cell,description\n12,first\n13,x,y\n")
    (tmp_path / "b.csv").write_text("cell,description\n12,second\n" + "".join(f"{n},d\n" for n in range(100, 3000)))
    master = masters.description_master(masters.read_ordered_master(spark, str(tmp_path)))
    assert enrich.unique_descriptions(master).filter("cell = '12'").first().description_long == "first"
    assert "1 lines" in caplog.text
