from datetime import datetime

import pytest
from pyspark.sql import functions as F

from listprep.functions import codes, dates, email, geo, text, vin


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, *values, **options):
        df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
        return [row[0] for row in df.select("n", function(F.col("v"), **options).alias("r")).orderBy("n").select("r").collect()]

    return run


def test_strip_removes_every_white_space(apply):
    assert apply(text.strip, "\t a b \n", "   ", None) == ["a b", "", None]


def test_squeeze(apply):
    assert apply(text.squeeze, "  a \t b\n", None) == ["a b", None]


def test_blank(apply):
    assert apply(text.is_blank, None, "", " 　", "x") == [True, True, True, False]
    assert apply(text.blank_to_null, " ", " x ") == [None, "x"]


def test_cell_key(apply):
    assert apply(text.cell_key, " a12.0", "b.05", None) == ["A12", "B.05", None]


def test_invalid_utf8_is_dropped(spark):
    df = spark.sql("SELECT CAST(X'4A6F73E9' AS STRING) AS v UNION ALL SELECT 'José'")
    assert sorted(r[0] for r in df.select(text.drop_invalid_utf8(F.col("v"))).collect()) == ["Jos", "José"]


def test_email(apply):
    assert apply(email.clean_email, "  A@B.Com ", None) == ["a@b.com", None]
    assert apply(email.email_domain, "a@b@c.com", "none", None) == ["c.com", "unknown", "unknown"]
    assert apply(email.panel_of, "a@googlemail.com", "a@rocketmail.com", "a@x.com", None) == ["gmail", "yahoo_aol", "other", "other"]
    assert apply(email.coarse_panel_of, "a@googlemail.com", "a@aol.com") == ["other", "yahoo/aol"]
    assert apply(email.channel_of, None, " ", "NaN", "a@b.c") == ["mail", "mail", "mail", "email"]


def test_zip5(apply):
    values = ("2459", " 78704 ", "900641234", "44236-1122", "K1A 0B1", "", None)
    assert apply(geo.zip5, *values) == ["02459", "78704", "90064", "44236", None, None, None]
    assert apply(geo.zip5, *values, strict=True) == ["02459", "78704", "90064", None, None, None, None]


def test_zip_plus4(spark):
    df = spark.createDataFrame([("900641234",), ("44236-1122",), ("78704",), (None,)], "v string")
    five, four = geo.zip_plus4(F.col("v"))
    assert [tuple(r) for r in df.select(five, four).collect()] == [
        ("90064", "1234"), ("44236", "1122"), ("78704", None), (None, None),
    ]


def test_vin(apply):
    assert apply(vin.clean_vin, " w1n-ab.0", "123.0", "1.0.0", None) == ["W1NAB", "123", "10", None]
    assert apply(vin.is_vin, "W1N4DA30P00000001", "W1N", None) == [True, False, False]


def test_model_year_table(apply):
    expected = {"1": 2001, "9": 2009, "A": 2010, "H": 2017, "J": 2018, "N": 2022, "P": 2023, "R": 2024, "S": 2025}
    expected |= {"T": 2026, "V": 2027, "Y": 2030, "0": None, "I": None, "O": None, "Q": None, "U": None, "Z": None, "": None}
    assert apply(vin.model_year, *expected) == list(expected.values())


def test_prefix_brand(apply):
    assert apply(vin.prefix_brand, "SAL", "SAJ", "W1N", None) == ["Land Rover", "Jaguar", "", ""]


def test_four_digit_year(apply):
    assert apply(vin.four_digit_year, "2025.0", "14", " 2024 ", "x", None) == [2025, 2014, 2024, None, None]


def test_dates(apply):
    stamp = datetime(2025, 6, 17, 9, 36, 8)
    day = datetime(2025, 6, 17)
    values = ("2025-06-17-09.36.08.000000000   ", "6/17/2025", "20250617", "2025-06-17", "Jun 17, 2025", "13/45/2025", "20251345", "n/a", "", None)
    assert apply(dates.parse_purchase_date, *values) == [stamp, day, day, day, day, None, None, None, None, None]
    assert apply(dates.parse_purchase_date, *values[:3], layout="fixed") == [stamp, None, None]
    assert apply(dates.parse_purchase_date, *values[:3], layout="general") == [None, day, day]


def test_date_parts(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2025-06-17 00:00:00' AS t UNION ALL SELECT NULL")
    found = df.select(dates.purchase_month(F.col("t")), dates.purchase_year(F.col("t"))).collect()
    assert sorted(map(tuple, found), key=str) == [("06", "2025"), (None, None)]


def test_codes(apply):
    assert apply(codes.purchase_lease_code, " LEASE", "retail", None) == [2, 1, 1]
    assert apply(codes.clean_ucc, " 12 ", "nan", "", None) == ["12", "MISSING_UCC", "MISSING_UCC", "MISSING_UCC"]
    assert apply(codes.spreadsheet_text, "1" * 21, "12", None) == [f'="{"1" * 21}"', "12", None]
    assert apply(codes.is_coded, "A1", " default ", "", None, "Missing") == [True, False, False, False, False]
    assert apply(codes.tidy_channel, " Mail", None) == ["mail", "unknown"]


def test_electric_word_inside_a_word(spark):
    df = spark.createDataFrame([("Chevrolet",), ("EV Sedan",), (None,)], "m string")
    flags = df.select(codes.electric_flag([F.col("m")]), codes.electric_flag([F.col("m")], whole_words=True)).collect()
    assert [tuple(r) for r in flags] == [("1", "0"), ("1", "1"), ("0", "0")]


def test_general_dates(apply):
    forms = {
        "2025-06-17 09:36": datetime(2025, 6, 17, 9, 36), "06-17-2025": datetime(2025, 6, 17),
        "2025-06-17T09:36:08Z": datetime(2025, 6, 17, 9, 36, 8), "2025-06-17T09:36:08+00:00": datetime(2025, 6, 17, 9, 36, 8),
        "17 June 2025 10:00": datetime(2025, 6, 17, 10), "June 17 2025": datetime(2025, 6, 17), "Jun 2025": datetime(2025, 6, 1),
        "2025-6-7": datetime(2025, 6, 7), "2025-06": datetime(2025, 6, 1), "2025-13-01": None, "31-31-2025": None, "soon": None,
    }
    assert apply(dates.general_date, *forms) == list(forms.values())
