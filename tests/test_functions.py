"""Expressions against stated examples, and properties that must hold."""

import pytest
from pyspark.sql import functions as F

from quirelake.functions import dates, identity, rules, text
from quirelake.functions.rules import COLUMN_RULES, Rule


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value, want",
    [("S1C5059-13-10", "SIC5059-13-10"), ("B372BAM0511", "B372BAM0511"), ("1209-100", "1209-100"), (".968A0000-03", "968A0000-03"), (",114193600", "114193600"), ("..OO-200-1462", "00-200-1462"), (" a|b ", "AB"), (None, "")],
)
def test_part_numbers(spark, value, want):
    assert one(spark, lambda c: rules.cleaned(c, COLUMN_RULES["PART_NUMBER"]), value) == want


@pytest.mark.parametrize("value, fine", [("9024-15704-2", True), ("K", True), ("B-HL", True), ("9024-", False), ("A/B", False), ("A_B", False)])
def test_part_number_pattern(spark, value, fine):
    assert (one(spark, lambda c: F.size(rules.issues(c, COLUMN_RULES["PART_NUMBER"])), value) == 0) == fine


@pytest.mark.parametrize("value, want", [("23,443", 23443), ("23.443", 23443), ("23'443", 23443), ("23.5", None), ("-12", -12), ("1,23", None)])
def test_thousands(spark, value, want):
    assert one(spark, rules.thousands, value) == want


@pytest.mark.parametrize("value, want", [("30000", []), ("30001", ["over_review_band"]), ("55001", ["out_of_range"]), ("abc", ["bad_format", "not_a_number"]), ("", ["empty"])])
def test_ranges(spark, value, want):
    assert one(spark, lambda c: rules.issues(c, Rule(r"^\d+$", hard=(0, 55_000), review=(0, 30_000))), value) == want


def test_merged_rules():
    out = rules.merged_rules(COLUMN_RULES, {"ATA": {"hard": None}, "NEW": {"uppercase": True}})
    assert out["ATA"] == Rule(r"^\d{2}$") and out["NEW"].uppercase and COLUMN_RULES["ATA"].hard == (20, 83)


def test_clean_record_keeps_rows_and_is_idempotent(spark):
    df = spark.createDataFrame([("21", " s1c-7 ", None, 3), ("x", "", "d", 4), (None, "AB", "d", 5)], "ATA string, PART_NUMBER string, DESCRIPTION string, _page int")
    once = rules.clean_record(df)
    assert [r["_issues"] for r in once.collect()] == ["DESCRIPTION:empty", "ATA:bad_format,ATA:not_a_number,PART_NUMBER:empty", "ATA:empty"]
    assert rules.clean_record(once).collect() == once.collect()


@pytest.mark.parametrize("value", ["2024-05-13", "13/05/2024", "13-May-24", "13.05.2024", "May 13, 2024", "13/05/24", "13.Mai.2024"])
def test_cell_dates(spark, value):
    assert one(spark, dates.normalize_date, value) == "2024-05-13"


@pytest.mark.parametrize("value, want", [("31/02/2020", "31/02/2020"), ("1/1/50", "2050-01-01"), ("1/1/51", "1951-01-01"), ("13-Foo-24", "13-Foo-24"), ("", "")])
def test_cell_dates_at_the_edges(spark, value, want):
    assert one(spark, dates.normalize_date, value) == want


@pytest.mark.parametrize("value, want", [("22.Aug.2016", "2016-08-22"), ("25Aug2011", "2011-08-25"), ("06.04.2018", "2018-04-06"), ("28 Mar 18", "2018-03-28"), ("21-23-50", ""), ("01-01-50", "1950-01-01"), ("3-AOÛT-2012", ""), ("3-SEPT-2012", "2012-09-03"), (None, "")])
def test_report_dates(spark, value, want):
    assert one(spark, dates.report_date_iso, value) == want


def test_report_date_found(spark):
    assert one(spark, dates.extract_report_date, "x\nREPORT DATE 12-Mar-2015\n01/02/2003") == "12-Mar-2015"
    assert one(spark, dates.extract_report_date, "x\nmade 01/02/2003") == "01/02/2003"
    assert one(spark, dates.extract_report_date, "PRINTED 01/02/2003\nUPDATED 05/06/2007") == "05/06/2007"
    assert one(spark, dates.extract_report_date, "DATE 12\u2011Mar\u20112015") == "12-Mar-2015"
    assert one(spark, dates.extract_report_date, "DATED 1/2/03\nvalid as  of 28 Mar 18") == "28 Mar 18"
    assert one(spark, dates.report_date_iso, "1-Feb-200") == "19200-02-01"


@pytest.mark.parametrize(
    "value, want",
    [("OCCM_MSN_1234.pdf", ("1234", "msn")), ("0469_a305.pdf", ("0469", "msn_prefix")), ("2016_list.pdf", ("2016_list", "filename")), ("x VP-BDK.pdf", ("VP-BDK", "registration")), ("OOABC_x.pdf", ("OO-ABC", "registration_compressed")), ("list of 2016 41234.pdf", ("41234", "msn_guess")), ("pages 0000.pdf", ("pages 0000", "filename"))],
)
def test_keys(spark, value, want):
    assert tuple(one(spark, identity.aircraft_key, value)) == want


@pytest.mark.parametrize("value, want", [("MODEL 321-231", ("A320 family", "high")), ("747-06209", ("Unknown", "none")), ("TYPE XX-A350", ("Unknown", "none")), ("see A380 here", ("A380", "medium")), ("767-300ER", ("B767", "medium")), (None, ("Unknown", "none"))])
def test_families(spark, value, want):
    got = one(spark, identity.family, value)
    assert (got["family"], got["confidence"]) == want


def test_headers(spark):
    assert one(spark, identity.header_msn, "a\nMSN: 4174\n") == "4174"
    assert one(spark, identity.header_msn, "SERIAL NUMBER AND LINE 4174") == "4174"
    assert one(spark, identity.header_msn, "PART NO S E R I A L # 2211") == "2211"
    assert one(spark, identity.header_msn, "MSN4174 SERIAL\nS/N 12") == "4174"
    assert one(spark, identity.header_registration, "ATA REPORT AB-CDE") == ""
    assert one(spark, identity.header_registration, "A/C REG N/A\nlist of VP-XYZ") == "VP-XYZ"
    assert one(spark, identity.header_registration, "R E G : seen as VP-BDK") == "VP-BDK"
    assert tuple(one(spark, identity.family, "M O D E L 737-800")) == ("B737", "737", "high")
    assert tuple(one(spark, identity.family, "A330 list")) == ("A330", "A330", "medium")
    assert one(spark, identity.header_registration, "PART NO VP-XYZ\nREG: VP-BDK") == "VP-BDK"


def test_texts(spark):
    assert one(spark, text.joined_letters, "M O D E L no A B x1") == "MODEL no A B x1"
    assert one(spark, text.undoubled, "AABB1C") == "AB1C"
    assert one(spark, text.joined_thousands, "30 000 and 12 34") == "30000 and 12 34"
    assert one(spark, text.strip, " x\t") == "x"
    assert one(spark, text.ocr_cleaned, "| a [b] |\n-----\n c") == "a b\nc"
    assert one(spark, text.unusable_reason, "(cid:3)" * 20) == "garbled_cid"


def test_date_columns(spark):
    df = spark.createDataFrame([("1/2/2003", "1/2/2003", " ", "1/2/2003", 5)], "INSTALL_DATE string, NOTE string, my_date string, _DATE string, n int")
    assert tuple(dates.normalize_dates(df).first()) == ("2003-02-01", "1/2/2003", " ", "1/2/2003", 5)
