from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import money as M
from tallyloom.functions import text as N


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


ACCEPTED = {"HKD15,000.00": "15000.00", "$ 120000.00": "120000.00", "1,230": "1230", "HK$1,234.5": "1234.50", "ABC12.34": "12.34", "HKD 500": "500", "70.233.22.5": "22.5", "￥88": "88"}
REJECTED = ["140981024", "2026/09/08", "456789123", "1230", "1.23456", "120,000", "", "no figure", "004"]


def test_amounts(spark):
    assert column(spark, ACCEPTED, lambda c: F.element_at(M.amount_values(c), 1)) == [Decimal(v).quantize(Decimal("0.01")) for v in ACCEPTED.values()]
    assert column(spark, REJECTED, lambda c: F.size(M.amount_values(c))) == [0] * len(REJECTED)
    assert column(spark, ["1.5 2.25 HKD9", None], lambda c: F.size(M.find_amounts(c))) == [3, None]


@pytest.mark.parametrize(
    "text, fixed",
    [("15,ooo.o0", "15,000.00"), ("5,8oo.oo", "5,800.00"), ("15.000.00", "15,000.00"), ("ABCO123", "ABCO123"), ("Total OOO", "Total OOO"), ("15,ooo.oo", "15,000.00"), ("HKD15.000.00", "HKD15.000.00"), ("1OO.OO", "100.00"), ("12oo", "12oo"), ("5o5", "505")],
)
def test_repair(spark, text, fixed):
    assert column(spark, [text], M.repair_ocr_numbers) == [fixed]


def test_totals(spark):
    cases = {
        "Sub-total 100.00\nTotal Amount: HKD15,000.00\nPaid 99,999.00": "15000.00",
        "小計 5.00\n總計  5,800.00": "5800.00",
        "总计 7.50": "7.50",
        "TOTAL\n120,000.00\n3.00": "120000.00",
        "a 10.00 b 30.00 c 20.00": "30.00",
        "HKD\n500": "500.00",
        "nothing 123": None,
        "": None,
        "total 5.00\rtotal 6.00": "6.00",
        "Price 900.00\nAmount Due: 500.00": "500.00",
        "Price 900.00\nBALANCE  due 400.00\nDeposit 950.00": "400.00",
        "Price 900.00\nGrand total 1,000.00\nTotal due 300.00": "300.00",
        "Price 900.00\nDue 300.00": "900.00",
    }
    assert column(spark, cases, M.extract_total) == [v and Decimal(v) for v in cases.values()]
    assert column(spark, [None], M.extract_total) == [None]


def test_cells(spark):
    cases = {"HKD 1,230": "1230", "1,230 HKD": None, "-5": "-5", "-$5": None, "1e5": "100000", " $ 12.345 ": "12.345", "n/a": None, "": None}
    assert column(spark, cases, M.to_decimal) == [v and Decimal(v).quantize(Decimal("0.000001")) for v in cases.values()]


def test_rounding_and_formats(spark):
    rows = spark.sql("SELECT CAST(v AS DECIMAL(18,6)) AS v FROM VALUES ('1.005'), ('-1.005'), ('2.675'), ('1234567.1'), (NULL) AS t(v)")
    got = rows.select(M.quantize(F.col("v")), M.format_amount(F.col("v")), M.format_amount_display(F.col("v"))).collect()
    assert [r[1] for r in got] == ["1.01", "-1.01", "2.68", "1234567.10", ""]
    assert [r[2] for r in got] == ["1.01", "-1.01", "2.68", "1,234,567.10", ""]
    one = spark.sql("SELECT CAST(100 AS DECIMAL(18,6)) AS a, CAST(100.01 AS DECIMAL(18,6)) AS b, CAST(100.02 AS DECIMAL(18,6)) AS c")
    assert one.select(M.amounts_equal(F.col("a"), F.col("b")), M.amounts_equal(F.col("a"), F.col("c"))).first()[:] == (True, False)


def test_names(spark):
    cases = {"ABC Medical Centre Limited": "abcmedicalcentreltd", "ABCMedical CentreLimited": "abcmedicalcentreltd", "The Company（HK）Incorporated": "thecohkinc", "Acme Corporation, Ltd.": "acmecorpltd", "收款人 有限公司": "收款人有限公司", "": "", "--": ""}
    assert column(spark, cases, N.normalise_name) == list(cases.values())
    assert column(spark, [None], N.normalise_name) == [""]
    assert column(spark, ["012-345 6", None, "x"], N.normalise_digits) == ["0123456", "", ""]
    assert column(spark, ["１２．５：總計", None], N.fold_text) == ["12.5:总计", None]
    assert column(spark, ["x" * 100, "abcdefghi" * 7, "abcdefghi " * 6, None, "The quick brown fox " * 4], N.is_text_layer) == [False, True, False, False, True]
