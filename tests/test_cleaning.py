"""Edge rows of the cleaning and recode expressions."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from balancier.functions import cleaning as C
from balancier.functions import recode as R


def apply(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").select("i", expr(F.col("c")).alias("x"))
    return [r["x"] for r in sorted(rows.collect())]


def test_guarded_integer(spark):
    got = apply(spark, [" 12 ", "-3", "+4", "1.5", "", None, "99999999999", "x"], C.guarded)
    assert got == [12, -3, None, None, None, None, None, None]


def test_long_rounds_half_to_even_and_takes_locale_text(spark):
    got = apply(spark, ["2.5", "3.5", "3.9", "-2.5", "1 234,56", "1 234,4", "1.2E3", "1,2,3", "N/D", " ", None], C.clean_long)
    assert got == [2, 4, 4, -2, 1235, 1234, 1200, None, None, None, None]


def test_decimal_is_exact(spark):
    got = apply(spark, ["12345678901234.1234567891", "1 234,5", "bad", ""], C.clean_decimal)
    assert got == [Decimal("12345678901234.1234567891"), Decimal("1234.5000000000"), None, None]


def test_two_date_layouts(spark):
    got = apply(spark, ["05/03/1999", " 1999-03-05 ", "31/02/1999", "1999-13-01", "5/3/1999", None], C.parse_date)
    assert got == [date(1999, 3, 5), date(1999, 3, 5), None, None, None, None]


def test_six_date_layouts(spark):
    got = apply(
        spark,
        ["05/03/1999", "1999-03-05", "05-03-1999", "03/25/1999", "1999/03/05", "05.03.1999", "1999-03-05T10:00", "soon", " ", None, "31/02/1999"],
        C.normalise_date,
    )
    assert got == ["05/03/1999"] * 3 + ["25/03/1999"] + ["05/03/1999"] * 3 + ["soon", " ", None, "31/02/1999"]


def test_near_zero(spark):
    rows = spark.createDataFrame([(Decimal("0.99"),), (Decimal("-0.5"),), (Decimal("1"),), (None,)], "d decimal(20,10)")
    assert [r[0] for r in rows.select(C.near_zero("d")).collect()] == [0, 0, 1, 0]


def test_code_tables_are_whole():
    assert (len(R.AGENTS), len(R.PURPOSES), len(R.ZONES)) == (35, 79, 35)


def test_exact_codes(spark):
    assert apply(spark, ["100", " 400 ", "7", "x", None], lambda c: R.exact(c, R.AGENTS)) == ["21100", "24200", "7", "x", None]


def test_zones(spark):
    assert apply(spark, ["sn", " FR ", "US", "", None], R.zone) == [110, 143, 144, 144, None]


def test_contract_types(spark):
    assert apply(spark, ["p", " D ", "LEASING", None, " "], R.contract_type) == ["PRET", "COMPTE ORDINAIRE", "LEASING", None, " "]


def brute(value: int) -> int:
    """Nearest run end; a tie falls to the lower key."""
    ends = sorted((k, code) for first, last, code in R.SECTION_RUNS for k in (first, last))
    inside = [code for first, last, code in R.SECTION_RUNS if first <= value <= last]
    return inside[0] if inside else min(ends, key=lambda e: (abs(e[0] - value), e[0]))[1]


def test_nearest_against_brute_force(spark):
    values = list(range(0, 10200))
    rows = spark.createDataFrame([(v,) for v in values], "v int").select("v", R.nearest(F.col("v"), R.SECTION_RUNS).alias("x")).collect()
    assert [(r["v"], r["x"]) for r in rows if r["x"] != brute(r["v"])] == []


def test_sections(spark):
    # a tenth, truncated; half way between 1130 and 1210 falls to the lower key
    assert apply(spark, ["11109", "11700", "11710", "-5", "0", "abc", None], R.section) == ["1", "1", "2", "1", "1", "abc", None]


@pytest.mark.parametrize("number, label", [(110, "Etat du Declarant"), (143, "Zone euro"), (999, "Autres Etats"), (None, "Autres Etats")])
def test_zone_labels(spark, number, label):
    rows = spark.createDataFrame([(number,)], "n int")
    assert rows.select(R.zone_label("n")).first()[0] == label
