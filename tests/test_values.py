import pytest
from pyspark.sql import functions as F

from probita.functions import values as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text, status", [("[Не відомо]", "unknown"), ("[Член сім'ї не надав інформацію]", "family_no_info"), ("[інше]", "redacted_other"), ("[open", None), ("x]", None), ("", None), (" [Не відомо]", None)])
def test_placeholders(spark, text, status):
    assert one(spark, text, V.placeholder_status) == status


@pytest.mark.parametrize("text, value, status", [("3,40", 3.4, None), ("1 000 000", 1e6, None), (" 5 ", 5, None), ("[Не відомо]", None, "unknown"), ("n/a", None, "parse_error"), ("", None, None), ("  ", None, "parse_error"), ("NaN", None, "parse_error"), ("1_000", None, "parse_error"), (None, None, None)])
def test_numbers(spark, text, value, status):
    got = one(spark, text, V.safe_number)
    assert (None if got.value is None else float(got.value), got.status) == (value, status)


@pytest.mark.parametrize("text, code", [("USD (Долар США)", "USD"), ("UAH", "UAH"), ("USDабв", None), ("долари", "USD"), ("1", None), (None, None)])
def test_currency(spark, text, code):
    assert one(spark, text, V.currency_code) == code


@pytest.mark.parametrize("text, year", [("01.02.2024", 2024), ("з 1999 по 2003", 1999), ("давно", None), ("", None), (None, None)])
def test_year(spark, text, year):
    assert one(spark, text, V.year_in) == year


def test_labels(spark):
    assert [one(spark, x, V.score_band, "double") for x in (0.0, 19.9, 20.0, 40.0, 70.0, 1000.0, float("nan"))] == ["None", "Low", "Moderate", "High", "Critical", "Critical", "None"]
    assert [one(spark, x, V.type_label, "int") for x in (1, 2, 3, 9)] == ["Annual", "Initial", "Cessation", "Other"]
    assert [one(spark, x, V.magnitude_label, "double") for x in (1.25e6, 2500.0, 12.0)][0][-1] == "M"
    assert V.points(5, "HIGH", 0.9) == 6.75


def test_rates(spark):
    rows = spark.createDataFrame([("100", c) for c in ("USD", "CZK", None, "XYZ")], "a string, c string").select(V.to_uah(F.col("a"), F.col("c")).cast("double").alias("u")).collect()
    assert [r.u for r in rows] == [3700.0, 165.0, 100.0, 100.0]
