"""Column expressions against literal expectations."""

import pytest
from pyspark.sql import functions as F

from sievemark.functions import names, places, text


def values(spark, inputs, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_placeholders_are_null_and_zero_is_not(spark):
    got = values(spark, [" NULL ", "n/a", "-", "[]", "unknown", "\t\n", "0", " text ", None, "''"], text.cleaned)
    assert got == [None] * 6 + ["0", "text", None, None]


def test_list_items(spark):
    inputs = ['["a", " b ", "null", ""]', '["broken', '"one"', "plain", "[]", None, "8"]
    assert values(spark, inputs, text.list_items) == [["a", "b"], ['["broken'], ["one"], ["plain"], [], [], ["8"]]


def test_numbers(spark):
    assert values(spark, ["1,234 beds", "about -7", "none", None, "99999999999"], text.whole_number) == [1234, -7, None, None, 99999999999]
    assert values(spark, ["(29.5)", "*", "1,234.5", "no data"], text.decimal_number) == [29.5, None, 1234.5, None]


def test_numbers_that_spark_writes_with_an_exponent(spark):
    assert values(spark, ["8.0E-4", "-1.5e+1", "3.0E5x", "7E5", "about 2.5E2."], text.decimal_number) == [0.0008, -15.0, 3.0, 7.0, 250.0]
    assert values(spark, [0.0008, 12345678.5], text.decimal_number, "double") == [0.0008, 12345678.5]


def test_title_case_after_any_non_letter(spark):
    assert values(spark, ["24-parganas", "NEW DELHI", "o'neill"], text.title_case) == ["24-Parganas", "New Delhi", "O'Neill"]


def test_postal_code(spark):
    assert values(spark, ["682 001", "PIN 110001.", "012345", "1234567", None], places.postal_code) == ["682001", "110001", None, None, None]


@pytest.mark.parametrize(
    ("lat", "lon", "status"),
    [("9.9", "76.2", "ok"), ("0", "0", "out_of_range"), ("99", "76", "out_of_range"), (None, "", "missing"), ("x", "76", "unparseable"), ("9.9", None, "unparseable")],
)
def test_coordinates(spark, lat, lon, status):
    df = spark.createDataFrame([(lat, lon)], "lat string, lon string")
    got = df.select(places.coordinates(F.col("lat"), F.col("lon")).alias("p")).first()["p"]
    assert got["status"] == status
    if status == "out_of_range":
        assert got["lat"] is not None


def test_states(spark):
    inputs = ["Kerala", "Orissa", "U.P.", "Ghaziabad, Uttar Pradesh", "Mumbai", "J & K", None, "Mh"]
    df = places.with_state(spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string"), "v", "s", "m").orderBy("i")
    assert [(r["s"], r["m"]) for r in df.collect()] == [
        ("Kerala", "exact"), ("Odisha", "alias"), ("Uttar Pradesh", "alias"), ("Uttar Pradesh", "suffix"), (None, "none"), ("Jammu and Kashmir", "alias"), (None, "none"), ("Maharashtra", "alias"),
    ]


def test_name_categories(spark):
    cases = {
        "City Hospital": "hospital_like", "Smile Dental Hospital": "dentist", "Apollo Pharmacy": "pharmacy", "X Hospital & Diagnostics": "hospital_like", "Dr. A. Kumar": "individual_doctor",
        "Metro Labs": "diagnostics_or_lab", "Community Health Centre": "clinic_or_health_center", "Something": "unknown", "": "unknown",
    }
    assert values(spark, list(cases), lambda c: names.audit_category(c, F.lit("facility"))) == list(cases.values())


def test_contexts(spark):
    cases = {"General Hospital": names.GENERAL, "Eye Hospital": names.SPECIALTY, "Smile Dental Clinic": names.OUTPATIENT, "Dr. B": names.OUTPATIENT, "Acme": names.UNKNOWN, "Sunrise Nursing Home": names.GENERAL}
    assert values(spark, list(cases), lambda c: names.context(c, F.lit("facility"))) == list(cases.values())


def test_labels_pass_unknown_values_through(spark):
    assert values(spark, ["Trusted ICU Coverage", "else"], names.class_label) == ["Trusted ICU evidence", "else"]
