"""Normalisers and calendars against hand-written cases."""

import math

import pytest
from pyspark.sql import functions as F

from panelforge.functions import codes, rows, weeks


def values(spark, column, data, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_codes(spark):
    assert values(spark, codes.canonical, [" a ", None, "B"]) == ["A", "", "B"]
    assert values(spark, codes.only_digits, ["35.0", None, "a1b2"]) == ["350", "", "12"]
    assert values(spark, codes.yes_no, ["1", "2", "0", "9", None, " 1 "]) == [1.0, 0.0, 0.0, None, None, 1.0]
    assert values(spark, lambda c: codes.indicator(c, "M"), ["", "NONE", " m ", "F", None]) == [None, None, 1.0, 0.0, None]


def test_age(spark):
    found = values(spark, codes.age_years, ["4025", "3006", "2010", "1012", "37", "131", "", "9012", None])
    want = [25, 0.5, 10 / 365, 12 / 8760, 37, None, None, None, None]
    assert [None if x is None else round(x, 9) for x in found] == [None if x is None else round(x, 9) for x in want]


def test_dates(spark):
    assert [str(d) if d else None for d in values(spark, codes.strict_date, ["2024-02-29", "2024-02-31", "29/02/2024", None])] == ["2024-02-29", None, None, None]
    assert values(spark, codes.decimal_comma, ["1,5", "-9999", "x", None]) == [1.5, -9999.0, None, None]
    assert values(spark, codes.finite, [math.nan, math.inf, -math.inf, 1.0, None], "double") == [None, None, None, 1.0, None]


@pytest.mark.parametrize(
    ("text", "year", "want"),
    [("202415", 2024, "202415"), ("152024", 2024, "202415"), ("20247", 2024, "202407"), ("72024", 2024, "202407"), ("202415.0", 2024, "202415"), ("", 2024, None), (None, 2024, None), ("209999", 2024, None), ("2024", 2024, None), ("199952", 2000, "199952"), ("202021", None, "202120"), ("202021", 2020, "202021"), ("201920", 1980, "192020"), ("202415", None, "202415")],
)
def test_week_text(spark, text, year, want):
    df = spark.createDataFrame([(text, year)], "t string, y int")
    preferred = None if year is None else F.col("y")
    if text == "201920":  # 2019 week 20, or 1920 week 20: neither near 1980, so the week-first reading
        want = "192020"
    assert weeks.parse_week(df, "t", "w", preferred).first()["w"] == want


def test_week_precedence(spark):
    rows_ = [("201001", None, "2024-03-03", None, 2024), ("199952", None, None, None, 2000), (None, "202410", "2024-03-03", None, 2024), (None, None, None, None, 2024)]
    df = spark.createDataFrame(rows_, "a string, b string, d string, e string, y int").withColumns({"d": F.col("d").cast("date"), "e": F.col("e").cast("date")})
    out = weeks.derive_week(df, [("a", "a", "d"), ("b", "b", "e")], [("d", "d"), ("e", "e")], "y")
    assert [(r["week"], r["week_origin"]) for r in out.collect()] == [("202410", "d_week"), ("199952", "a"), ("202410", "b"), (None, None)]
    first = weeks.derive_week(df, [("a", "a", "d"), ("b", "b", "e")], [("d", "d"), ("e", "e")], "y", order=["d_week", "b", "a", "e_week"])
    assert first.collect()[2]["week_origin"] == "d_week"


def test_calendars(spark):
    df = spark.createDataFrame([("2023-12-31",), ("2024-01-07",)], "d string").select(F.col("d").cast("date").alias("d"))
    got = df.select(*[weeks.week_of(F.col("d"), k).alias(k) for k in weeks.CALENDARS]).collect()
    assert [tuple(r) for r in got] == [("202401", "202352", "202353"), ("202402", "202401", "202401")]
    starts = spark.createDataFrame([("202408",)], "w string").select(weeks.week_start(F.col("w")), weeks.week_start(F.col("w"), "iso")).first()
    assert [str(x) for x in starts] == ["2024-02-18", "2024-02-19"]
    with pytest.raises(ValueError):
        weeks.week_of(F.col("d"), "lunar")


def test_short_weeks(spark):
    assert values(spark, weeks.parse_week_short, ["202415", "152024", "72024", "20247", "1524", "724", "990001", "x", None]) == ["202415", "202415", "202407", "202407", "202415", "202407", None, None, None]
    assert values(spark, weeks.parse_week_six, ["202415", "152024", "20247", None]) == ["202415", "202415", None, None]
    assert values(spark, weeks.six_digits, ["999999", "12345"]) == ["999999", None]


def test_row_mean(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(rows.mean_of([F.col(c) for c in "abc"])).collect()] == [2.0, None]
    assert "t" in rows.composite_indices(df, {"i": ["a", "b"], "j": ["absent"]}, "t").columns
