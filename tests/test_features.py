from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from urbanweave.functions import display as show
from urbanweave.functions.areas import AREA_NAMES, add_neighborhood
from urbanweave.functions.calendar import add_calendar_features
from urbanweave.functions.casting import half_even, rounded
from urbanweave.functions.fares import add_fare_features


def calendar(spark, *times):
    rows = spark.createDataFrame([(t,) for t in times], "trip_start_timestamp timestamp_ntz")
    return add_calendar_features(rows).collect()


def test_peak_hours_are_inclusive(spark):
    rows = calendar(spark, *[datetime(2024, 5, 1, hour, 59) for hour in range(24)])
    assert [r.hour for r in rows if r.is_rush_hour] == [7, 8, 9, 17, 18, 19]


def test_weekdays_start_on_monday(spark):
    rows = calendar(spark, *[datetime(2024, 5, day) for day in range(6, 13)])
    assert [r.day_of_week for r in rows] == list(range(7))
    assert [r.is_weekend for r in rows] == [0, 0, 0, 0, 0, 1, 1]


def test_seasons(spark):
    rows = calendar(spark, *[datetime(2024, month, 1) for month in range(1, 13)])
    assert [r.season[0:2] for r in rows] == ["Wi"] * 2 + ["Sp"] * 3 + ["Su"] * 3 + ["Fa"] * 3 + ["Wi"]


def test_missing_time(spark):
    (row,) = calendar(spark, None)
    assert (row.hour, row.season, row.is_weekend, row.is_rush_hour, row.is_holiday) == (None, "Unknown", 0, 0, 0)


def test_holidays_of_two_years(spark):
    days = spark.sql("SELECT explode(sequence(date'2021-01-01', date'2022-12-31')) AS d")
    times = days.select(F.col("d").cast("timestamp_ntz").alias("trip_start_timestamp"))
    found = {r.trip_start_timestamp.date() for r in add_calendar_features(times).where("is_holiday = 1").collect()}
    expected = """2021-01-01 2021-01-18 2021-02-15 2021-05-31 2021-06-18 2021-06-19 2021-07-04 2021-07-05 2021-09-06
        2021-10-11 2021-11-11 2021-11-25 2021-12-24 2021-12-25 2021-12-31 2022-01-01 2022-01-17 2022-02-21 2022-05-30
        2022-06-19 2022-06-20 2022-07-04 2022-09-05 2022-10-10 2022-11-11 2022-11-24 2022-12-25 2022-12-26"""
    assert found == {date.fromisoformat(d) for d in expected.split()}


def test_no_juneteenth_before_2021(spark):
    assert calendar(spark, datetime(2019, 6, 19))[0].is_holiday == 0


def test_fares(spark):
    rows = spark.createDataFrame(
        [(10.0, 3600.0, 20.0, 5.0), (0.0, 0.0, 0.0, 1.0), (2.0, 60.0, 8.0, None), (None, 60.0, 8.0, 1.0)],
        "trip_miles double, trip_seconds double, fare double, tips double",
    )
    whole, zero, untipped, no_miles = add_fare_features(rows).collect()
    assert (whole.speed_mph, whole.fare_per_mile, whole.tip_percentage, whole.total_amount) == (10.0, 2.0, 25.0, 25.0)
    assert (zero.speed_mph, zero.fare_per_mile, zero.tip_percentage, zero.total_amount) == (None, None, None, 1.0)
    assert (untipped.tip_percentage, untipped.total_amount) == (None, None)
    assert no_miles.speed_mph is None and no_miles.fare_per_mile is None


def test_fares_without_tips_column(spark):
    rows = spark.createDataFrame([(10.0, 3600.0, "20")], "trip_miles double, trip_seconds double, fare string")
    row = add_fare_features(rows).first()
    assert row.tip_percentage is None and row.total_amount == 20.0


def test_neighborhoods(spark):
    assert len(AREA_NAMES) == 77
    rows = spark.createDataFrame([(v,) for v in ("1", "32.0", "76", "77", "0", "78", "8.5", None, "x", "inf")], "pickup_community_area string")
    names = [r.neighborhood for r in add_neighborhood(rows).collect()]
    assert names == ["Rogers Park", "Loop", "O'Hare", "Edgewater"] + [None] * 6
    assert add_neighborhood(spark.range(1)).first().neighborhood is None


@pytest.mark.parametrize("value, away, even", [(2.675, 2.68, 2.68), (1.005, 1.01, 1.0), (0.125, 0.13, 0.12), (-0.125, -0.13, -0.12)])
def test_rounding(spark, value, away, even):
    row = spark.range(1).select(rounded(F.lit(value), 2).alias("a"), half_even(F.lit(value), 2).alias("e")).first()
    assert (row.a, row.e) == (away, even)


def test_display_values(spark):
    levels = [0.81, 0.8, 0.61, 0.41, 0.21, 0.11, 0.06, 0.05, None]
    rows = spark.createDataFrame([(v,) for v in levels], "v double").select(
        show.flow_color(F.col("v")).alias("flow"), show.pagerank_color(F.col("v")).alias("rank")
    )
    found = rows.collect()
    assert [r.flow for r in found] == [
        "#800026", "#BD0026", "#BD0026", "#E31A1C", "#FC4E2A", "#FD8D3C", "#FEB24C", "#FFEDA0", "#FFEDA0",
    ]
    assert [r.rank for r in found][-3:] == ["#90E0EF", "#CAF0F8", "#CAF0F8"]
    one = spark.range(1).select(
        show.community_color(F.lit(12)).alias("color"),
        show.day_label(F.lit(6)).alias("day"),
        show.day_label(F.lit(9)).alias("no_day"),
        show.rush_label(F.lit(1)).alias("rush"),
        show.cell_label(F.lit(""), F.lit("892664c1ecfffff")).alias("cell"),
        show.in_thousands(F.lit(1234567)).alias("k"),
        show.in_millions(F.lit(1234567)).alias("m"),
        show.to_viewport(F.lit(42.0222), F.lit(-87.5279), 100.0, 50.0, 10.0, 5.0).alias("at"),
    ).first()
    assert (one.color, one.day, one.no_day, one.rush, one.cell) == ("#2A9D8F", "Dom", "9", "Rush Hour", "892664c1ecff...")
    assert (one.k, one.m, one["at"].x, one["at"].y) == ("1235k", "1.23M", 110.0, 5.0)
