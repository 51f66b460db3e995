from datetime import datetime

import pytest

from urbanweave.operators.cleaning import first_failed_rule, keep_valid, quality_report, rule_counts
from urbanweave.operators.profile import duplicates_by_year, issues_by_year
from urbanweave.schemas import RAW_TRIP, TRIP, conform
from pyspark.sql import functions as F

INSIDE = dict(
    pickup_centroid_latitude="41.9",
    pickup_centroid_longitude="-87.6",
    dropoff_centroid_latitude="41.9",
    dropoff_centroid_longitude="-87.6",
    trip_miles="1",
    trip_seconds="600",
    fare="10",
    trip_start_timestamp="2024-05-01T10:00:00.000",
    trip_end_timestamp="2024-05-01T10:10:00.000",
)

CASES = [
    ({}, None),
    ({"pickup_centroid_latitude": "41.6"}, None),
    ({"dropoff_centroid_latitude": "42.1"}, None),
    ({"pickup_centroid_longitude": "-87.9"}, None),
    ({"dropoff_centroid_longitude": "-87.5"}, None),
    ({"dropoff_centroid_longitude": "-87.49"}, "invalid_coordinates"),
    ({"pickup_centroid_latitude": None}, "invalid_coordinates"),
    ({"pickup_centroid_latitude": "  "}, "invalid_coordinates"),
    ({"pickup_centroid_latitude": "here"}, "invalid_coordinates"),
    ({"trip_miles": "-0.01"}, "invalid_trip_miles"),
    ({"trip_miles": "0"}, None),
    ({"trip_miles": "100"}, None),
    ({"trip_miles": "100.01"}, "invalid_trip_miles"),
    ({"trip_miles": "inf"}, "invalid_trip_miles"),
    ({"trip_miles": None}, None),
    ({"trip_miles": "NaN"}, None),
    ({"trip_miles": "12d"}, None),
    ({"trip_miles": "abc"}, None),
    ({"trip_seconds": "59"}, "invalid_trip_seconds"),
    ({"trip_seconds": "60"}, None),
    ({"trip_seconds": "7200"}, None),
    ({"trip_seconds": "7201"}, "invalid_trip_seconds"),
    ({"trip_seconds": None}, None),
    ({"fare": "2.49"}, "invalid_fare"),
    ({"fare": "2.50"}, None),
    ({"fare": "500"}, None),
    ({"fare": "500.01"}, "invalid_fare"),
    ({"trip_end_timestamp": "2024-05-01T10:00:00.000"}, None),
    ({"trip_end_timestamp": "2024-05-01T09:59:59.000"}, "invalid_timestamps"),
    ({"trip_end_timestamp": None}, None),
    ({"trip_end_timestamp": "yesterday"}, None),
    ({"trip_miles": "200", "fare": "1"}, "invalid_trip_miles"),
]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [{"trip_id": str(n), **INSIDE, **change} for n, (change, _) in enumerate(CASES)]
    return spark.createDataFrame([[row.get(c) for c in RAW_TRIP.names] for row in rows], RAW_TRIP)


def test_each_row_is_charged_to_its_first_failed_rule(cases):
    found = {r.trip_id: r.rule for r in cases.select("trip_id", first_failed_rule(cases).alias("rule")).collect()}
    assert found == {str(n): rule for n, (_, rule) in enumerate(CASES)}


def test_valid_rows_are_typed_and_bad_numbers_become_null(cases):
    valid = {r.trip_id: r for r in keep_valid(cases).collect()}
    assert set(valid) == {str(n) for n, (_, rule) in enumerate(CASES) if rule is None}
    texts = {n: change["trip_miles"] for n, (change, _) in enumerate(CASES) if "trip_miles" in change}
    assert all(valid[str(n)].trip_miles is None for n, text in texts.items() if text in ("NaN", "12d", "abc", None))
    assert valid["0"].trip_start_timestamp == datetime(2024, 5, 1, 10)


def test_rules_on_absent_columns_pass(spark, cases):
    narrow = cases.drop("trip_miles", "fare", "trip_end_timestamp")
    kept = {r.trip_id for r in keep_valid(narrow).collect()}
    failing = {"invalid_coordinates", "invalid_trip_seconds"}
    assert kept == {str(n) for n, (_, rule) in enumerate(CASES) if rule not in failing}


def test_report_adds_up(cases):
    counts = {r.rule: r.rows for r in rule_counts(cases).collect()}
    report = {r.file: r for r in quality_report(cases, F.pmod(F.col("trip_id").cast("int"), F.lit(3)).cast("string")).collect()}
    total = report.pop("TOTAL")
    assert len(report) == 3
    assert total.rows_raw == len(CASES) and total.rows_clean == counts["clean"]
    assert total.invalid_fare == counts["invalid_fare"] == sum(r.invalid_fare for r in report.values())
    assert total.pct_removed == round(total.removed_total / total.rows_raw * 100, 2)


def test_profile_flags_100_miles_and_counts_all_copies(spark):
    rows = [("a", "100", "2024-01-01"), ("a", "5", "2024-02-01"), ("b", "5", "2024-03-01"), ("b", "5", "2025-03-01")]
    trips = conform(spark.createDataFrame(rows, "trip_id string, trip_miles string, trip_start_timestamp string"), RAW_TRIP)
    assert {r.year: r.outliers for r in issues_by_year(trips).collect()} == {2024: 1, 2025: 0}
    assert {r.year: r.duplicate_rows for r in duplicates_by_year(trips).collect()} == {2024: 2, 2025: 0}
    assert conform(trips, TRIP).schema == TRIP
