from datetime import date, datetime

import pytest

from urbanweave.operators import ingest
from urbanweave.schemas import RAW_TRIP, conform

LAT_LON = dict(
    pickup_centroid_latitude="41.9",
    pickup_centroid_longitude="-87.6",
    dropoff_centroid_latitude="41.9",
    dropoff_centroid_longitude="-87.6",
)


def landed(spark, *rows):
    full = [{**LAT_LON, **row} for row in rows]
    return spark.createDataFrame([[row.get(c) for c in RAW_TRIP.names] for row in full], RAW_TRIP)


def test_clean_and_cast(spark):
    feed = landed(
        spark,
        {"trip_id": "a", "trip_start_timestamp": "2024-01-02T00:00:00.000", "company": "late"},
        {"trip_id": "a", "trip_start_timestamp": "2024-01-01T00:00:00.000", "company": "early"},
        {"trip_id": "a", "trip_start_timestamp": "bad", "company": "undated"},
        {"trip_id": None, "company": "x"},
        {"trip_id": None, "company": "y"},
        {"trip_id": "b", "pickup_centroid_latitude": " "},
        {"trip_id": "c", "dropoff_centroid_longitude": None},
        {"trip_id": "d", "dropoff_centroid_longitude": "west"},
        {"trip_id": "e", "trip_start_timestamp": "bad"},
    )
    kept = {(r.trip_id, r.company): r for r in ingest.clean_and_cast(feed).collect()}
    assert set(kept) == {("a", "early"), (None, "x"), ("e", None)}
    assert kept["a", "early"].trip_start_timestamp == datetime(2024, 1, 1)
    assert kept["e", None].trip_start_timestamp is None
    assert {r.trip_id for r in ingest.dedup_for_load(ingest.clean_and_cast(feed)).collect()} == {"a", "e"}
    loss = ingest.ingest_loss(feed).first()
    assert (loss.original, loss.kept, loss.removed) == (9, 3, 6)


def test_ingest_loss_of_nothing(spark):
    loss = ingest.ingest_loss(landed(spark)).first()
    assert (loss.original, loss.kept, loss.pct_removed) == (0, 0, 0.0)


def test_geo_columns_may_be_absent(spark):
    rows = spark.createDataFrame([("a", "41.9"), ("b", "x")], "trip_id string, pickup_centroid_latitude string")
    assert [r.trip_id for r in ingest.clean_and_cast(rows).collect()] == ["a"]
    bare = spark.createDataFrame([("a",)], "trip_id string")
    assert ingest.clean_and_cast(bare).count() == 1


def test_dedup_of_a_hot_id_cuts_rows_before_the_shuffle(spark):
    rows = spark.range(30000).selectExpr(
        "if(id % 3 = 0, 'hot', cast(id AS string)) AS trip_id", "cast(id AS string) AS trip_start_timestamp"
    )
    deduped = ingest.dedup_first(rows)
    assert deduped.count() == 20001
    plan = deduped._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("month, count", [((2024, 12), 1), ((2024, 2), 1), ((2025, 1), 1)])
def test_month_scan_is_half_open(spark, month, count):
    feed = landed(
        spark,
        {"trip_id": "feb", "trip_start_timestamp": "2024-02-29T23:59:59.999"},
        {"trip_id": "dec", "trip_start_timestamp": "2024-12-31T23:59:59.999"},
        {"trip_id": "jan", "trip_start_timestamp": "2025-01-01T00:00:00.000"},
    )
    assert ingest.month_scan(feed, *month).count() == count


def test_sources_are_split_by_year(spark):
    old = spark.createDataFrame([("o1", "2023-12-31"), ("o2", "2024-01-01")], "trip_id string, trip_start_timestamp string")
    new = spark.createDataFrame(
        [("n1", "2023-12-31", "x"), ("n2", "2024-01-01", "x")], "trip_id string, trip_start_timestamp string, company string"
    )
    assert {r.trip_id for r in ingest.route_sources(old, new).collect()} == {"o1", "n2"}


def test_calendar_leaves_out_the_future(spark):
    months = {(r.year, r.month) for r in ingest.month_calendar(spark, date(2024, 3, 9)).collect()}
    assert len(months) == 27 and (2024, 3) in months and (2024, 4) not in months
    asked = ingest.month_calendar(spark, date(2024, 3, 9), years=[2023, 2024, 2030], months=[1, 12])
    assert {(r.year, r.month) for r in asked.collect()} == {(2023, 1), (2023, 12), (2024, 1)}


def test_log_keeps_the_last_entry_of_a_month(spark):
    months = spark.createDataFrame([(2024, 1), (2024, 2), (2024, 3)], "year int, month int")
    counts = spark.createDataFrame([(2024, 1, 7), (2024, 3, 5)], "year int, month int, records bigint")
    failures = spark.createDataFrame([(2024, 3, "timeout")], "year int, month int, message string")
    first = ingest.run_log(months, counts, "2024-04-01", 1.26, failures)
    entries = {r.month: r for r in first.collect()}
    assert [entries[m].status for m in (1, 2, 3)] == ["ok", "empty", "error: timeout"]
    assert entries[1].elapsed_seconds == 1.3 and entries[3].records == 0
    second = ingest.run_log(months.where("month = 3"), counts, "2024-03-01")
    merged = {r.month: r for r in ingest.merge_log(first, second).collect()}
    assert merged[3].status == "ok" and merged[1].records == 7 and len(merged) == 3
    totals = ingest.run_totals(ingest.month_calendar(spark, date(2024, 4, 1), [2024]), first).first()
    assert (totals.total_records, totals.skipped, totals.errors) == (7, 1, 1)


def test_pending_months(spark):
    wanted = spark.createDataFrame([(2024, 1), (2024, 2)], "year int, month int")
    present = spark.createDataFrame([(2024, 1)], "year int, month int")
    assert [tuple(r) for r in ingest.pending_months(wanted, present).collect()] == [(2024, 2)]
    assert ingest.pending_months(wanted, present, skip_existing=False).count() == 2


def test_conform_fills_absent_columns(spark):
    assert conform(spark.createDataFrame([(1,)], "fare int"), RAW_TRIP).first().asDict()["fare"] == "1"
