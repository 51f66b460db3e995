"""Trip-shaped views of the ``events`` table (FIXTURES.md section 6).

``trips`` is typed; ``landed`` is the same feed as text, with copies of trips,
missing ids, and unreadable positions, times and amounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from urbanweave.operators.cleaning import keep_valid
from urbanweave.plans.jobs import add_all_features
from urbanweave.schemas import RAW_TRIP, TRIP

# Stops lie on a lattice, so pickup and dropoff cells coincide.
STOPS = 41


_PICKUP = f"(user_id % {STOPS})"
# The position rule uses this up to four times per row, so it must be cheaper than parsing JSON.
_DROPOFF = f"""(try_cast(regexp_extract(props, r'"k": *(-?[0-9]+)', 1) AS bigint) % {STOPS})"""
_DAYS = "cast(event_id % 730 AS int)"

_COLUMNS = {
    "trip_id": "concat('t', cast(event_id AS string))",
    "trip_start_timestamp": f"ts + make_dt_interval({_DAYS})",
    "trip_end_timestamp": f"ts + make_dt_interval({_DAYS}, 0, 0, cast(event_id * 37 % 9000 - 60 AS int))",
    "trip_seconds": "CASE WHEN event_id % 41 <> 0 THEN cast(event_id * 37 % 9000 AS double) END",
    "trip_miles": "CASE WHEN event_id % 43 <> 0 THEN cast(event_id * 7 % 1050 AS double) / 8 END",
    "fare": "CASE WHEN event_id % 53 <> 0 THEN value END",
    "tips": "CASE WHEN event_id % 47 <> 0 THEN cast(event_id % 9 AS double) END",
    "pickup_community_area": "cast(user_id % 80 AS double)",
    "pickup_centroid_latitude": f"41.57D + cast({_PICKUP} AS double) * 0.0129D",
    "pickup_centroid_longitude": f"-87.89D + cast({_PICKUP} * 7 % {STOPS} AS double) * 0.0095D",
    "dropoff_centroid_latitude": f"41.57D + cast({_DROPOFF} AS double) * 0.0129D",
    "dropoff_centroid_longitude": f"-87.89D + cast({_DROPOFF} * 7 % {STOPS} AS double) * 0.0095D",
}

_DIRT = {
    "trip_id": """CASE WHEN event_id % 97 = 0 THEN NULL
        WHEN event_id % 10 = 3 THEN concat('t', cast(event_id - 1 AS string)) ELSE trip_id END""",
    "trip_start_timestamp": "CASE WHEN event_id % 59 = 0 THEN 'not a time' ELSE trip_start_timestamp END",
    "trip_miles": "CASE WHEN event_id % 61 = 0 THEN '12d' WHEN event_id % 67 = 0 THEN 'NaN' ELSE trip_miles END",
    "tolls": "CASE WHEN event_id % 71 = 0 THEN 'n/a' WHEN event_id % 73 = 0 THEN '1.5' END",
    "pickup_centroid_latitude": """CASE WHEN event_id % 29 = 0 THEN ' ' WHEN event_id % 31 = 0 THEN 'n/a'
        WHEN event_id % 37 = 0 THEN NULL ELSE pickup_centroid_latitude END""",
}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    shaped = [
        f"{_COLUMNS[f.name]} AS {f.name}"
        if f.name in _COLUMNS
        else f"cast(NULL AS {f.dataType.simpleString()}) AS {f.name}"
        for f in TRIP.fields
    ]
    return _events(spark, sf_dir).selectExpr(*shaped)


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_text = [f"cast({_COLUMNS.get(f.name, 'NULL')} AS string) AS {f.name}" for f in RAW_TRIP.fields]
    dirty = [f"{_DIRT.get(f.name, f.name)} AS {f.name}" for f in RAW_TRIP.fields]
    return _events(spark, sf_dir).selectExpr("event_id", *as_text).selectExpr(*dirty)


def clean_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_valid(trips(spark, sf_dir))


def feature_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_all_features(clean_trips(spark, sf_dir))
