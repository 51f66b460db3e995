"""Column contracts of the trip, graph and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and their order in the table contracts.
GEO_COLUMNS = [
    "pickup_centroid_latitude",
    "pickup_centroid_longitude",
    "dropoff_centroid_latitude",
    "dropoff_centroid_longitude",
]
TIME_COLUMNS = ["trip_start_timestamp", "trip_end_timestamp"]
AMOUNT_COLUMNS = ["trip_seconds", "trip_miles", "fare", "tips", "tolls", "extras", "trip_total"]
AREA_COLUMNS = ["pickup_community_area", "dropoff_community_area"]


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


_STRING, _DOUBLE, _INT, _LONG = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()

TRIP = T.StructType(
    _fields(_STRING, "trip_id", "taxi_id")
    + _fields(T.TimestampNTZType(), *TIME_COLUMNS)
    + _fields(_DOUBLE, *AMOUNT_COLUMNS)
    + _fields(_STRING, "payment_type", "company")
    + _fields(_DOUBLE, *AREA_COLUMNS, *GEO_COLUMNS)
    + _fields(_STRING, "pickup_census_tract", "dropoff_census_tract")
)

# As landed: any value may still be text.
RAW_TRIP = T.StructType(_fields(_STRING, *TRIP.names))

FEATURES = T.StructType(
    _fields(_INT, "hour", "day_of_week", "month", "is_weekend", "is_rush_hour")
    + _fields(_STRING, "season")
    + _fields(_INT, "is_holiday")
    + _fields(_DOUBLE, "speed_mph", "fare_per_mile", "tip_percentage", "total_amount")
    + _fields(_STRING, "pickup_h3", "dropoff_h3")
    + _fields(_DOUBLE, "h3_distance")
    + _fields(_STRING, "neighborhood")
)

FEATURE_TRIP = T.StructType(TRIP.fields + FEATURES.fields)

EDGE_LIST = T.StructType(_fields(_STRING, "pickup_h3", "dropoff_h3") + _fields(_LONG, "weight"))

NODE_METRICS = T.StructType(
    _fields(_STRING, "h3_cell")
    + _fields(
        _DOUBLE,
        "in_strength",
        "out_strength",
        "total_flow",
        "pagerank",
        "betweenness",
        "betweenness_norm",
    )
    + _fields(_INT, "rank")
)

COMMUNITIES = T.StructType(_fields(_STRING, "h3_cell") + _fields(_INT, "community", "community_size"))

DOWNLOAD_LOG = T.StructType(
    _fields(_INT, "year", "month")
    + _fields(_LONG, "records")
    + _fields(_STRING, "status")
    + _fields(_DOUBLE, "elapsed_seconds")
    + _fields(_STRING, "downloaded_at")
)

GRAPH_TABLES = {
    "node_metrics": NODE_METRICS,
    "communities": COMMUNITIES,
    "edge_list": EDGE_LIST,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Give ``df`` exactly the columns of ``schema``; absent ones, and values that do not fit, become typed NULLs."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def keep_listed(df: DataFrame, names: list[str]) -> DataFrame:
    """Project to the listed columns that exist, in the listed order."""
    present = set(df.columns)
    return df.select(*[name for name in names if name in present])
