"""Flow queries answered from the monthly states, as queries over the sample tables.

The states are built once per session and folder of tables, from trips of which every
third of one month is missing at first; then that month is landed again as a whole, so
its states must be replaced and the others stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanweave.operators import cube
from urbanweave.plans import sample_trips as sample
from urbanweave.runtime import settle, shared_folder

NEIGHBORHOOD, SEASON = "Lincoln Park", "Winter"
_ROOTS: dict[tuple[str, str], str] = {}


def cube_root(spark: SparkSession, sf: str) -> str:
    """Folder of the states, built when first asked for."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ROOTS:
        root = f"{shared_folder(spark).rstrip('/')}/cube-{uuid.uuid4().hex}"
        trips = settle(sample.feature_trips(spark, sf))
        again = (F.year("trip_start_timestamp") == 2024) & (F.month("trip_start_timestamp") == 12)
        cube.refresh(trips.where(~F.coalesce(again, F.lit(False)) | (F.pmod(F.xxhash64("trip_id"), F.lit(3)) > 0)), root)
        cube.refresh(trips.where(again), root)
        _ROOTS[key] = root
    return _ROOTS[key]


def _time(spark: SparkSession, sf: str) -> DataFrame:
    return cube.read_states(spark, cube_root(spark, sf), "time")


def _place(spark: SparkSession, sf: str) -> DataFrame:
    return cube.read_states(spark, cube_root(spark, sf), "place")


# Name of the query that gives the same rows from the trips, and how the states give them.
CUBE_QUERIES = {
    "summary": lambda spark, sf: cube.summary(_place(spark, sf)),
    "neighborhoods": lambda spark, sf: cube.neighborhoods(_time(spark, sf)),
    "neighborhood_general": lambda spark, sf: cube.neighborhood_general(_time(spark, sf), NEIGHBORHOOD),
    "flow_hourly": lambda spark, sf: cube.hourly_flow(_time(spark, sf)),
    "flow_hourly_filtered": lambda spark, sf: cube.hourly_flow(_time(spark, sf), NEIGHBORHOOD, SEASON),
    "flow_weekly": lambda spark, sf: cube.weekly_flow(_time(spark, sf)),
    "flow_weekly_filtered": lambda spark, sf: cube.weekly_flow(_time(spark, sf), NEIGHBORHOOD),
    "flow_seasonal": lambda spark, sf: cube.seasonal_flow(_time(spark, sf)),
    "flow_rush": lambda spark, sf: cube.rush_flow(_time(spark, sf)),
    "top5_trips": lambda spark, sf: cube.busiest_neighborhoods(_time(spark, sf)),
    "top5_ticket": lambda spark, sf: cube.priciest_neighborhoods(_time(spark, sf)),
    "temporal_breakdowns": lambda spark, sf: cube.temporal_breakdowns(_time(spark, sf)),
    "top_origins": lambda spark, sf: cube.top_origins(_place(spark, sf)),
}
