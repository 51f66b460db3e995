"""Flow queries from mergeable states kept by month, instead of from the trips.

A state is one row per month and group with counts, sums and extremes, so states of
months and groups add up to those of any coarser group; what is counted as distinct
is a key of the states, so distinct counts are exact. Two tables hold them: by time
(neighbourhood, hour, weekday, peak, season) and by place (neighbourhood, cell and
the keys of the breakdowns). Both lie in month partitions: a month that is landed
again replaces its own states and no others, and a query reads states only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanweave.functions.casting import rounded
from urbanweave.operators import flow
from urbanweave.sources.months import exists

TIME_KEYS = ["neighborhood", "hour", "day_of_week", "is_weekend", "is_rush_hour", "season"]
PLACE_KEYS = ["neighborhood", "pickup_h3", *flow.BREAKDOWNS.values()]
TABLES = {"time": TIME_KEYS, "place": PLACE_KEYS}
_MONTH = ["year", "month"]
_MEANS = list(flow.MEAN_MEASURES)


def states(trips: DataFrame, keys: list[str]) -> DataFrame:
    """States of feature trips by month and ``keys``; trips without start time are a month of their own (NULL)."""
    ts = F.col("trip_start_timestamp")
    paid = F.when(F.col("total_amount") > 0, F.col("total_amount"))
    parts = [F.count(F.lit(1)).alias("trips"), F.min(ts).alias("first"), F.max(ts).alias("last")]
    parts += [*flow.partial_means(_MEANS), F.sum(paid).alias("_sum_paid"), F.count(paid).alias("_n_paid")]
    return trips.withColumns({"year": F.year(ts), "month": F.month(ts)}).groupBy(*_MONTH, *keys).agg(*parts)


def refresh(trips: DataFrame, root: str) -> None:
    """Replace the states of the months that ``trips`` holds; ``trips`` must hold all trips of those months.

    The trips are read once per table into their states. Months without a trip in
    ``trips`` keep what they have.
    """
    for name, keys in TABLES.items():
        rows = states(trips, keys)
        writer = rows.hint("rebalance", *_MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*_MONTH).parquet(f"{root}/{name}")


def drop_months(spark: SparkSession, root: str, months: list[tuple[int, int]]) -> None:
    """Empty the states of months (year, month) whose trips are gone; the months stay as empty partitions."""
    for name in TABLES:
        if exists(spark, f"{root}/{name}"):
            held = spark.read.parquet(f"{root}/{name}")
            for year, month in months:
                none = held.drop(*_MONTH).limit(0)
                none.write.mode("overwrite").parquet(f"{root}/{name}/year={year}/month={month}")


def read_states(spark: SparkSession, root: str, name: str, year: int | None = None, month: int | None = None) -> DataFrame:
    """States of table ``name`` (``time`` or ``place``), of all months, one year or one month."""
    held = spark.read.parquet(f"{root}/{name}")
    for column, value in zip(_MONTH, (year, month), strict=True):
        if value is not None:
            held = held.where(F.col(column) == value)
    return held


def _trips() -> Column:
    return F.coalesce(F.sum("trips"), F.lit(0)).alias("total_trips")


def _means(names: list[str]) -> list[Column]:
    return [flow.combined_mean(name) for name in names]


def summary(place: DataFrame) -> DataFrame:
    """As ``flow.summary``, from states by place: first one row per neighbourhood and cell, whatever the months."""
    sums = [f"_{kind}_{name}" for name in ("avg_ticket", "avg_miles", "avg_duration_min") for kind in ("sum", "n")]
    groups = place.groupBy("neighborhood", "pickup_h3").agg(
        F.sum("trips").alias("trips"), F.min("first").alias("first"), F.max("last").alias("last"), *[F.sum(c).alias(c) for c in sums]
    )
    return groups.agg(
        _trips(),
        F.min("first").alias("period_start"),
        F.max("last").alias("period_end"),
        F.count_distinct("neighborhood").alias("total_neighborhoods"),
        F.count_distinct("pickup_h3").alias("total_h3_cells"),
        *_means(["avg_ticket", "avg_miles", "avg_duration_min"]),
    )


def neighborhoods(time: DataFrame) -> DataFrame:
    """As ``flow.neighborhoods``, from states by time."""
    known = time.where(F.col("neighborhood").isNotNull()).groupBy("neighborhood")
    return known.agg(_trips(), *_means(["avg_ticket", "avg_miles", "avg_speed_mph", "avg_tip_pct"])).orderBy(F.col("total_trips").desc(), "neighborhood")


def neighborhood_general(time: DataFrame, name: str) -> DataFrame:
    """As ``flow.neighborhood_general``, from states by time."""
    weekend, rush = (F.coalesce(F.sum(F.when(F.col(key) == 1, F.col("trips"))), F.lit(0)) for key in ("is_weekend", "is_rush_hour"))
    one = time.where(F.col("neighborhood") == name).groupBy("neighborhood")
    return one.agg(_trips(), *_means(_MEANS), weekend.alias("weekend_trips"), rush.alias("rush_trips"))


def _wanted(time: DataFrame, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if value:
            time = time.where(F.col(column) == value)
    return time


def _counted_by(time: DataFrame, key: str) -> DataFrame:
    return time.groupBy(key).agg(F.sum("trips").alias("trips")).orderBy(F.col(key).asc_nulls_last())


def hourly_flow(time: DataFrame, neighborhood: str | None = None, season: str | None = None) -> DataFrame:
    return _counted_by(_wanted(time, neighborhood=neighborhood, season=season), "hour")


def weekly_flow(time: DataFrame, neighborhood: str | None = None) -> DataFrame:
    return _counted_by(_wanted(time, neighborhood=neighborhood), "day_of_week")


def seasonal_flow(time: DataFrame) -> DataFrame:
    known = time.where(F.col("season").isNotNull()).groupBy("season")
    return known.agg(F.sum("trips").alias("trips"), *_means(["avg_ticket"])).orderBy(F.col("trips").desc(), "season")


def rush_flow(time: DataFrame) -> DataFrame:
    by_peak = time.groupBy("is_rush_hour").agg(F.sum("trips").alias("trips"), *_means(["avg_ticket", "avg_miles"]))
    return by_peak.orderBy(F.col("is_rush_hour").asc_nulls_last())


def busiest_neighborhoods(time: DataFrame, n: int = 5) -> DataFrame:
    known = time.where(F.col("neighborhood").isNotNull()).groupBy("neighborhood")
    return known.agg(F.sum("trips").alias("trips")).orderBy(F.col("trips").desc(), "neighborhood").limit(n)


def priciest_neighborhoods(time: DataFrame, n: int = 5) -> DataFrame:
    """Highest mean ticket among trips with a positive total."""
    paid = time.where(F.col("neighborhood").isNotNull()).groupBy("neighborhood").agg(F.sum("_sum_paid").alias("paid"), F.sum("_n_paid").alias("n"))
    ticket = rounded(F.col("paid") / F.col("n"), 2).alias("avg_ticket")
    return paid.where("n > 0").select("neighborhood", ticket).orderBy(F.col("avg_ticket").desc_nulls_last(), "neighborhood").limit(n)


def temporal_breakdowns(time: DataFrame) -> DataFrame:
    return flow.temporal_breakdowns(time, "trips")


def top_origins(place: DataFrame, n: int = 20) -> DataFrame:
    return flow.top_origins(place, n, "trips")


def breakdowns_of_top_origins(place: DataFrame, n: int = 5) -> DataFrame:
    """The breakdowns of the trips that start in one of the ``n`` busiest cells."""
    return flow.temporal_breakdowns(flow.from_top_origins(place, n, "trips"), "trips")
