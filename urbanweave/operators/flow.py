"""Aggregate queries over the feature trips.

Means are built from sums and counts, so wherever a finer grouping has few
groups the trips are read once into it and the answer comes from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanweave.functions.casting import rounded
from urbanweave.runtime import settle, small_side

# Measures shown as means, with the expression they average.
MEAN_MEASURES = {
    "avg_ticket": "total_amount",
    "avg_miles": "trip_miles",
    "avg_duration_min": "trip_seconds / 60.0D",
    "avg_speed_mph": "speed_mph",
    "avg_tip_pct": "tip_percentage",
}


def _rows(weight: str | None = None) -> Column:
    """Number of rows, or of the trips that counted rows stand for."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def mean_of(name: str, digits: int = 2) -> Column:
    return rounded(F.avg(F.expr(MEAN_MEASURES[name])), digits).alias(name)


def partial_means(names: list[str]) -> list[Column]:
    """Sum and count of each measure, to be combined by ``combined_mean``."""
    parts = []
    for name in names:
        value = F.expr(MEAN_MEASURES[name])
        parts += [F.sum(value).alias(f"_sum_{name}"), F.count(value).alias(f"_n_{name}")]
    return parts


def combined_mean(name: str, digits: int = 2) -> Column:
    total, n = F.sum(f"_sum_{name}"), F.sum(f"_n_{name}")
    return rounded(F.when(n > 0, total / n), digits).alias(name)


def _filtered(trips: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters for the arguments that were given and are not empty."""
    for column, value in wanted.items():
        if value:
            trips = trips.where(F.col(column) == value)
    return trips


def summary(trips: DataFrame) -> DataFrame:
    """One row: trips, period, distinct neighbourhoods and pickup cells, mean ticket, miles, minutes.

    Distinct counts come from one row per (neighbourhood, cell), so the trips
    are aggregated once instead of once per distinct count.
    """
    means = ["avg_ticket", "avg_miles", "avg_duration_min"]
    ts = F.col("trip_start_timestamp")
    groups = trips.groupBy("neighborhood", "pickup_h3").agg(
        _rows().alias("_trips"),
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
        *partial_means(means),
    )
    return groups.agg(
        F.coalesce(F.sum("_trips"), F.lit(0)).alias("total_trips"),
        F.min("_first").alias("period_start"),
        F.max("_last").alias("period_end"),
        F.count_distinct("neighborhood").alias("total_neighborhoods"),
        F.count_distinct("pickup_h3").alias("total_h3_cells"),
        *[combined_mean(m) for m in means],
    )


def neighborhoods(trips: DataFrame) -> DataFrame:
    """Trips and mean ticket, miles, speed and tip share per neighbourhood, busiest first."""
    means = ["avg_ticket", "avg_miles", "avg_speed_mph", "avg_tip_pct"]
    return (
        trips.where(F.col("neighborhood").isNotNull())
        .groupBy("neighborhood")
        .agg(_rows().alias("total_trips"), *[mean_of(m) for m in means])
        .orderBy(F.col("total_trips").desc(), "neighborhood")
    )


def neighborhood_general(trips: DataFrame, name: str) -> DataFrame:
    """All means and the weekend and rush trips of one neighbourhood; empty when unknown."""
    return (
        trips.where(F.col("neighborhood") == name)
        .groupBy("neighborhood")
        .agg(
            _rows().alias("total_trips"),
            *[mean_of(m) for m in MEAN_MEASURES],
            F.count_if(F.col("is_weekend") == 1).alias("weekend_trips"),
            F.count_if(F.col("is_rush_hour") == 1).alias("rush_trips"),
        )
    )


def neighborhood_detail(trips: DataFrame, name: str) -> DataFrame:
    """One nested row (general, hourly, weekly); empty for an unknown name.

    The trips are read once, into one row per hour and weekday.
    """
    means = list(MEAN_MEASURES)
    groups = (
        trips.where(F.col("neighborhood") == name)
        .groupBy("neighborhood", "hour", "day_of_week")
        .agg(
            _rows().alias("trips"),
            F.count_if(F.col("is_weekend") == 1).alias("_weekend"),
            F.count_if(F.col("is_rush_hour") == 1).alias("_rush"),
            *partial_means(means),
        )
    )
    keys = ["neighborhood", "hour", "day_of_week"]
    per_all, per_hour, per_day = [["neighborhood"], keys[:2], [keys[0], keys[2]]]
    sets = groups.groupingSets(
        [[F.col(k) for k in part] for part in (per_all, per_hour, per_day)], *[F.col(k) for k in keys]
    ).agg(
        F.sum("trips").alias("total_trips"),
        *[combined_mean(m) for m in means],
        F.sum("_weekend").alias("weekend_trips"),
        F.sum("_rush").alias("rush_trips"),
        F.grouping("hour").alias("_off_hour"),
        F.grouping("day_of_week").alias("_off_day"),
    )
    general = ["neighborhood", "total_trips", *means, "weekend_trips", "rush_trips"]
    overall = (F.col("_off_hour") == 1) & (F.col("_off_day") == 1)

    def entries(key: str, off: str) -> Column:
        # At most 25 keys, so each list is short; a missing key goes last.
        entry = F.struct(F.col(key).isNull().alias("_missing"), key, F.col("total_trips").alias("trips"))
        ordered = F.sort_array(F.collect_list(F.when(F.col(off) == 0, entry)))
        return F.transform(ordered, lambda e: F.struct(e[key].alias(key), e["trips"].alias("trips")))

    nested = sets.groupBy("neighborhood").agg(
        F.max(F.when(overall, F.struct(*general))).alias("general"),
        entries("hour", "_off_hour").alias("hourly"),
        entries("day_of_week", "_off_day").alias("weekly"),
    )
    return nested.drop("neighborhood")


def _counted_by(trips: DataFrame, key: str) -> DataFrame:
    return trips.groupBy(key).agg(_rows().alias("trips")).orderBy(F.col(key).asc_nulls_last())


def hourly_flow(trips: DataFrame, neighborhood: str | None = None, season: str | None = None) -> DataFrame:
    """Trips per hour of day."""
    return _counted_by(_filtered(trips, neighborhood=neighborhood, season=season), "hour")


def weekly_flow(trips: DataFrame, neighborhood: str | None = None) -> DataFrame:
    """Trips per weekday (0 = Monday)."""
    return _counted_by(_filtered(trips, neighborhood=neighborhood), "day_of_week")


def seasonal_flow(trips: DataFrame) -> DataFrame:
    """Trips and mean ticket per season, busiest first."""
    return (
        trips.where(F.col("season").isNotNull())
        .groupBy("season")
        .agg(_rows().alias("trips"), mean_of("avg_ticket"))
        .orderBy(F.col("trips").desc(), "season")
    )


def rush_flow(trips: DataFrame) -> DataFrame:
    """Trips, mean ticket and miles in and outside the peak hours."""
    return (
        trips.groupBy("is_rush_hour")
        .agg(_rows().alias("trips"), mean_of("avg_ticket"), mean_of("avg_miles"))
        .orderBy(F.col("is_rush_hour").asc_nulls_last())
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    counted = [t.agg(_rows().alias("rows")).select(F.lit(name).alias("table"), "rows") for name, t in tables.items()]
    result = counted[0]
    for other in counted[1:]:
        result = result.unionByName(other)
    return result


def busiest_neighborhoods(trips: DataFrame, n: int = 5) -> DataFrame:
    return (
        trips.where(F.col("neighborhood").isNotNull())
        .groupBy("neighborhood")
        .agg(_rows().alias("trips"))
        .orderBy(F.col("trips").desc(), "neighborhood")
        .limit(n)
    )


def priciest_neighborhoods(trips: DataFrame, n: int = 5) -> DataFrame:
    """Highest mean ticket among trips with a positive total."""
    return (
        trips.where(F.col("neighborhood").isNotNull() & (F.col("total_amount") > 0))
        .groupBy("neighborhood")
        .agg(mean_of("avg_ticket"))
        .orderBy(F.col("avg_ticket").desc_nulls_last(), "neighborhood")
        .limit(n)
    )


def top_origins(trips: DataFrame, n: int = 20, weight: str | None = None) -> DataFrame:
    """Pickup cells with the most trips; ``weight`` names a column of counts."""
    return (
        trips.where(F.col("pickup_h3").isNotNull())
        .groupBy("pickup_h3")
        .agg(_rows(weight).alias("trips"))
        .orderBy(F.col("trips").desc(), "pickup_h3")
        .limit(n)
    )


def from_top_origins(trips: DataFrame, n: int = 20, weight: str | None = None) -> DataFrame:
    """Trips that start in one of the ``n`` busiest pickup cells."""
    return trips.join(small_side(top_origins(trips, n, weight).select("pickup_h3"), n), "pickup_h3", "left_semi")


# Breakdown name, key column.
BREAKDOWNS = {
    "hourly_flow": "hour",
    "weekend_flow": "is_weekend",
    "rush_flow": "is_rush_hour",
    "seasonal_flow": "season",
}


def temporal_breakdowns(trips: DataFrame, weight: str | None = None) -> DataFrame:
    """Trips by hour, weekend, peak and season as (breakdown, key, trips); NULL keys left out.

    The trips are counted once per combination of the four keys; the grouping
    sets then run on those few rows.
    """
    keys = list(BREAKDOWNS.values())
    combos = trips.groupBy(*keys).agg(_rows(weight).alias("trips"))
    sets = combos.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(
        F.sum("trips").alias("trips"), *[F.grouping(k).alias(f"_off_{k}") for k in keys]
    )
    name, value = F, F
    for breakdown, key in BREAKDOWNS.items():
        here = F.col(f"_off_{key}") == 0
        name, value = name.when(here, breakdown), value.when(here, F.col(key).cast("string"))
    return sets.select(name.alias("breakdown"), value.alias("key"), "trips").where(F.col("key").isNotNull())


def temporal_report(trips: DataFrame, top_n: int = 20, top_only: bool = False) -> DataFrame:
    """One nested row with the four breakdowns and the busiest pickup cells.

    ``top_only`` restricts the breakdowns to trips from those cells. The trips are
    read once, into counts per cell and breakdown keys, from which all follows.
    """
    counted = settle(trips.groupBy("pickup_h3", *BREAKDOWNS.values()).agg(_rows().alias("n")))
    rows = temporal_breakdowns(from_top_origins(counted, top_n, "n") if top_only else counted, "n")
    lists = []
    for breakdown, key in BREAKDOWNS.items():
        typed = F.col("key") if key == "season" else F.col("key").cast("int")
        entry = F.when(F.col("breakdown") == breakdown, F.struct(typed.alias(key), "trips"))
        lists.append(F.sort_array(F.collect_list(entry)).alias(breakdown))
    # top_n rows at most
    busiest = top_origins(counted, top_n, "n").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("trips")).alias("_order"), "pickup_h3"))).alias("cells")
    )
    cells = busiest.select(F.transform("cells", lambda c: c["pickup_h3"]))
    return rows.agg(*lists).withColumn("top_h3_cells", cells.scalar())


def run_sql(spark: SparkSession, statement: str, **params) -> DataFrame:
    """A statement with named parameters (``:name``); values are bound, never spliced in."""
    return spark.sql(statement, args=params)
