"""Landing: casts, duplicate removal, month calendar and run log."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanweave.functions.casting import as_columns, lenient_doubles, lenient_timestamp, share_pct
from urbanweave.schemas import DOWNLOAD_LOG, GEO_COLUMNS, TIME_COLUMNS, conform

# First landed year, and the first year served by the current source.
FIRST_YEAR = 2022
CURRENT_SOURCE_FROM = 2024


def month_scan(df: DataFrame, year: int, month: int) -> DataFrame:
    """Trips starting in [month, next month), earliest first."""
    start = F.lit(date(year, month, 1)).cast("timestamp_ntz")
    end = F.lit(date(year + month // 12, month % 12 + 1, 1)).cast("timestamp_ntz")
    ts = F.expr(lenient_timestamp("trip_start_timestamp"))
    return df.where((ts >= start) & (ts < end)).orderBy(ts, "trip_id")


def route_sources(historical: DataFrame, current: DataFrame) -> DataFrame:
    """Years before the change from the historical source, later ones from the current one."""
    year = F.expr(f"year({lenient_timestamp('trip_start_timestamp')})")
    old = historical.where(year < CURRENT_SOURCE_FROM)
    new = current.where(year >= CURRENT_SOURCE_FROM)
    return old.unionByName(new, allowMissingColumns=True)


def latest_trips(current: DataFrame, n: int = 1000) -> DataFrame:
    """The ``n`` trips that started last."""
    ts = F.expr(lenient_timestamp("trip_start_timestamp"))
    return current.orderBy(ts.desc_nulls_last(), "trip_id").limit(n)


def drop_missing_geo(df: DataFrame) -> DataFrame:
    """Cast the geo columns to double and drop rows where one is missing, blank or no number."""
    numbers = lenient_doubles(df, GEO_COLUMNS)
    return df.withColumns(as_columns(numbers)).dropna(subset=list(numbers)) if numbers else df


def cast_times(df: DataFrame) -> DataFrame:
    """Start and end as timestamps; unreadable ones become NULL, the row stays."""
    return df.withColumns(as_columns({c: lenient_timestamp(c) for c in TIME_COLUMNS if c in df.columns}))


def _keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    # row_number = 1 lets Spark cut each map task to one row per key before the
    # shuffle, so a key with very many copies does not load a single task.
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order, *keys)))
    return ranked.where("_rn = 1").drop("_rn")


def dedup_first(df: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """One row per trip_id: the earliest start; remaining columns break ties.

    All rows without id count as copies of one another. ``within`` names columns,
    such as the month, inside which copies are looked for.
    """
    if "trip_id" not in df.columns:
        return df
    lead = ["trip_start_timestamp"] if "trip_start_timestamp" in df.columns else []
    others = [c for c in df.columns if c not in ("trip_id", *lead, *within)]
    return _keep_one(df, [*within, "trip_id"], [F.col(c).asc_nulls_last() for c in lead + others])


def clean_and_cast(df: DataFrame) -> DataFrame:
    """Landing clean-up: geo present and numeric, times cast, first copy of each trip."""
    return dedup_first(cast_times(drop_missing_geo(df)))


def dedup_for_load(df: DataFrame) -> DataFrame:
    """Rows fit for a table keyed by trip_id."""
    return dedup_first(df.where(F.col("trip_id").isNotNull()))


def ingest_loss(landed: DataFrame) -> DataFrame:
    """One row: rows landed, kept by clean_and_cast, removed, and percent removed."""
    numbers = lenient_doubles(landed, GEO_COLUMNS).values()
    placed = F.expr(" AND ".join(f"{number} IS NOT NULL" for number in numbers) or "true")
    per_id = landed.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("copies"), F.max(placed).alias("placed")
    )
    totals = per_id.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("original"), F.count_if("placed").alias("kept")
    )
    removed = F.col("original") - F.col("kept")
    return totals.withColumns({"removed": removed, "pct_removed": share_pct(removed, F.col("original"))})


def month_calendar(
    spark: SparkSession,
    today: date,
    years: list[int] | None = None,
    months: list[int] | None = None,
) -> DataFrame:
    """(year, month) to process: the asked ones that are not in the future."""
    years = years or list(range(FIRST_YEAR, today.year + 1))
    months = months or list(range(1, 13))
    first, last = date(min(years), 1, 1), date(max(years), 12, 1)
    steps = F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 month"))
    return (
        spark.range(1)
        .select(F.explode(steps).alias("first_day"))
        .where(F.col("first_day") <= F.lit(today))
        .select(F.year("first_day").alias("year"), F.month("first_day").alias("month"))
        .where(F.col("year").isin(years) & F.col("month").isin(months))
    )


def pending_months(wanted: DataFrame, present: DataFrame, skip_existing: bool = True) -> DataFrame:
    """Wanted months that are not present yet; all of them when nothing may be skipped."""
    if not skip_existing:
        return wanted
    return wanted.join(present.select("year", "month").distinct(), ["year", "month"], "left_anti")


def month_counts(trips: DataFrame) -> DataFrame:
    """(year, month, records) of the start times."""
    ts = F.col("trip_start_timestamp")
    return (
        trips.where(ts.isNotNull())
        .groupBy(F.year(ts).alias("year"), F.month(ts).alias("month"))
        .agg(F.count(F.lit(1)).alias("records"))
    )


def run_log(
    processed: DataFrame,
    counts: DataFrame,
    finished_at: str,
    elapsed_seconds: float | None = None,
    failures: DataFrame | None = None,
) -> DataFrame:
    """One log row per processed month: ok, empty, or ``error: message`` from ``failures``.

    Rows of ``failures`` without a message are months that went well; a column
    ``seconds`` of it has the time of each month, in place of that of the whole run.
    """
    joined = processed.join(counts, ["year", "month"], "left")
    told = ["message", "seconds"]
    if failures is not None:
        joined = joined.join(failures.select("year", "month", *[c for c in told if c in failures.columns]), ["year", "month"], "left")
    for name, kind in zip(told, ("string", "double"), strict=True):
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(None).cast(kind))
    failed = F.col("message").isNotNull()
    records = F.when(failed, 0).otherwise(F.coalesce("records", F.lit(0)))
    status = (
        F.when(failed, F.concat(F.lit("error: "), "message")).when(records == 0, "empty").otherwise("ok")
    )
    return conform(
        joined.select(
            "year",
            "month",
            records.alias("records"),
            status.alias("status"),
            F.when(status == "ok", F.round(F.coalesce("seconds", F.lit(elapsed_seconds).cast("double")), 1)).alias("elapsed_seconds"),
            F.lit(finished_at).alias("downloaded_at"),
        ),
        DOWNLOAD_LOG,
    )


def merge_log(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append ``new``; the last entry of each month wins, the new batch over the old."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    last_first = [
        F.col("_batch").desc(),
        F.col("downloaded_at").desc_nulls_last(),
        F.col("records").desc_nulls_last(),
        F.col("status").desc_nulls_last(),
    ]
    return _keep_one(both, ["year", "month"], last_first).drop("_batch")


def run_totals(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """One row: records landed, months skipped, months failed."""
    return (
        wanted.join(log, ["year", "month"], "left")
        .agg(
            F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"),
            F.count_if(F.col("status").isNull()).alias("skipped"),
            F.count_if(F.col("status").startswith("error")).alias("errors"),
        )
    )


def data_range(trips: DataFrame) -> DataFrame:
    """Oldest and newest start time."""
    ts = F.col("trip_start_timestamp")
    return trips.agg(F.min(ts).alias("oldest"), F.max(ts).alias("newest"))
