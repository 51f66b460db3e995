"""Five ordered cleaning rules and the quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanweave.functions.casting import as_columns, half_even, lenient_doubles, lenient_timestamp
from urbanweave.schemas import GEO_COLUMNS, TIME_COLUMNS

# Inclusive limits of the service area, distance, duration and fare.
LAT_RANGE = (41.6, 42.1)
LON_RANGE = (-87.9, -87.5)
MEASURE_RANGES = {
    "trip_miles": (0.0, 100.0),
    "trip_seconds": (60, 7200),
    "fare": (2.50, 500.00),
}

# Rules in the order in which a removal is charged, with their short names in the report.
RULES = {
    "invalid_coordinates": "coordinates",
    "invalid_trip_miles": "miles",
    "invalid_trip_seconds": "seconds",
    "invalid_fare": "fare",
    "invalid_timestamps": "timestamps",
}


def inside_area(latitude: str, longitude: str) -> str:
    """True inside the inclusive box, false outside or on NULL."""
    return (
        f"coalesce({latitude} BETWEEN {LAT_RANGE[0]}D AND {LAT_RANGE[1]}D"
        f" AND {longitude} BETWEEN {LON_RANGE[0]}D AND {LON_RANGE[1]}D, false)"
    )


def first_failed_rule(df: DataFrame) -> Column:
    """Name of the first rule the row breaks, NULL for a clean row.

    A NULL measure passes its rule, as does one whose column is absent.
    """
    number = lenient_doubles(df, GEO_COLUMNS + list(MEASURE_RANGES))
    plat, plon, dlat, dlon = (number[c] for c in GEO_COLUMNS)
    cases = [f"WHEN NOT ({inside_area(plat, plon)} AND {inside_area(dlat, dlon)}) THEN 'invalid_coordinates'"]
    cases += [
        f"WHEN {number[name]} NOT BETWEEN {low}D AND {high}D THEN 'invalid_{name}'"
        for name, (low, high) in MEASURE_RANGES.items()
        if name in number
    ]
    if set(TIME_COLUMNS) <= set(df.columns):
        start, end = (lenient_timestamp(c) for c in TIME_COLUMNS)
        cases.append(f"WHEN {end} < {start} THEN 'invalid_timestamps'")
    return F.expr(f"CASE {' '.join(cases)} END")


def keep_valid(df: DataFrame) -> DataFrame:
    """Rows that pass all rules, with measures cast to double and times to timestamps."""
    valid = df.where(first_failed_rule(df).isNull())
    numbers = lenient_doubles(df, GEO_COLUMNS + list(MEASURE_RANGES))
    times = {c: lenient_timestamp(c) for c in TIME_COLUMNS if c in df.columns}
    return valid.withColumns(as_columns(numbers | times))


def rule_counts(df: DataFrame) -> DataFrame:
    """Rows per first failed rule, ``clean`` for the rest."""
    return df.groupBy(F.coalesce(first_failed_rule(df), F.lit("clean")).alias("rule")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def month_file(ts: Column) -> Column:
    """Name of the month file a start time belongs to."""
    return F.when(ts.isNotNull(), F.format_string("year=%04d/month=%02d/data.parquet", F.year(ts), F.month(ts)))


def quality_report(df: DataFrame, file: Column) -> DataFrame:
    """Counts and percentages per file and a TOTAL row.

    The trips are reduced to one row per file first, so only those are rolled up.
    """
    failed = df.select(file.alias("file"), first_failed_rule(df).alias("failed"))
    per_file = failed.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows_raw"),
        F.count_if(F.col("failed").isNull()).alias("rows_clean"),
        *[F.count_if(F.col("failed") == rule).alias(rule) for rule in RULES],
    )
    counts = ["rows_raw", "rows_clean", *RULES]
    totals = per_file.rollup("file").agg(
        *[F.sum(c).alias(c) for c in counts], F.grouping("file").alias("is_total")
    )
    removed = F.col("rows_raw") - F.col("rows_clean")

    def percent(part: Column) -> Column:
        return F.when(F.col("rows_raw") > 0, half_even(part / F.col("rows_raw") * 100, 2))

    return totals.select(
        F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("file")).alias("file"),
        *counts,
        removed.alias("removed_total"),
        percent(removed).alias("pct_removed"),
        *[percent(F.col(rule)).alias(f"pct_{short}") for rule, short in RULES.items()],
    )
