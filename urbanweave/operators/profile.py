"""Data-quality profile of landed trips, per year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanweave.functions.casting import as_columns, half_even, lenient_doubles, lenient_timestamp, rounded
from urbanweave.operators.cleaning import LAT_RANGE, LON_RANGE, MEASURE_RANGES
from urbanweave.operators.ordering import exact_quantiles
from urbanweave.runtime import settle
from urbanweave.schemas import GEO_COLUMNS, TIME_COLUMNS

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def start_year() -> Column:
    return F.expr(f"year({lenient_timestamp('trip_start_timestamp')})")


def shape_by_year(df: DataFrame) -> DataFrame:
    """Rows and columns per year."""
    width = len(df.columns)
    return (
        df.groupBy(start_year().alias("year"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("columns", F.lit(width))
    )


def nulls_by_year(df: DataFrame) -> DataFrame:
    """Per year the columns that hold NULLs, with count and percent, most first."""
    names = df.columns
    counts = df.groupBy(start_year().alias("_year")).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in names],
    )
    return (
        counts.unpivot(["_year", "_rows"], names, "column", "nulls")
        .where("nulls > 0")
        .select(
            F.col("_year").alias("year"),
            "column",
            "nulls",
            half_even(F.col("nulls") / F.col("_rows") * 100, 2).alias("pct"),
        )
        .orderBy("year", F.col("nulls").desc(), "column")
    )


def is_outlier(df: DataFrame) -> Column:
    """Distance below 0 or from 100 miles up, duration or fare outside its limits."""
    number = lenient_doubles(df, MEASURE_RANGES)
    tests = []
    for name, (low, high) in MEASURE_RANGES.items():
        above = ">=" if name == "trip_miles" else ">"
        tests.append(f"coalesce({number[name]} < {low}D OR {number[name]} {above} {high}D, false)")
    return F.expr(" OR ".join(tests))


def is_pickup_outside(df: DataFrame) -> Column:
    """Pickup outside the box; unlike the cleaning rule, NULL does not count."""
    number = lenient_doubles(df, GEO_COLUMNS)
    lat, lon = number["pickup_centroid_latitude"], number["pickup_centroid_longitude"]
    return F.expr(
        f"coalesce({lat} NOT BETWEEN {LAT_RANGE[0]}D AND {LAT_RANGE[1]}D, false)"
        f" OR coalesce({lon} NOT BETWEEN {LON_RANGE[0]}D AND {LON_RANGE[1]}D, false)"
    )


def is_time_reversed() -> Column:
    start, end = (lenient_timestamp(c) for c in TIME_COLUMNS)
    return F.expr(f"coalesce({end} < {start}, false)")


def issues_by_year(df: DataFrame) -> DataFrame:
    """Invalid coordinates, outliers with percent, and reversed times per year."""
    return (
        df.groupBy(start_year().alias("year"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(is_pickup_outside(df)).alias("invalid_coordinates"),
            F.count_if(is_outlier(df)).alias("outliers"),
            F.count_if(is_time_reversed()).alias("time_inconsistencies"),
        )
        .withColumn("outlier_pct", rounded(F.col("outliers") / F.col("rows") * 100, 2))
    )


def duplicates_by_year(df: DataFrame) -> DataFrame:
    """Rows whose trip_id occurs more than once in the year; every copy counts."""
    copies = df.groupBy(start_year().alias("year"), "trip_id").agg(F.count(F.lit(1)).alias("n"))
    return copies.groupBy("year").agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows")
    )


def describe_columns(df: DataFrame, names: list[str], by: str | None = None) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of numeric columns, one row each.

    With ``by``, a column such as the year, one row per value of it and column;
    rows where it is NULL are left out. The rows are read once, for the counts per
    distinct value; everything follows from those.
    """
    group = F.lit("") if by is None else F.col(by).cast("string")
    numbers = df.withColumns(as_columns(lenient_doubles(df, names))).select(group.alias("_group"), *names)
    values = numbers.unpivot(["_group"], names, "column", "value").where("value is not null and _group is not null")
    keyed = values.withColumn("slot", F.concat_ws("|", "_group", "column"))
    counted = settle(keyed.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n")))
    n, value = F.col("n"), F.col("value")
    sums = counted.groupBy("slot").agg(
        F.sum("n").alias("count"), (F.sum(n * value) / F.sum("n")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    around = counted.join(sums.select("slot", "mean"), "slot")
    spread = F.sum(n * (value - F.col("mean")) * (value - F.col("mean")))
    deviation = around.groupBy("slot").agg(F.when(F.sum("n") > 1, F.sqrt(spread / (F.sum("n") - 1))).alias("std"))
    quartiles = exact_quantiles(counted, "slot", "value", QUARTILES, "n")
    found = sums.join(deviation, "slot").join(quartiles, "slot")
    parts = F.split("slot", r"\|", 2)
    lead = [] if by is None else [parts[0].cast(df.schema[by].dataType).alias(by)]
    return found.select(*lead, parts[1].alias("column"), "count", "mean", "std", "min", *QUARTILES, "max")
