"""Positions, running totals and exact quantiles over a whole table.

A window without partitions would sort everything in one task. Here the sort is
range-partitioned, and only one row per partition is combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanweave.runtime import settle

# monotonically_increasing_id keeps the partition above this bit and the row below it.
_ROW_BITS = 33


def _before(per_part: DataFrame, value: str) -> DataFrame:
    """Total of ``value`` in all earlier partitions; one row per partition, so one task is enough."""
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    total = F.coalesce(F.sum(value).over(earlier), F.lit(0))
    return F.broadcast(per_part.select("_part", total.alias("_before")))


def with_position(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of every row in the total order ``order``."""
    placed = settle(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", _ROW_BITS))
    per_part = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    in_part = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(_before(per_part, "_rows"), "_part")
        .withColumn(name, F.col("_before") + in_part + 1)
        .drop("_id", "_part", "_before")
    )


def with_running_total(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the total of ``value`` over all rows before each row in ``order``."""
    placed = settle(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    per_part = placed.groupBy("_part").agg(F.sum(value).alias("_value"))
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(_before(per_part, "_value"), "_part")
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_part", "_before", "_within")
    )


def exact_quantiles(values: DataFrame, key: str, value: str, points: dict[str, float], weight: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per ``key``, one column per point.

    Works on counts per distinct value; NULLs do not count. ``weight`` names a
    column that says how often a row counts. Meant for few keys, such as column
    names, each of any size.
    """
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(times.alias("_n"))
    running = with_running_total(counted, [key, value], "_n", "_seen")
    # One row per key: where its values start in the running total, and how many there are.
    spans = running.groupBy(key).agg(F.min("_seen").alias("_start"), F.sum("_n").alias("_all"))
    placed = running.join(F.broadcast(spans), key).withColumn("_first", F.col("_seen") - F.col("_start"))

    def value_at(index: Column) -> Column:
        inside = (F.col("_first") <= index) & (index < F.col("_first") + F.col("_n"))
        return F.max(F.when(inside, F.col(value)))

    bounds, results = [], []
    for name, point in points.items():
        at = (F.col("_all") - 1) * point
        bounds += [
            value_at(F.floor(at)).alias(f"_low_{name}"),
            value_at(F.ceil(at)).alias(f"_high_{name}"),
            F.max(at - F.floor(at)).alias(f"_step_{name}"),
        ]
        low, high, step = (F.col(f"_{part}_{name}") for part in ("low", "high", "step"))
        results.append((low + (high - low) * step).alias(name))
    return placed.groupBy(key).agg(*bounds).select(key, *results)
