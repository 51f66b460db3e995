"""Month-partitioned Parquet: readers, scope selection and the sink."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanweave.runtime import small_tasks
from urbanweave.schemas import RAW_TRIP, conform

MONTH_SCHEMA = T.StructType([T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())])


def read_landed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed source files with every declared column, as text; absent ones are NULL.

    JSON is read with the declared schema, so no pass is spent on inference.
    """
    if fmt == "json":
        return spark.read.schema(RAW_TRIP).json(path)
    return conform(spark.read.format(fmt).option("mergeSchema", True).load(path), RAW_TRIP)


def read_months(spark: SparkSession, root: str, year: int | None = None, month: int | None = None) -> DataFrame:
    """All months below ``root``, one year, or one month (pruned by partition)."""
    return in_scope(spark.read.parquet(root), year, month)


def in_scope(df: DataFrame, year: int | None, month: int | None = None, names: tuple[str, str] = ("year", "month")):
    if year is not None:
        df = df.where(F.col(names[0]) == year)
    if month is not None:
        df = df.where(F.col(names[1]) == month)
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet data set can be read from ``path``."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def present_months(spark: SparkSession, root: str, names: tuple[str, str] = ("year", "month")) -> DataFrame:
    """(year, month) below ``root`` that were written; none when nothing was yet.

    Taken from the folder names, so no file is opened. Rows without a start time
    lie outside all months.
    """
    if not exists(spark, root):
        return spark.createDataFrame([], MONTH_SCHEMA)
    folder = re.compile(f"/{names[0]}=([0-9]+)/{names[1]}=([0-9]+)/")
    found = {folder.search(path) for path in spark.read.parquet(root).inputFiles()}
    months = sorted({(int(m[1]), int(m[2])) for m in found if m})
    return spark.createDataFrame(months, MONTH_SCHEMA)


def write_months(trips: DataFrame, root: str, names: tuple[str, str] = ("year", "month")) -> None:
    """Write Snappy Parquet as <year>=YYYY/<month>=MM; only the written months are replaced.

    Rows without a start time go to the partition of the NULL month. The rebalance hint gathers each month into few files and lets AQE split a
    month that is much larger than the others.
    """
    year, month = names
    ts = F.col("trip_start_timestamp")
    parted = trips.withColumns(
        {year: F.year(ts).cast("string"), month: F.lpad(F.month(ts).cast("string"), 2, "0")}
    )
    with small_tasks(trips.sparkSession):
        (
            parted.hint("rebalance", year, month)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "snappy")
            .partitionBy(year, month)
            .parquet(root)
        )
