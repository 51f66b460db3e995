"""The batch jobs as queries: each returns what a job has written.

The jobs run once per session and folder of tables, every step twice, so that
a second run must add nothing; what they write lies in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanweave.plans import jobs
from urbanweave.plans import sample_trips as sample
from urbanweave.runtime import settle, shared_folder
from urbanweave.schemas import DOWNLOAD_LOG, FEATURE_TRIP
from urbanweave.sources import tables
from urbanweave.sources.months import read_landed

#: The month of the scoped run.
SCOPE = (2024, 12)
#: Rows of a landed file at most.
FEED_ROWS = 200_000
_RUNS: dict[tuple[str, str], str] = {}


def write_feed(landed: DataFrame, path: str) -> None:
    """Landed rows as packed JSON. Packed files cannot be split, so none has more rows than a task should read."""
    landed.write.option("compression", "gzip").option("maxRecordsPerFile", FEED_ROWS).json(path)


def _ran(spark: SparkSession, sf: str, today) -> str:
    """Folder of the written jobs, run when first asked for."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        base = f"{shared_folder(spark).rstrip('/')}/jobs-{uuid.uuid4().hex}"
        write_feed(sample.landed(spark, sf), f"{base}/feed")
        for _ in range(2):
            jobs.land(read_landed(spark, f"{base}/feed"), f"{base}/landed", today)
        for turn in range(2):
            report = jobs.clean(spark, f"{base}/landed", f"{base}/clean")
            if not turn:
                tables.write_csv(report, f"{base}/report")
            jobs.featurize(spark, f"{base}/clean", f"{base}/features")
        _RUNS[key] = base
    return _RUNS[key]


def job_landed(spark: SparkSession, sf: str, today) -> DataFrame:
    landed = spark.read.parquet(f"{_ran(spark, sf, today)}/landed")
    return landed.select("trip_id", "trip_start_timestamp", "trip_miles", "tolls", "year", "month")


def job_log(spark: SparkSession, sf: str, today) -> DataFrame:
    log = tables.read_csv(spark, f"{_ran(spark, sf, today)}/landed_log_csv", DOWNLOAD_LOG)
    return log.select("year", "month", "records", "status")


def job_loss(spark: SparkSession, sf: str, today) -> DataFrame:
    loss = tables.read_csv(spark, f"{_ran(spark, sf, today)}/landed_loss_csv", _LOSS)
    return loss.select("original", "kept", "removed")


def job_clean(spark: SparkSession, sf: str, today) -> DataFrame:
    clean = spark.read.parquet(f"{_ran(spark, sf, today)}/clean")
    return clean.select("trip_id", "trip_start_timestamp", "trip_seconds", "fare", "year", "month")


def job_report(spark: SparkSession, sf: str, today) -> DataFrame:
    """Rows of the written report, without those of the file of the undated rows and the total."""
    report = spark.read.option("header", True).csv(f"{_ran(spark, sf, today)}/report")
    return report.where("file LIKE 'year=%'").select("file", F.col("rows_raw").cast("bigint"), F.col("rows_clean").cast("bigint"))


def job_features(spark: SparkSession, sf: str, today) -> DataFrame:
    features = spark.read.parquet(f"{_ran(spark, sf, today)}/features")
    return features.select("trip_id", "hour", "neighborhood", "fare_per_mile", "pickup_h3", "p_year", "p_month")


def job_loaded(spark: SparkSession, sf: str, today) -> DataFrame:
    """The serving table after loading the features twice."""
    base = _ran(spark, sf, today)
    table = f"trips_{uuid.uuid4().hex}"
    tables.create_table(spark, table, FEATURE_TRIP, f"{base}/{table}")
    for _ in range(2):
        tables.append_trips(spark.read.parquet(f"{base}/features"), table)
    spark.catalog.refreshTable(table)
    return spark.table(table).select("trip_id", "trip_start_timestamp", "neighborhood", "pickup_h3")


def job_scope(spark: SparkSession, sf: str, today) -> DataFrame:
    """Clean rows and features of a run over one month."""
    base = _ran(spark, sf, today)
    scoped = f"{base}/scope-{uuid.uuid4().hex}"
    year, month = SCOPE
    jobs.clean(spark, f"{base}/landed", f"{scoped}/clean", year, month)
    jobs.featurize(spark, f"{base}/clean", f"{scoped}/features", year, month)
    clean = spark.read.parquet(f"{scoped}/clean").select(F.lit("clean").alias("step"), "trip_id", "year", "month")
    features = spark.read.parquet(f"{scoped}/features")
    return clean.unionByName(features.select(F.lit("features").alias("step"), "trip_id", F.col("p_year").alias("year"), F.col("p_month").alias("month")))


def job_failures(spark: SparkSession, sf: str, today) -> DataFrame:
    """Log of a second landing of two months, one of which cannot be read any more, and the rows held of each.

    The month that fails is logged with its error and keeps the rows of the first landing.
    """
    base = _ran(spark, sf, today)
    root = f"{base}/failures-{uuid.uuid4().hex}"
    feed, (year, month) = read_landed(spark, f"{base}/feed"), SCOPE
    jobs.land(feed, root, today, years=[year], months=[month - 1, month])
    start = F.col("trip_start_timestamp").try_cast("timestamp_ntz")
    bad = (F.year(start) == year) & (F.month(start) == month)
    broken = feed.withColumn("fare", F.when(bad, F.raise_error(F.lit("unreadable fare"))).otherwise(F.col("fare")).cast("string"))
    log = jobs.land(broken, root, today, years=[year], months=[month - 1, month], skip_existing=False).log
    held = spark.read.parquet(root).groupBy("year", "month").agg(F.count(F.lit(1)).alias("held"))
    status = F.regexp_replace("status", "^error: .*", "error").alias("status")
    timed = F.col("elapsed_seconds").isNotNull().alias("timed")
    return settle(log.join(held, ["year", "month"]).select("year", "month", "records", status, timed, "held"))


def job_graph_tables(spark: SparkSession, sf: str, today) -> DataFrame:
    """What the graph job wrote and the load read back, without loading trips: (item, key, value).

    Edges and strengths come from the loaded tables, the hourly list from the JSON
    report; ``labelled`` counts the cells with a community, ``trips`` the trips that
    the load without trips has added.
    """
    base = _ran(spark, sf, today)
    folder = f"{base}/graph-{uuid.uuid4().hex}"
    jobs.analyse_graph(spark.read.parquet(f"{base}/features"), folder, generated_at="2025-11-15T00:00:00")
    tables.create_tables(spark)
    before = spark.table(tables.TRIPS_TABLE).count()
    jobs.load(spark, f"{base}/features", folder, skip_trips=True)
    spark.catalog.refreshTable(tables.TRIPS_TABLE)
    added = spark.table(tables.TRIPS_TABLE).agg((F.count(F.lit(1)) - before).alias("value"))
    hourly = tables.read_json_list(spark, f"{folder}/temporal_analysis", "hourly_flow", "hour: int, trips: bigint")
    parts = [
        spark.table("edge_list").select(F.lit("edge").alias("item"), F.concat_ws(">", "pickup_h3", "dropoff_h3").alias("key"), F.col("weight").alias("value")),
        spark.table("node_metrics").select(F.lit("flow").alias("item"), F.col("h3_cell").alias("key"), F.col("total_flow").alias("value")),
        spark.table("communities").where("community IS NOT NULL").agg(F.count_distinct("h3_cell").alias("value")).select(F.lit("labelled").alias("item"), F.lit("").alias("key"), "value"),
        hourly.select(F.lit("hour").alias("item"), F.col("hour").cast("string").alias("key"), F.col("trips").alias("value")),
        added.select(F.lit("trips").alias("item"), F.lit("").alias("key"), "value"),
    ]
    found = parts[0].withColumn("value", F.col("value").cast("bigint"))
    for part in parts[1:]:
        found = found.unionByName(part.withColumn("value", F.col("value").cast("bigint")))
    # Later loads replace the tables, so the rows are written.
    return settle(found)


_LOSS = "original bigint, kept bigint, removed bigint, pct_removed double"
JOB_QUERIES = (job_landed, job_log, job_loss, job_clean, job_report, job_features, job_loaded, job_scope, job_failures, job_graph_tables)
