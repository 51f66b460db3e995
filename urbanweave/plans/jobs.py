"""The batch jobs: land, clean, add features, analyse the graph, load."""

from __future__ import annotations

import logging
import time
from datetime import date, datetime
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanweave.functions.areas import add_neighborhood
from urbanweave.functions.calendar import add_calendar_features
from urbanweave.functions.casting import as_columns, lenient_doubles
from urbanweave.functions.fares import add_fare_features
from urbanweave.functions.hexgrid import add_cells
from urbanweave.operators.centrality import node_metrics
from urbanweave.operators.cleaning import keep_valid, month_file, quality_report
from urbanweave.operators.community import detect_communities
from urbanweave.operators.flow import temporal_report
from urbanweave.operators.graph import graph_summary, od_edges
from urbanweave.operators.hexes import hexagon_export
from urbanweave.operators.ingest import (
    cast_times,
    dedup_first,
    drop_missing_geo,
    ingest_loss,
    merge_log,
    month_calendar,
    month_counts,
    pending_months,
    run_log,
    run_totals,
)
from urbanweave.runtime import settle, small_tasks
from urbanweave.schemas import AMOUNT_COLUMNS, AREA_COLUMNS, DOWNLOAD_LOG, TRIP
from urbanweave.sources import tables
from urbanweave.sources.months import exists, in_scope, present_months, write_months

log = logging.getLogger(__name__)

# The feature ``month`` would collide with a partition of that name.
FEATURE_PARTITIONS = ("p_year", "p_month")

# What the breakdowns and the edges read.
GRAPH_COLUMNS = ["pickup_h3", "dropoff_h3", "hour", "is_weekend", "is_rush_hour", "season"]


def add_all_features(trips: DataFrame) -> DataFrame:
    """Calendar, fare and cell features and the neighbourhood of cleaned trips."""
    return add_cells(add_neighborhood(add_fare_features(add_calendar_features(trips))))


def _in_months(months: DataFrame, year: Column, month: Column) -> Column:
    """Whether a row lies in one of ``months``.

    The months come from a calendar, so they are few; as literals they prune
    partitions when the query is planned.
    """
    wanted = [row.year * 100 + row.month for row in months.select("year", "month").collect()]
    by_year: dict[int, list[int]] = {}
    for number in wanted:
        by_year.setdefault(number // 100, []).append(number % 100)
    inside = F.lit(False)
    for one_year, its_months in by_year.items():
        inside = inside | ((year == one_year) & month.isin(its_months))
    return inside


class Landing(NamedTuple):
    """Merged run log, rows lost by the clean-up, and totals of the wanted months."""

    log: DataFrame
    loss: DataFrame
    totals: DataFrame


def typed_trips(landed: DataFrame) -> DataFrame:
    """Landed rows with a position, typed; what is no time or no number becomes NULL."""
    placed = cast_times(drop_missing_geo(landed))
    return placed.withColumns(as_columns(lenient_doubles(placed, AMOUNT_COLUMNS + AREA_COLUMNS)))


def first_copies(typed: DataFrame) -> DataFrame:
    """The first copy of each trip within its month; rows without start time count as one month."""
    ts = F.col("trip_start_timestamp")
    monthly = typed.withColumns({"_year": F.year(ts), "_month": F.month(ts)})
    return dedup_first(monthly, within=("_year", "_month")).drop("_year", "_month")


def _write_each(spark: SparkSession, typed: DataFrame, todo: DataFrame, root: str) -> DataFrame:
    """Write the months of ``todo`` one by one; returns (year, month, message, seconds), the message being null where all went well."""
    ts, written = F.col("trip_start_timestamp"), []
    for row in todo.orderBy("year", "month").collect():  # calendar months, so few
        started, message = time.monotonic(), None
        try:
            # Only rows of the month are read, so a bad one does not fail the others.
            write_months(first_copies(typed.where((F.year(ts) == row.year) & (F.month(ts) == row.month))), root)
        except PySparkException as error:
            _raise_unless_of_rows(error)
            log.warning("month %d-%02d failed: %s", row.year, row.month, error)
            message = str(error).splitlines()[0][:200]
        written.append((row.year, row.month, message, time.monotonic() - started))
    return spark.createDataFrame(written, "year int, month int, message string, seconds double")


def _raise_unless_of_rows(error: PySparkException) -> None:
    """Raise what no month can cause: lost executors, memory, and jobs that someone has cancelled."""
    if any(sign in str(error) for sign in ("OutOfMemoryError", "ExecutorLostFailure", "cancelled", "canceled")):
        raise error


def land(
    landed: DataFrame,
    root: str,
    today: date,
    years: list[int] | None = None,
    months: list[int] | None = None,
    skip_existing: bool = True,
) -> Landing:
    """Clean up and write the wanted months that are missing; returns log, loss and totals.

    Copies of a trip are dropped inside each month; the load drops those across
    months. Rows without a readable start time are kept, in a partition of their
    own. All months are written in one job; if that fails they are written one by
    one, and those that fail again are logged as errors and do not end the run.
    The log and the loss are also written as CSV.
    """
    spark = landed.sparkSession
    started = time.monotonic()
    wanted = settle(month_calendar(spark, today, years, months))
    todo = settle(pending_months(wanted, present_months(spark, root), skip_existing))
    typed = typed_trips(landed)
    ts = F.col("trip_start_timestamp")
    monthly = first_copies(typed.where(_in_months(todo, F.year(ts), F.month(ts))))
    undated = typed.where(ts.isNull())
    if exists(spark, root):
        held = spark.read.parquet(root).where("year IS NULL").drop("year", "month")
        undated = undated.unionByName(held, allowMissingColumns=True)
    with small_tasks(spark):
        undated = settle(first_copies(undated))
    failures = None
    try:
        write_months(monthly, root)
    except PySparkException as error:
        _raise_unless_of_rows(error)
        log.warning("landing all months at once failed, taking them one by one: %s", error)
        failures = _write_each(spark, typed, todo, root)
    if undated.limit(1).count():
        write_months(undated, root)

    log_path = f"{root}_log"
    counts = month_counts(spark.createDataFrame([], TRIP))
    if exists(spark, root):
        written = spark.read.parquet(root)
        counts = month_counts(written.where(_in_months(todo, F.col("year"), F.col("month"))))
    entries = run_log(todo, counts, datetime.now().isoformat(), time.monotonic() - started, failures)
    totals = settle(run_totals(wanted, entries))
    if exists(spark, log_path):
        entries = merge_log(spark.read.schema(DOWNLOAD_LOG).parquet(log_path), entries)
    merged = settle(entries)
    merged.write.mode("overwrite").parquet(log_path)
    loss = settle(ingest_loss(landed))
    tables.write_csv(merged, f"{log_path}_csv")
    tables.write_csv(loss, f"{root}_loss_csv")
    return Landing(merged, loss, totals)


def _pending_rows(spark: SparkSession, source: str, target: str, target_names, year, month, skip_existing) -> DataFrame:
    rows = in_scope(spark.read.parquet(source), year, month)
    todo = pending_months(present_months(spark, source), present_months(spark, target, target_names), skip_existing)
    # Rows without a start time have no month; they go along each time and replace themselves.
    return rows.where(_in_months(todo, F.col("year"), F.col("month")) | F.col("year").isNull())


def clean(
    spark: SparkSession,
    landed_root: str,
    clean_root: str,
    year: int | None = None,
    month: int | None = None,
    skip_existing: bool = True,
) -> DataFrame:
    """Apply the rules to missing months and write them; returns the quality report of those months, also written as CSV."""
    rows = _pending_rows(spark, landed_root, clean_root, ("year", "month"), year, month, skip_existing)
    report = settle(quality_report(rows, month_file(F.col("trip_start_timestamp"))))
    write_months(keep_valid(rows).drop("year", "month"), clean_root)
    tables.write_csv(report, f"{clean_root}_report_csv")
    return report


def featurize(
    spark: SparkSession,
    clean_root: str,
    feature_root: str,
    year: int | None = None,
    month: int | None = None,
    skip_existing: bool = True,
) -> None:
    """Add the features to missing months and write them."""
    rows = _pending_rows(spark, clean_root, feature_root, FEATURE_PARTITIONS, year, month, skip_existing)
    write_months(add_all_features(rows.drop("year", "month")), feature_root, FEATURE_PARTITIONS)


def analyse_graph(features: DataFrame, out: str, generated_at: str, length: str = "weight", batches: int | None = None) -> None:
    """Write edge list, node metrics, communities, temporal report, summary and hexagon export."""
    spark = features.sparkSession
    trips = features.select(*GRAPH_COLUMNS)
    tables.write_json(temporal_report(trips), f"{out}/temporal_analysis")
    edges = settle(od_edges(trips))
    metrics = settle(node_metrics(edges, length, batches))
    tables.write_csv(edges, f"{out}/edge_list")
    tables.write_csv(metrics, f"{out}/node_metrics")
    tables.write_csv(detect_communities(edges), f"{out}/communities")
    tables.write_json(graph_summary(edges, metrics, generated_at), f"{out}/graph_summary")
    tables.write_json(hexagon_export(metrics), f"{out}/hexagons")


def load(spark: SparkSession, feature_root: str, graph_folder: str, skip_trips: bool = False) -> None:
    """Create the serving tables, append the trips unless skipped, and replace the graph tables."""
    tables.create_tables(spark)
    if not skip_trips:
        tables.append_trips(spark.read.parquet(feature_root))
    tables.load_graph_tables(spark, graph_folder)
