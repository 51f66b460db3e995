"""Serving tables and report files."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanweave.operators.ingest import dedup_for_load
from urbanweave.runtime import settle, settle_counted
from urbanweave.schemas import FEATURE_TRIP, GRAPH_TABLES, conform

log = logging.getLogger(__name__)

TRIPS_TABLE = "taxi_trips"
ID_BUCKETS = 64


def create_table(spark: SparkSession, name: str, schema: T.StructType, location: str | None = None) -> None:
    """Create a table if it does not exist, at ``location`` if one is given."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{place}")


def create_tables(spark: SparkSession) -> None:
    """Create the trip and graph tables if they do not exist."""
    for name, schema in {TRIPS_TABLE: FEATURE_TRIP, **GRAPH_TABLES}.items():
        create_table(spark, name, schema)


def new_trips(trips: DataFrame, loaded_ids: DataFrame) -> DataFrame:
    """Trips fit for the table whose id is not loaded yet, one row per id."""
    fit = dedup_for_load(conform(trips, FEATURE_TRIP))
    return fit.join(loaded_ids.select("trip_id"), "trip_id", "left_anti").select(*FEATURE_TRIP.names)


def ids_table(table: str) -> str:
    """Name of the table that holds the trip ids of ``table``."""
    return f"{table}_ids"


def id_buckets(spark: SparkSession, table: str) -> int:
    """Buckets of the id table, as it was created."""
    told = spark.sql(f"DESCRIBE TABLE EXTENDED {ids_table(table)}").where("col_name = 'Num Buckets'").first()
    return int(told.data_type)


def _insert_ids(ids: DataFrame, table: str) -> None:
    # Dealt as the buckets are, so that each gains one file.
    dealt = ids.select("trip_id").repartition(id_buckets(ids.sparkSession, table), "trip_id")
    dealt.write.mode("append").insertInto(ids_table(table))


def index_ids(spark: SparkSession, table: str, buckets: int = ID_BUCKETS) -> DataFrame:
    """The id table of ``table``, created and filled when missing, brought up to date when a run ended between both.

    It is bucketed by trip_id, so joining it moves only the other side, and its files
    carry Bloom filters, so a look-up of single ids opens few row groups. Trips are
    written before their ids; fewer ids than trips are those of a run that was ended
    and are added, more are those of a table that was replaced, and the index is made
    anew. ``buckets`` counts when the index is created.
    """
    name = ids_table(table)
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"CREATE TABLE {name} (trip_id STRING) USING parquet "
            "OPTIONS ('parquet.bloom.filter.enabled#trip_id' 'true', 'parquet.bloom.filter.adaptive.enabled' 'true') "
            f"CLUSTERED BY (trip_id) INTO {buckets} BUCKETS"
        )
    spark.catalog.refreshTable(name)
    trips, ids = spark.table(table), spark.table(name)
    held, known = trips.count(), ids.count()
    if known > held:
        log.warning("%s has more ids than %s has trips, making it anew", name, table)
        spark.sql(f"TRUNCATE TABLE {name}")
    if known != held:
        dealt = trips.select("trip_id").repartition(id_buckets(spark, table), "trip_id")
        _insert_ids(settle(dealt.join(spark.table(name), "trip_id", "left_anti")), table)
        spark.catalog.refreshTable(name)
    return spark.table(name)


def unloaded_trips(trips: DataFrame, table: str = TRIPS_TABLE) -> DataFrame:
    """Trips fit for ``table`` whose id is not loaded yet, one row per id.

    They are dealt once, as the id table is, for the choice of a copy and for the
    join, so the id table is read bucket by bucket and never moved.
    """
    ids = index_ids(trips.sparkSession, table)
    return new_trips(conform(trips, FEATURE_TRIP).repartition(id_buckets(trips.sparkSession, table), "trip_id"), ids)


def append_trips(trips: DataFrame, table: str = TRIPS_TABLE) -> None:
    """Append the trips that are not in the table; running it again adds nothing.

    Rows are written in ranges of neighbourhood and pickup cell, so the minima and
    maxima of files and row groups let filtered queries skip most of the table. Their
    ids go to the id table afterwards.
    """
    spark = trips.sparkSession
    # Another session, such as that of a stream, may have added files since.
    spark.catalog.refreshTable(table)
    keys = ["neighborhood", "pickup_h3"]
    fresh, rows = settle_counted(unloaded_trips(trips, table))
    if rows:
        fresh.repartitionByRange(*keys, "trip_id").sortWithinPartitions(*keys).write.mode("append").insertInto(table)
        _insert_ids(fresh, table)


def replace_table(rows: DataFrame, table: str) -> None:
    rows.write.mode("overwrite").format("parquet").saveAsTable(table)


def load_graph_tables(spark: SparkSession, folder: str) -> list[str]:
    """Replace each graph table from its CSV file; a missing file is only reported."""
    loaded = []
    for name, schema in GRAPH_TABLES.items():
        try:
            rows = read_csv(spark, f"{folder}/{name}", schema)
        except AnalysisException:
            log.warning("%s/%s not found, table %s left as it is", folder, name, name)
            continue
        replace_table(rows, name)
        loaded.append(name)
    return loaded


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(nested: DataFrame, path: str) -> None:
    nested.write.mode("overwrite").json(path)


def read_json_list(spark: SparkSession, path: str, name: str, entry_schema: str) -> DataFrame:
    """Rows of one list inside a written report."""
    report = spark.read.schema(f"{name} array<struct<{entry_schema}>>").json(path)
    return report.select(F.inline(name))
