"""The id table: appends move only what is new, and it mends itself."""

import uuid

import pytest
from pyspark.sql import functions as F

from urbanweave.schemas import FEATURE_TRIP
from urbanweave.sources import tables


@pytest.fixture
def table(spark):
    name = f"trips_{uuid.uuid4().hex}"
    tables.create_table(spark, name, FEATURE_TRIP)
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"DROP TABLE IF EXISTS {tables.ids_table(name)}")


def feed(spark, start, end):
    rows = spark.range(start, end).select(F.concat(F.lit("t"), "id").alias("trip_id"), F.lit("Loop").alias("neighborhood"), F.lit("a").alias("pickup_h3"))
    return rows.unionByName(rows.limit(3)).unionByName(rows.limit(1).withColumn("trip_id", F.lit(None).cast("string")))


def ids(spark, name):
    spark.catalog.refreshTable(name)
    return sorted(r.trip_id for r in spark.table(name).select("trip_id").collect())


def named(start, end):
    return sorted(f"t{i}" for i in range(start, end))


def test_appends_add_what_is_new(spark, table):
    for start, end in ((0, 40), (20, 60), (20, 60), (0, 5)):
        tables.append_trips(feed(spark, start, end), table)
    assert ids(spark, table) == ids(spark, tables.ids_table(table)) == named(0, 60)


def test_the_table_side_is_not_moved(spark, table):
    tables.append_trips(feed(spark, 0, 50), table)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = tables.unloaded_trips(feed(spark, 40, 60), table)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = plan[plan.index("SortMergeJoin") :]
    table_side = side[side.rindex("FileScan parquet") - 400 :]
    assert f"Bucketed: true" in side and "SelectedBucketsCount: 64 out of 64" in side
    # One exchange: that of the incoming trips.
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning" not in table_side


def test_a_run_ended_before_its_ids_is_mended(spark, table):
    tables.append_trips(feed(spark, 0, 20), table)
    late = tables.unloaded_trips(feed(spark, 20, 30), table)
    late.write.mode("append").insertInto(table)  # and no ids
    tables.append_trips(feed(spark, 10, 35), table)
    assert ids(spark, table) == ids(spark, tables.ids_table(table)) == named(0, 35)


def test_a_replaced_table_gets_a_new_index(spark, table):
    tables.append_trips(feed(spark, 0, 20), table)
    spark.sql(f"TRUNCATE TABLE {table}")
    tables.append_trips(feed(spark, 5, 15), table)
    assert ids(spark, table) == ids(spark, tables.ids_table(table)) == named(5, 15)


def test_a_table_filled_before_it_had_an_index(spark, table):
    tables.new_trips(feed(spark, 0, 10), spark.createDataFrame([], "trip_id string")).write.mode("append").insertInto(table)
    tables.append_trips(feed(spark, 0, 12), table)
    assert ids(spark, table) == named(0, 12)
