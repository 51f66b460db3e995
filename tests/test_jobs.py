from datetime import date

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from urbanweave.operators.flow import hourly_flow
from urbanweave.plans import job_queries, jobs, sample_trips
from urbanweave.schemas import COMMUNITIES, EDGE_LIST, FEATURE_TRIP, GRAPH_TABLES, RAW_TRIP
from urbanweave.sources import tables
from urbanweave.sources.months import present_months, read_landed, read_months
from urbanweave.streaming.incremental import load_arrivals

SMALL = "/root/testdata/sf0.001"
TODAY = date(2024, 6, 30)


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    base = tmp_path_factory.mktemp("jobs")
    return {name: str(base / name) for name in ("feed", "landed", "clean", "features", "graph", "arrivals", "progress")}


def test_jobs_end_to_end(spark, roots):
    feed = sample_trips.landed(spark, SMALL)
    feed.write.json(roots["feed"])
    landed = read_landed(spark, roots["feed"])
    assert landed.schema.names == RAW_TRIP.names and landed.count() == feed.count()

    log, loss, totals = jobs.land(landed, roots["landed"], TODAY, years=[2024], months=[1, 2])
    assert loss.first().original == feed.count() and totals.first().errors == 0
    assert {(r.month, r.status) for r in log.collect()} == {(1, "ok"), (2, "ok")}
    again = jobs.land(landed, roots["landed"], TODAY, years=[2024]).log
    assert len(again.collect()) == 6
    assert {tuple(r) for r in present_months(spark, roots["landed"]).collect()} == {(2024, m) for m in range(1, 7)}
    before = read_months(spark, roots["landed"], 2024, 1).count()
    jobs.land(landed, roots["landed"], TODAY, years=[2024], months=[1], skip_existing=False)
    assert read_months(spark, roots["landed"], 2024, 1).count() == before
    undated = jobs.first_copies(jobs.typed_trips(landed).where("trip_start_timestamp IS NULL")).count()
    assert spark.read.parquet(roots["landed"]).where("year IS NULL").count() == undated > 0

    first = jobs.clean(spark, roots["landed"], roots["clean"], year=2024, month=1)
    assert {r.file for r in first.collect()} == {"year=2024/month=01/data.parquet", "TOTAL"}
    rest = jobs.clean(spark, roots["landed"], roots["clean"])
    assert len(rest.collect()) == 7  # five more months, the rows without a month, and the total

    jobs.featurize(spark, roots["clean"], roots["features"])
    features = spark.read.parquet(roots["features"])
    assert set(FEATURE_TRIP.names) | {"p_year", "p_month"} == set(features.columns)
    assert features.count() == spark.read.parquet(roots["clean"]).count()
    jobs.featurize(spark, roots["clean"], roots["features"])
    assert spark.read.parquet(roots["features"]).count() == spark.read.parquet(roots["clean"]).count()


def test_pruned_scan(spark, roots):
    plan = read_months(spark, roots["landed"], 2024, 2).select("trip_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "ReadSchema: struct<trip_id:string>" in plan


def test_graph_reports_and_load(spark, roots):
    lively = jobs.add_all_features(sample_trips.clean_trips(spark, SMALL)).withColumnRenamed("dropoff_h3", "d")
    lively = lively.selectExpr("*", "if(hash(trip_id) % 2 = 0, '892664c1ecfffff', '892664c1a8bffff') AS dropoff_h3")
    jobs.analyse_graph(lively, roots["graph"], "2024-06-30")
    edges = tables.read_csv(spark, f"{roots['graph']}/edge_list", EDGE_LIST)
    assert edges.count() > 0 and tables.read_csv(spark, f"{roots['graph']}/communities", COMMUNITIES).count() > 0
    hours = tables.read_json_list(spark, f"{roots['graph']}/temporal_analysis", "hourly_flow", "hour int, trips bigint")
    assert hours.count() == hourly_flow(lively).count()
    boundary = spark.read.json(f"{roots['graph']}/hexagons").first()
    assert len(boundary.boundary) == 6 and boundary.flow > 0

    jobs.load(spark, roots["features"], roots["graph"])
    loaded = spark.table("taxi_trips").count()
    jobs.load(spark, roots["features"], roots["graph"])
    assert spark.table("taxi_trips").count() == loaded > 0
    assert spark.table("taxi_trips").select("trip_id").distinct().count() == loaded
    assert spark.table("edge_list").count() == edges.count()
    assert tables.load_graph_tables(spark, roots["graph"] + "_missing") == []
    assert all(spark.catalog.tableExists(name) for name in GRAPH_TABLES)


def test_one_bad_month_does_not_end_the_run(spark, roots, monkeypatch):
    whole = jobs.write_months

    def broken(trips, root, *more):
        if {r.m for r in trips.selectExpr("month(trip_start_timestamp) AS m").distinct().collect()} & {2}:
            raise AnalysisException("disk full")
        whole(trips, root, *more)

    monkeypatch.setattr(jobs, "write_months", broken)
    log, _, totals = jobs.land(read_landed(spark, roots["feed"]), roots["landed"] + "_broken", TODAY, years=[2024], months=[1, 2, 3])
    assert {r.month: r.status for r in log.collect()} == {1: "ok", 2: "error: disk full", 3: "ok"}
    assert totals.first().errors == 1


def test_bad_values_become_null_in_the_load(spark, roots):
    features = spark.read.parquet(roots["features"])
    assert dict(features.dtypes)["tolls"] == "double"
    odd = features.limit(3).withColumn("tolls", F.lit("n/a")).withColumn("fare", F.lit("4.5"))
    fit = tables.new_trips(odd, spark.createDataFrame([], "trip_id string"))
    assert all(r.tolls is None and r.fare == 4.5 for r in fit.collect())


def test_stream_and_batch_load_the_same(spark, roots, tmp_path):
    feed = sample_trips.landed(spark, SMALL)
    feed.write.json(str(tmp_path / "in"))
    tables.create_table(spark, "streamed", FEATURE_TRIP)
    load_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "progress"), "streamed").awaitTermination()
    spark.catalog.refreshTable("streamed")
    base = str(tmp_path / "batch")
    jobs.land(read_landed(spark, str(tmp_path / "in")), f"{base}/landed", date(2027, 1, 1))
    jobs.clean(spark, f"{base}/landed", f"{base}/clean")
    jobs.featurize(spark, f"{base}/clean", f"{base}/features")
    batch = tables.new_trips(spark.read.parquet(f"{base}/features"), spark.createDataFrame([], "trip_id string"))
    assert {r.trip_id for r in spark.table("streamed").collect()} == {r.trip_id for r in batch.collect()} != set()


def test_filters_on_the_serving_table_reach_the_scan(spark, roots):
    plan = spark.table("taxi_trips").where("neighborhood = 'Loop'").select("trip_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(neighborhood,Loop)" in plan


def test_arrivals_are_loaded_once(spark, roots):
    spark.sql("CREATE TABLE arrived LIKE taxi_trips")
    feed = sample_trips.landed(spark, SMALL)
    feed.where("trip_id < 't5'").write.mode("append").json(roots["arrivals"])
    load_arrivals(spark, roots["arrivals"], roots["progress"], "arrived").awaitTermination()
    part = spark.table("arrived").count()
    feed.write.mode("append").json(roots["arrivals"])
    load_arrivals(spark, roots["arrivals"], roots["progress"], "arrived").awaitTermination()
    spark.catalog.refreshTable("arrived")
    whole = spark.table("arrived")
    assert 0 < part < whole.count() == whole.select("trip_id").distinct().count()


def test_feed_is_packed_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(job_queries, "FEED_ROWS", 300)
    feed = sample_trips.landed(spark, SMALL)
    job_queries.write_feed(feed, str(tmp_path / "feed"))
    files = list((tmp_path / "feed").glob("part-*"))
    assert all(f.name.endswith(".json.gz") for f in files) and len(files) >= feed.count() / 300 > 1
    read = read_landed(spark, str(tmp_path / "feed"))
    assert read.exceptAll(feed).isEmpty() and feed.exceptAll(read).isEmpty()
