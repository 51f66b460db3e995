import json

import pytest
from pyspark.sql import functions as F

from checks.compare import difference, open_tables
from checks.sql_oracles import oracles
from urbanweave.operators import display, flow, hexes
from urbanweave.plans.catalogue import QUERIES

SMALL = "/root/testdata/sf0.001"
# These iterate over many rounds; test_graph.py checks the operators behind them on small graphs.
SLOW = {
    "pagerank", "betweenness", "betweenness_inverse", "node_metrics", "graph_summary", "communities",
    "top_hexagons", "top_hexagons_betweenness", "hexagon_metrics", "hexagon_detail", "community_stats", "map_styles",
    "pagerank_board", "community_board",
}


@pytest.fixture(scope="module")
def tables():
    return open_tables(SMALL)


@pytest.mark.parametrize("name", sorted(oracles().keys() - SLOW))
def test_query_equals_its_statement(spark, tables, name):
    assert difference(QUERIES[name](spark, SMALL), tables, oracles()[name]) is None


def test_every_statement_has_a_query():
    assert oracles().keys() <= QUERIES.keys()


TRIPS = """trip_start_timestamp timestamp_ntz, neighborhood string, pickup_h3 string, hour int, day_of_week int,
    is_weekend int, is_rush_hour int, season string, total_amount double, trip_miles double, trip_seconds double,
    speed_mph double, tip_percentage double"""


@pytest.fixture(scope="module")
def trips(spark):
    rows = [
        (None, "Loop", "c1", 8, 0, 0, 1, "Winter", 10.0, 1.0, 600.0, 6.0, 10.0),
        (None, "Loop", "c1", 8, 5, 1, 1, "Winter", 20.0, 2.0, 600.0, 12.0, None),
        (None, "Uptown", "c1", 9, 6, 1, 1, "Summer", 31.0, None, None, None, None),
        (None, "Uptown", "c1", None, None, 0, 0, "Unknown", None, None, None, None, None),
        (None, None, "c1", 3, 2, 0, 0, "Fall", 7.0, 1.0, 60.0, 60.0, 0.0),
        (None, None, "c2", 3, 2, 0, 0, "Fall", 0.0, 1.0, 60.0, 60.0, 0.0),
        (None, "Austin", None, 3, 2, 0, 0, "Fall", 5.0, 1.0, 60.0, 60.0, 0.0),
    ]
    return spark.createDataFrame(rows, TRIPS)


def test_mode_ties_go_to_the_first_name(trips):
    found = {r.pickup_h3: r for r in hexes.usual_neighborhood(trips, ["avg_ticket"]).collect()}
    assert found["c1"].neighborhood == "Loop" and found["c1"].total_trips == 5 and found["c1"].avg_ticket == 17.0
    assert found["c2"].neighborhood is None


def test_flow_keeps_null_keys_but_the_report_drops_them(trips):
    assert [tuple(r) for r in flow.hourly_flow(trips).collect()] == [(3, 3), (8, 2), (9, 1), (None, 1)]
    keys = {r.key for r in flow.temporal_breakdowns(trips).where("breakdown = 'hourly_flow'").collect()}
    assert keys == {"3", "8", "9"}


def test_empty_filters_do_not_filter(trips):
    assert flow.hourly_flow(trips, neighborhood="", season=None).count() == 4
    assert [tuple(r) for r in flow.hourly_flow(trips, "Loop", "Winter").collect()] == [(8, 2)]
    assert flow.weekly_flow(trips, neighborhood="Nowhere").collect() == []


def test_neighborhood_detail(trips):
    row = flow.neighborhood_detail(trips, "Uptown").first()
    assert row.general.total_trips == 2 and row.general.avg_ticket == 31.0 and row.general.weekend_trips == 1
    assert [tuple(e) for e in row.hourly] == [(9, 1), (None, 1)]
    assert [tuple(e) for e in row.weekly] == [(6, 1), (None, 1)]
    assert flow.neighborhood_detail(trips, "Nowhere").collect() == []
    assert flow.neighborhood_general(trips, "Nowhere").collect() == []


def test_summary_of_nothing(trips):
    row = flow.summary(trips.limit(0)).first()
    assert (row.total_trips, row.total_neighborhoods, row.avg_ticket) == (0, 0, None)


def test_priciest_ignores_zero_totals(trips):
    found = [(r.neighborhood, r.avg_ticket) for r in flow.priciest_neighborhoods(trips, 2).collect()]
    assert found == [("Uptown", 31.0), ("Loop", 15.0)]


METRICS = """h3_cell string, in_strength double, out_strength double, total_flow double, pagerank double,
    betweenness double, betweenness_norm double, rank int"""


@pytest.fixture(scope="module")
def metrics(spark):
    return spark.createDataFrame([("c1", 1.0, 9.0, 10.0, 0.3, 2.0, 1.0, 1), ("c3", 4.0, 1.0, 5.0, 0.7, 0.0, 0.0, 2)], METRICS)


@pytest.fixture(scope="module")
def communities(spark):
    return spark.createDataFrame([("c1", 0, 1)], "h3_cell string, community int, community_size int")


def test_top_hexagons(metrics, communities, trips):
    first, second = hexes.top_hexagons(metrics, communities, trips, metric="pagerank").collect()
    assert (first.h3_cell, first.community, first.neighborhood, first.avg_ticket) == ("c3", None, None, None)
    assert (second.h3_cell, second.community, second.neighborhood, second.avg_ticket) == ("c1", 0, "Loop", 17.0)
    assert hexes.top_hexagons(metrics, communities, trips, limit=1).first().h3_cell == "c1"


@pytest.mark.parametrize("wrong", [{"metric": "rank; drop"}, {"limit": 0}, {"limit": 101}])
def test_top_hexagons_checks_its_arguments(metrics, communities, trips, wrong):
    with pytest.raises(ValueError):
        hexes.top_hexagons(metrics, communities, trips, **wrong)


def test_hexagon_detail(metrics, communities, trips):
    row = hexes.hexagon_detail(metrics, communities, trips, "c1").first()
    assert row.metrics.community_size == 1 and row.trips.total_trips == 5 and row.trips.neighborhood == "Loop"
    assert hexes.hexagon_detail(metrics, communities, trips, "none").collect() == []
    unknown = hexes.hexagon_trips(trips, "none").first()
    assert (unknown.total_trips, unknown.avg_ticket, unknown.neighborhood) == (0, None, None)


def test_heavy_edges(spark):
    edges = spark.createDataFrame([("a", "b", 100), ("b", "a", 99), ("b", "c", 300)], "pickup_h3 string, dropoff_h3 string, weight bigint")
    assert [r.weight for r in hexes.heavy_edges(edges).collect()] == [300, 100]
    with pytest.raises(ValueError):
        hexes.heavy_edges(edges, limit=5001)


def test_scaling_of_equal_values_and_missing_flow(spark, metrics, communities):
    same = metrics.withColumn("total_flow", F.lit(3.0))
    assert {r.flow_norm for r in display.map_styles(same, communities).collect()} == {None}
    flows = spark.createDataFrame([("a", 0.0), ("b", None)], "h3_cell string, total_flow double")
    assert {r.flow_share for r in display.flow_share(flows).collect()} == {0.0}


def test_boards(metrics, communities, trips):
    leaders = hexes.top_hexagons(metrics, communities, trips, metric="pagerank")
    assert [tuple(r) for r in display.pagerank_board(leaders).collect()] == [(1, "c3...", "0.7000", None), (2, "Loop", "0.3000", 0)]
    stats = hexes.community_stats(metrics, communities)
    assert [tuple(r) for r in display.community_board(stats).collect()] == [(0, 1, "0.0M", "0.3000")]


def test_report_as_json(trips):
    row = flow.temporal_report(trips, top_n=1).select(F.to_json(F.struct("*")).alias("j")).first()
    report = json.loads(row.j)
    assert report["top_h3_cells"] == ["c1"] and report["weekend_flow"] == [{"is_weekend": 0, "trips": 5}, {"is_weekend": 1, "trips": 2}]


def test_bound_parameters_are_not_spliced(spark, trips):
    trips.createOrReplaceTempView("bound_trips")
    statement = "SELECT count(*) AS n FROM bound_trips WHERE neighborhood = :name"
    assert flow.run_sql(spark, statement, name="x' OR 'a' = 'a").first().n == 0


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SLOW))
def test_plan_has_no_pairwise_join(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["od_edges", "top_origins", "summary", "feature_table"])
def test_cells_are_computed_once_per_row(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_scans_read_only_what_a_query_needs(spark):
    plan = QUERIES["data_range"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan
