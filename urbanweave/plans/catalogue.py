"""Named queries over the trip-shaped views; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanweave.functions import display as show
from urbanweave.functions.areas import add_neighborhood
from urbanweave.functions.calendar import add_calendar_features
from urbanweave.functions.casting import rounded
from urbanweave.functions.fares import add_fare_features
from urbanweave.functions.hexgrid import add_cells, cell_boundary, cell_centre, cell_distance, point_cell
from urbanweave.operators import centrality, cleaning, community, display, flow, graph, hexes, ingest, profile
from urbanweave.plans import sample_trips as sample
from urbanweave.plans.cube_queries import CUBE_QUERIES
from urbanweave.plans.job_queries import JOB_QUERIES
from urbanweave.runtime import settle
from urbanweave.schemas import FEATURE_TRIP, TRIP, conform, keep_listed
from urbanweave.sources.tables import new_trips

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the queries that need some.
MONTH = (2024, 12)
NEIGHBORHOOD = "Lincoln Park"
SEASON = "Winter"
TODAY = date(2025, 11, 15)
LOGGED_AT = "2025-11-15T00:00:00"
RELOGGED_AT = "2025-11-16T00:00:00"


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    """Clean trips with every feature that needs no cells."""
    trips = sample.clean_trips(spark, sf)
    return add_neighborhood(add_fare_features(add_calendar_features(trips)))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.od_edges(add_cells(sample.clean_trips(spark, sf)))


def _settled_edges(spark: SparkSession, sf: str) -> DataFrame:
    return settle(_edges(spark, sf))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct pickup cells of the clean trips."""
    cells = add_cells(sample.clean_trips(spark, sf)).select(F.col("pickup_h3").alias("h3_cell"))
    return cells.distinct()


def _districts(edges: DataFrame) -> DataFrame:
    """A partition of the cells that SQL can compute too: by the area their ids share."""
    nodes = graph.graph_nodes(edges)
    return community.number_communities(nodes.withColumn("community", F.substring("h3_cell", 1, 7)))


def _exact_metrics(edges: DataFrame) -> DataFrame:
    """Node metrics with the iterated scores rounded, so that they compare exactly."""
    metrics = centrality.node_metrics(edges)
    return metrics.withColumns(
        {
            "pagerank": F.round("pagerank", 7),
            "betweenness": F.round("betweenness", 6),
            "betweenness_norm": F.round("betweenness_norm", 7),
        }
    )


# --- landing -----------------------------------------------------------------


def month_scan(spark, sf):
    return ingest.month_scan(sample.landed(spark, sf), *MONTH).select("trip_id", "trip_start_timestamp", "fare")


def source_routing(spark, sf):
    """Both sources offer all years; each row must come from the one that serves its year."""
    feed = sample.landed(spark, sf)
    shifted = F.col("trip_start_timestamp").try_cast("timestamp_ntz") - F.expr("interval 1 year")
    older = feed.withColumn("trip_start_timestamp", shifted.cast("string"))
    routed = ingest.route_sources(
        older.withColumn("origin", F.lit("historical")), feed.withColumn("origin", F.lit("current"))
    )
    year = F.year(F.col("trip_start_timestamp").try_cast("timestamp_ntz"))
    return routed.groupBy("origin", year.alias("year")).agg(F.count(F.lit(1)).alias("trips"))


def latest_trips(spark, sf):
    return ingest.latest_trips(sample.trips(spark, sf), 100).select("trip_id", "trip_start_timestamp")


def trip_cast_clean(spark, sf):
    return keep_listed(ingest.clean_and_cast(sample.landed(spark, sf)), TRIP.names)


def dedup_first(spark, sf):
    deduped = ingest.dedup_first(ingest.cast_times(sample.landed(spark, sf)))
    return deduped.select("trip_id", "trip_start_timestamp")


def load_dedup(spark, sf):
    """What a table that already holds the January trips would gain from the feed."""
    feed = ingest.clean_and_cast(sample.landed(spark, sf))
    loaded = feed.where(F.month("trip_start_timestamp") == 1)
    return new_trips(feed, loaded).select("trip_id", "trip_start_timestamp", "tips")


def ingest_loss(spark, sf):
    return ingest.ingest_loss(sample.landed(spark, sf)).withColumn("pct_removed", rounded(F.col("pct_removed"), 6))


def _calendar(spark):
    return ingest.month_calendar(spark, TODAY)


def incremental_months(spark, sf):
    """Wanted months without trips in the clean table."""
    present = ingest.month_counts(sample.clean_trips(spark, sf))
    return ingest.pending_months(_calendar(spark), present)


def run_log(spark, sf):
    counts = ingest.month_counts(sample.clean_trips(spark, sf))
    return ingest.run_log(_calendar(spark), counts, LOGGED_AT)


def log_merge(spark, sf):
    """The log of all trips, then of the clean ones for the last year; the later entry wins."""
    first = ingest.run_log(_calendar(spark), ingest.month_counts(sample.trips(spark, sf)), LOGGED_AT)
    second = ingest.run_log(
        _calendar(spark).where("year = 2025"), ingest.month_counts(sample.clean_trips(spark, sf)), RELOGGED_AT
    )
    return ingest.merge_log(first, second)


def run_totals(spark, sf):
    counts = ingest.month_counts(sample.clean_trips(spark, sf))
    processed = _calendar(spark).where("year >= 2023")
    failures = processed.where("month = 7").withColumn("message", F.lit("timeout"))
    return ingest.run_totals(_calendar(spark), ingest.run_log(processed, counts, LOGGED_AT, failures=failures))


def data_range(spark, sf):
    return ingest.data_range(sample.trips(spark, sf))


def feature_table(spark, sf):
    return conform(sample.feature_trips(spark, sf), FEATURE_TRIP)


# --- cleaning and profile ----------------------------------------------------


def clean_rule_counts(spark, sf):
    return cleaning.rule_counts(sample.trips(spark, sf))


def clean_trips(spark, sf):
    return sample.clean_trips(spark, sf).select("trip_id", "trip_start_timestamp", "trip_miles", "trip_seconds", "fare")


def quality_report(spark, sf):
    return cleaning.quality_report(sample.trips(spark, sf), cleaning.month_file(F.col("trip_start_timestamp")))


def profile_shape(spark, sf):
    return profile.shape_by_year(sample.landed(spark, sf))


def profile_nulls(spark, sf):
    return profile.nulls_by_year(sample.landed(spark, sf))


def profile_issues(spark, sf):
    return profile.issues_by_year(sample.landed(spark, sf))


def profile_duplicates(spark, sf):
    return profile.duplicates_by_year(sample.landed(spark, sf))


DESCRIBED = [f.name for f in TRIP.fields if f.dataType == T.DoubleType()]


def describe_trips(spark, sf):
    """All numeric columns, per year of the start."""
    trips = sample.trips(spark, sf).withColumn("year", F.year("trip_start_timestamp"))
    found = profile.describe_columns(trips, DESCRIBED, by="year")
    return found.select("year", "column", "count", *[rounded(F.col(c), 6).alias(c) for c in found.columns[3:]])


# --- features ----------------------------------------------------------------


def calendar_features(spark, sf):
    return add_calendar_features(sample.trips(spark, sf)).select(
        "trip_id", "hour", "day_of_week", "month", "is_weekend", "is_rush_hour", "season", "is_holiday"
    )


def holiday_trips(spark, sf):
    """Trips per holiday date."""
    flagged = add_calendar_features(sample.trips(spark, sf)).where("is_holiday = 1")
    return flagged.groupBy(F.col("trip_start_timestamp").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("trips"))


def fare_features(spark, sf):
    return add_fare_features(sample.trips(spark, sf)).select(
        "trip_id", "speed_mph", "fare_per_mile", "tip_percentage", "total_amount"
    )


def neighborhood_lookup(spark, sf):
    return add_neighborhood(sample.trips(spark, sf)).select("trip_id", "pickup_community_area", "neighborhood")


def trip_cells(spark, sf):
    return add_cells(sample.clean_trips(spark, sf)).select("trip_id", "pickup_h3", "dropoff_h3", "h3_distance")


def point_cells(spark, sf):
    """Cells of all pickup points, also those outside the service box."""
    cell = point_cell(F.col("pickup_centroid_latitude"), F.col("pickup_centroid_longitude"))
    return sample.trips(spark, sf).select(cell.alias("h3_cell")).groupBy("h3_cell").agg(F.count(F.lit(1)).alias("trips"))


def pair_distances(spark, sf):
    """Grid distance of each connected cell pair, decoded from the cell ids."""
    distance = cell_distance(F.col("pickup_h3"), F.col("dropoff_h3"))
    return _edges(spark, sf).select("pickup_h3", "dropoff_h3", distance.alias("steps"))


def cell_centres(spark, sf):
    centre = _cells(spark, sf).withColumn("centre", cell_centre(F.col("h3_cell")))
    return centre.select("h3_cell", rounded(F.col("centre.lat"), 7).alias("lat"), rounded(F.col("centre.lon"), 7).alias("lon"))


def cell_boundaries(spark, sf):
    corners = _cells(spark, sf).select("h3_cell", F.posexplode(cell_boundary(F.col("h3_cell"))).alias("corner", "at"))
    return corners.select("h3_cell", "corner", rounded(F.col("at.lat"), 7).alias("lat"), rounded(F.col("at.lon"), 7).alias("lon"))


# --- aggregate queries -------------------------------------------------------


def table_counts(spark, sf):
    edges = _settled_edges(spark, sf)
    return flow.table_counts(
        {
            "taxi_trips": sample.clean_trips(spark, sf),
            "node_metrics": graph.graph_nodes(edges),
            "communities": _districts(edges),
            "edge_list": edges,
        }
    )


def summary(spark, sf):
    return flow.summary(add_cells(_wide(spark, sf)))


def neighborhoods(spark, sf):
    return flow.neighborhoods(_wide(spark, sf))


def neighborhood_general(spark, sf):
    return flow.neighborhood_general(_wide(spark, sf), NEIGHBORHOOD)


def neighborhood_detail(spark, sf):
    detail = flow.neighborhood_detail(_wide(spark, sf), NEIGHBORHOOD)
    return detail.select("general.*", F.to_json("hourly").alias("hourly"), F.to_json("weekly").alias("weekly"))


def flow_hourly(spark, sf):
    return flow.hourly_flow(_wide(spark, sf))


def flow_hourly_filtered(spark, sf):
    return flow.hourly_flow(_wide(spark, sf), neighborhood=NEIGHBORHOOD, season=SEASON)


def flow_weekly(spark, sf):
    return flow.weekly_flow(_wide(spark, sf))


def flow_weekly_filtered(spark, sf):
    return flow.weekly_flow(_wide(spark, sf), neighborhood=NEIGHBORHOOD)


def flow_seasonal(spark, sf):
    return flow.seasonal_flow(_wide(spark, sf))


def flow_rush(spark, sf):
    return flow.rush_flow(_wide(spark, sf))


def top5_trips(spark, sf):
    return flow.busiest_neighborhoods(_wide(spark, sf))


def top5_ticket(spark, sf):
    return flow.priciest_neighborhoods(_wide(spark, sf))


def temporal_breakdowns(spark, sf):
    return flow.temporal_breakdowns(_wide(spark, sf))


def temporal_report(spark, sf):
    report = flow.temporal_report(add_cells(_wide(spark, sf)))
    return report.select(*[F.to_json(c).alias(c) for c in report.columns])


def temporal_report_top(spark, sf):
    report = flow.temporal_report(add_cells(_wide(spark, sf)), top_n=5, top_only=True)
    return report.select(*[F.to_json(c).alias(c) for c in report.columns])


def top_origins(spark, sf):
    return flow.top_origins(add_cells(sample.clean_trips(spark, sf)))


def parametrised_sql(spark, sf):
    _wide(spark, sf).createOrReplaceTempView("wide_trips")
    statement = """
        SELECT season, is_weekend, count(*) AS trips
        FROM wide_trips
        WHERE neighborhood = :name AND trip_miles >= :miles
        GROUP BY season, is_weekend
    """
    return flow.run_sql(spark, statement, name=NEIGHBORHOOD, miles=2.0)


# --- graph -------------------------------------------------------------------


def od_edges(spark, sf):
    return _edges(spark, sf)


def node_strength(spark, sf):
    return graph.node_strength(_edges(spark, sf))


def graph_size(spark, sf):
    return graph.graph_size(_settled_edges(spark, sf))


def undirected_edges(spark, sf):
    return graph.undirected_edges(_edges(spark, sf))


def pagerank(spark, sf):
    return centrality.pagerank(_settled_edges(spark, sf)).select("h3_cell", F.round("pagerank", 7).alias("pagerank"))


def betweenness(spark, sf):
    scores = centrality.betweenness(_settled_edges(spark, sf))
    return scores.select("h3_cell", F.round("betweenness", 6).alias("betweenness"))


def betweenness_inverse(spark, sf):
    """Busy pairs as short links, sources taken in two batches."""
    scores = centrality.betweenness(_settled_edges(spark, sf), length="inverse", batches=2)
    return scores.select("h3_cell", F.round("betweenness", 6).alias("betweenness"))


def node_metrics(spark, sf):
    return _exact_metrics(_settled_edges(spark, sf))


def graph_summary(spark, sf):
    edges = _settled_edges(spark, sf)
    found = graph.graph_summary(edges, _graph_tables(spark, sf)[0], LOGGED_AT)
    cell = lambda c: F.concat_ws(":", c["h3_cell"], c["total_flow"].cast("bigint"), F.round(c["pagerank"] * 1e7).cast("bigint"))
    return found.withColumn("top_10_by_flow", F.array_join(F.transform("top_10_by_flow", cell), ","))


def communities(spark, sf):
    return community.detect_communities(_settled_edges(spark, sf))


def community_check(spark, sf):
    """What a detected partition must hold: every cell labelled, no fault, no worse than the districts."""
    edges = _settled_edges(spark, sf)
    found = settle(community.detect_communities(edges))
    better = community.modularity(edges, found).scalar() >= community.modularity(edges, _districts(edges)).scalar()
    return community.partition_faults(edges, found).withColumn("beats_districts", better)


def district_modularity(spark, sf):
    edges = _settled_edges(spark, sf)
    return community.modularity(edges, _districts(edges)).select(F.round("modularity", 9).alias("modularity"))


def district_parts(spark, sf):
    """Connected parts of each district, named by their smallest cell."""
    edges = _settled_edges(spark, sf)
    pairs = graph.undirected_edges(edges).select(
        F.col("cell_a").alias("a"), F.col("cell_b").alias("b"), F.col("weight").cast("double").alias("w")
    )
    members = _districts(edges).select(F.col("h3_cell").alias("node"), F.col("community").cast("string").alias("community"))
    return community.connected_parts(pairs, members).select(F.col("node").alias("h3_cell"), F.col("community").alias("part"))


def community_sizes(spark, sf):
    return _districts(_settled_edges(spark, sf))


# --- cells, communities and edges --------------------------------------------


_GRAPH_TABLES: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _graph_tables(spark, sf):
    """Node metrics and districts, written once per session and folder of tables, as the load job does."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _GRAPH_TABLES:
        edges = _settled_edges(spark, sf)
        _GRAPH_TABLES[key] = settle(_exact_metrics(edges)), settle(_districts(edges))
    return _GRAPH_TABLES[key]


def top_hexagons(spark, sf):
    return hexes.top_hexagons(*_graph_tables(spark, sf), add_cells(_wide(spark, sf)))


def top_hexagons_betweenness(spark, sf):
    trips = add_cells(_wide(spark, sf))
    return hexes.top_hexagons(*_graph_tables(spark, sf), trips, limit=10, metric="betweenness_norm")


def _busiest_cell(metrics):
    """The cell with rank 1; one value."""
    return metrics.where("rank = 1").first()["h3_cell"]


def hexagon_metrics(spark, sf):
    metrics, districts = _graph_tables(spark, sf)
    return hexes.hexagon_metrics(metrics, districts, _busiest_cell(metrics))


def hexagon_trips(spark, sf):
    edges = _settled_edges(spark, sf)
    cell = graph.node_strength(edges).orderBy(F.col("total_flow").desc(), "h3_cell").first()["h3_cell"]
    return hexes.hexagon_trips(add_cells(_wide(spark, sf)), cell)


def hexagon_detail(spark, sf):
    metrics, districts = _graph_tables(spark, sf)
    detail = hexes.hexagon_detail(metrics, districts, add_cells(_wide(spark, sf)), _busiest_cell(metrics))
    return detail.select("metrics.*", "trips.*")


def community_stats(spark, sf):
    return hexes.community_stats(*_graph_tables(spark, sf))


def community_flow(spark, sf):
    edges = _settled_edges(spark, sf)
    return hexes.community_flow(graph.node_strength(edges), _districts(edges))


def edges_top(spark, sf):
    return hexes.heavy_edges(_edges(spark, sf), min_weight=7, limit=50)


# --- display -----------------------------------------------------------------


def map_styles(spark, sf):
    styled = display.map_styles(*_graph_tables(spark, sf))
    return styled.withColumns({c: F.round(c, 6) for c in ("flow_norm", "opacity", "pr_norm")})


def flow_share(spark, sf):
    shared = display.flow_share(graph.node_strength(_edges(spark, sf)))
    return shared.select("h3_cell", F.round("flow_share", 9).alias("flow_share"))


def neighborhood_board(spark, sf):
    board = display.neighborhood_board(settle(flow.neighborhoods(_wide(spark, sf))))
    return board.withColumn("pct_of_leader", F.round("pct_of_leader", 9))


def pagerank_board(spark, sf):
    leaders = hexes.top_hexagons(*_graph_tables(spark, sf), add_cells(_wide(spark, sf)), metric="pagerank")
    return display.pagerank_board(leaders)


def community_board(spark, sf):
    return display.community_board(hexes.community_stats(*_graph_tables(spark, sf)))


def day_labels(spark, sf):
    trips = _wide(spark, sf)
    labelled = trips.select(
        show.day_label(F.col("day_of_week")).alias("day"), show.rush_label(F.col("is_rush_hour")).alias("period")
    )
    counted = labelled.groupBy("day", "period").agg(F.count(F.lit(1)).alias("trips"))
    return counted.withColumn("millions", show.in_millions(F.col("trips") * 1000))


def cell_labels(spark, sf):
    usual = hexes.usual_neighborhood(add_cells(_wide(spark, sf)), ["avg_ticket"])
    return usual.select("pickup_h3", show.cell_label(F.col("neighborhood"), F.col("pickup_h3")).alias("label"))


def viewport(spark, sf):
    lat, lon = F.col("pickup_centroid_latitude"), F.col("pickup_centroid_longitude")
    at = show.to_viewport(lat, lon, width=720.0, height=560.0, left=260.0, top=20.0)
    points = sample.clean_trips(spark, sf).select("trip_id", at.alias("at"))
    return points.select("trip_id", F.round("at.x", 6).alias("x"), F.round("at.y", 6).alias("y"))


def hexagon_export(spark, sf):
    exported = hexes.hexagon_export(graph.node_strength(_edges(spark, sf)))
    first = F.col("boundary")[0]
    return exported.select(
        "h3_cell", "flow", F.size("boundary").alias("corners"), rounded(first["lat"], 7).alias("first_lat"), rounded(first["lon"], 7).alias("first_lon")
    )


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        month_scan, source_routing, latest_trips, trip_cast_clean, dedup_first, load_dedup, ingest_loss,
        incremental_months, run_log, log_merge, run_totals, data_range, feature_table,
        clean_rule_counts, clean_trips, quality_report,
        profile_shape, profile_nulls, profile_issues, profile_duplicates, describe_trips,
        calendar_features, holiday_trips, fare_features, neighborhood_lookup,
        trip_cells, point_cells, pair_distances, cell_centres, cell_boundaries,
        table_counts, summary, neighborhoods, neighborhood_general, neighborhood_detail,
        flow_hourly, flow_hourly_filtered, flow_weekly, flow_weekly_filtered, flow_seasonal, flow_rush,
        top5_trips, top5_ticket, temporal_breakdowns, temporal_report, temporal_report_top, top_origins,
        parametrised_sql,
        od_edges, node_strength, graph_size, undirected_edges, pagerank, betweenness, betweenness_inverse,
        node_metrics, graph_summary, communities, community_check, district_modularity, district_parts,
        community_sizes,
        top_hexagons, top_hexagons_betweenness, hexagon_metrics, hexagon_trips, hexagon_detail,
        community_stats, community_flow, edges_top,
        map_styles, flow_share, neighborhood_board, pagerank_board, community_board, day_labels, cell_labels, viewport, hexagon_export,
    )
}
QUERIES |= {f"cube_{name}": query for name, query in CUBE_QUERIES.items()}
# The batch jobs, run as of the same day as the landing queries.
QUERIES |= {query.__name__: lambda spark, sf, query=query: query(spark, sf, TODAY) for query in JOB_QUERIES}
