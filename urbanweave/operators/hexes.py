"""Queries over cells, communities and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanweave.functions.casting import rounded
from urbanweave.functions.hexgrid import cell_boundary
from urbanweave.operators.flow import combined_mean, partial_means

# Metrics a ranking may use, and the accepted sizes of the answers.
RANKING_METRICS = ["total_flow", "pagerank", "betweenness_norm", "in_strength", "out_strength"]
MAX_HEXAGONS = 100
MAX_EDGES = 5000


def _check_limit(limit: int, most: int) -> None:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")


def usual_neighborhood(trips: DataFrame, means: list[str]) -> DataFrame:
    """Per pickup cell: its most frequent neighbourhood, trips, and the asked means.

    Ties go to the first name; trips without neighbourhood count in the means
    only. One row per (cell, neighbourhood) is built from the trips; the choice
    is made among those.
    """
    per_name = (
        trips.where(F.col("pickup_h3").isNotNull())
        .groupBy("pickup_h3", "neighborhood")
        .agg(F.count(F.lit(1)).alias("_trips"), *partial_means(means))
    )
    named = F.when(F.col("neighborhood").isNotNull(), F.struct((-F.col("_trips")).alias("order"), "neighborhood"))
    return per_name.groupBy("pickup_h3").agg(
        F.min(named)["neighborhood"].alias("neighborhood"),
        F.sum("_trips").alias("total_trips"),
        *[combined_mean(m) for m in means],
    )


def with_community(metrics: DataFrame, communities: DataFrame) -> DataFrame:
    return metrics.join(communities, "h3_cell", "left")


def top_hexagons(
    metrics: DataFrame, communities: DataFrame, trips: DataFrame, limit: int = 20, metric: str = "total_flow"
) -> DataFrame:
    """Leading cells by ``metric`` with community, usual neighbourhood and means.

    The leaders (at most 100) are picked first, so the trips are filtered to
    their cells before they are aggregated.
    """
    if metric not in RANKING_METRICS:
        raise ValueError(f"metric must be one of {RANKING_METRICS}")
    _check_limit(limit, MAX_HEXAGONS)
    order = [F.col(metric).desc_nulls_first(), F.col("h3_cell")]
    leaders = metrics.orderBy(*order).limit(limit)
    cells = F.broadcast(leaders.select(F.col("h3_cell").alias("pickup_h3")))
    usual = usual_neighborhood(trips.join(cells, "pickup_h3", "left_semi"), ["avg_ticket", "avg_miles"])
    return (
        with_community(leaders, communities.select("h3_cell", "community"))
        .join(usual.withColumnRenamed("pickup_h3", "h3_cell"), "h3_cell", "left")
        .select(
            "h3_cell",
            "total_flow",
            "in_strength",
            "out_strength",
            "pagerank",
            "betweenness_norm",
            "rank",
            "community",
            "neighborhood",
            "avg_ticket",
            "avg_miles",
        )
        .orderBy(*order)
    )


def hexagon_trips(trips: DataFrame, cell: str) -> DataFrame:
    """Always one row: trips starting in the cell, their means and usual neighbourhood."""
    means = ["avg_ticket", "avg_miles", "avg_speed_mph"]
    from_cell = trips.where(F.col("pickup_h3") == cell)
    totals = from_cell.groupBy("neighborhood").agg(F.count(F.lit(1)).alias("_trips"), *partial_means(means))
    named = F.when(F.col("neighborhood").isNotNull(), F.struct((-F.col("_trips")).alias("order"), "neighborhood"))
    return totals.agg(
        F.coalesce(F.sum("_trips"), F.lit(0)).alias("total_trips"),
        *[combined_mean(m) for m in means],
        F.min(named)["neighborhood"].alias("neighborhood"),
    ).withColumnRenamed("avg_speed_mph", "avg_speed")


def hexagon_metrics(metrics: DataFrame, communities: DataFrame, cell: str) -> DataFrame:
    """Node metrics and community of one cell; empty for an unknown cell."""
    return with_community(metrics.where(F.col("h3_cell") == cell), communities)


def hexagon_detail(metrics: DataFrame, communities: DataFrame, trips: DataFrame, cell: str) -> DataFrame:
    """One nested row (metrics, trips); empty for an unknown cell."""
    found = hexagon_metrics(metrics, communities, cell)
    started = hexagon_trips(trips, cell)
    nested = started.select(F.struct(*started.columns).alias("trips"))
    return found.select(F.struct(*found.columns).alias("metrics"), nested.scalar().alias("trips"))


def community_stats(metrics: DataFrame, communities: DataFrame) -> DataFrame:
    """Cells, flow and mean PageRank per community, most flow first."""
    return (
        communities.join(metrics, "h3_cell")
        .groupBy("community")
        .agg(
            F.count(F.lit(1)).alias("hexagon_count"),
            F.sum("total_flow").alias("total_flow"),
            rounded(F.avg("pagerank"), 6).alias("avg_pagerank"),
        )
        .orderBy(F.col("total_flow").desc(), "community")
    )


def community_flow(metrics: DataFrame, communities: DataFrame) -> DataFrame:
    """Cells and flow (sum and mean, rounded half to even) per community."""
    return (
        with_community(metrics, communities)
        .where(F.col("community").isNotNull())
        .groupBy("community")
        .agg(
            F.count("total_flow").alias("count"),
            F.bround(F.sum("total_flow"), 0).alias("sum"),
            F.bround(F.avg("total_flow"), 0).alias("mean"),
        )
    )


def heavy_edges(edges: DataFrame, min_weight: int = 100, limit: int = 500) -> DataFrame:
    """Edges from ``min_weight`` trips up, heaviest first."""
    _check_limit(limit, MAX_EDGES)
    return (
        edges.where(F.col("weight") >= min_weight)
        .orderBy(F.col("weight").desc(), "pickup_h3", "dropoff_h3")
        .limit(limit)
    )


def hexagon_export(metrics: DataFrame) -> DataFrame:
    """Flow and boundary polygon per cell, for map drawing."""
    return metrics.select("h3_cell", F.col("total_flow").alias("flow"), cell_boundary(F.col("h3_cell")).alias("boundary"))
