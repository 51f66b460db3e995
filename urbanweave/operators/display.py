"""Scaled and labelled tables for maps and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanweave.functions.display import (
    cell_label,
    community_color,
    flow_color,
    four_digits,
    in_millions,
    in_thousands,
    opacity,
    pagerank_color,
)
from urbanweave.operators.hexes import with_community
from urbanweave.operators.ordering import with_position


def _extremes(df: DataFrame, name: str) -> tuple[Column, Column]:
    # Scalar subqueries: the extremes are aggregated in parallel and no window
    # has to hold the whole table in one task.
    return df.agg(F.min(name)).scalar(), df.agg(F.max(name)).scalar()


def min_max_scaled(df: DataFrame, name: str) -> Column:
    """0 at the smallest value, 1 at the largest; NULL when all are equal."""
    low, high = _extremes(df, name)
    return F.when(high > low, (F.col(name) - low) / (high - low))


def map_styles(metrics: DataFrame, communities: DataFrame) -> DataFrame:
    """Scaled flow and PageRank, opacity and the three colours of each cell."""
    flow, score = min_max_scaled(metrics, "total_flow"), min_max_scaled(metrics, "pagerank")
    styled = with_community(metrics, communities).withColumns({"flow_norm": flow, "pr_norm": score})
    return styled.select(
        "h3_cell",
        "total_flow",
        "community",
        "flow_norm",
        opacity(F.col("flow_norm")).alias("opacity"),
        flow_color(F.col("flow_norm")).alias("flow_color"),
        community_color(F.col("community")).alias("community_color"),
        "pr_norm",
        pagerank_color(F.col("pr_norm")).alias("pagerank_color"),
    )


def flow_share(metrics: DataFrame, name: str = "total_flow") -> DataFrame:
    """Flow relative to the largest, at most 1; missing flow is 0, and the divisor is at least 1 then."""
    flow = F.col(name)
    largest = metrics.agg(F.max(F.when(flow != 0, flow).otherwise(1.0))).scalar()
    return metrics.withColumn("flow_share", F.least(F.coalesce(flow, F.lit(0.0)) / largest, F.lit(1.0)))


def leader_share(df: DataFrame, name: str, tie_break: str) -> DataFrame:
    """Position by ``name`` descending and percent of the leading value."""
    leading = df.agg(F.max(name)).scalar()
    shared = df.withColumn("pct_of_leader", F.when(leading != 0, F.col(name) / leading * 100))
    placed = with_position(shared, [F.col(name).desc_nulls_last(), F.col(tie_break)], "position")
    return placed.withColumn("position", F.col("position").cast("int"))


def neighborhood_board(neighborhoods: DataFrame) -> DataFrame:
    """The neighbourhood list as shown: position, upper-case name, share of the leader, short count."""
    return leader_share(neighborhoods, "total_trips", "neighborhood").select(
        "position",
        F.upper("neighborhood").alias("title"),
        "total_trips",
        in_thousands(F.col("total_trips")).alias("trips_label"),
        "pct_of_leader",
    )


def pagerank_board(leaders: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` of ``top_hexagons`` by PageRank: position, label, short score, community."""
    order = [F.col("pagerank").desc(), F.col("h3_cell")]
    # n rows, so one task may number them.
    return leaders.orderBy(*order).limit(n).select(
        F.row_number().over(W.orderBy(*order)).alias("position"),
        cell_label(F.col("neighborhood"), F.col("h3_cell")).alias("label"),
        four_digits(F.col("pagerank")).alias("pagerank_label"),
        "community",
    )


def community_board(stats: DataFrame) -> DataFrame:
    """The community list as shown: cells, flow in millions, short mean PageRank."""
    return stats.select(
        "community",
        "hexagon_count",
        in_millions(F.col("total_flow"), 1).alias("flow_label"),
        four_digits(F.col("avg_pagerank")).alias("pagerank_label"),
    )
