"""Origin-destination graph: edges, nodes, strengths and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: pairs with fewer trips are noise.
MIN_EDGE_WEIGHT = 5


def od_edges(trips: DataFrame, min_weight: int = MIN_EDGE_WEIGHT) -> DataFrame:
    """Trips per directed cell pair, without same-cell trips and light pairs."""
    origin, destination = F.col("pickup_h3"), F.col("dropoff_h3")
    return (
        trips.where(origin.isNotNull() & destination.isNotNull() & (origin != destination))
        .groupBy("pickup_h3", "dropoff_h3")
        .agg(F.count(F.lit(1)).alias("weight"))
        .where(F.col("weight") >= min_weight)
    )


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Distinct end points of the edges."""
    return edges.selectExpr("explode(array(pickup_h3, dropoff_h3)) AS h3_cell").distinct()


def node_strength(edges: DataFrame) -> DataFrame:
    """Incoming, outgoing and total trips per cell; both ends of an edge in one aggregation."""
    ends = edges.selectExpr(
        """inline(array(
            named_struct('h3_cell', dropoff_h3, 'arriving', cast(weight AS double), 'leaving', 0D),
            named_struct('h3_cell', pickup_h3, 'arriving', 0D, 'leaving', cast(weight AS double))))"""
    )
    return (
        ends.groupBy("h3_cell")
        .agg(F.sum("arriving").alias("in_strength"), F.sum("leaving").alias("out_strength"))
        .withColumn("total_flow", F.col("in_strength") + F.col("out_strength"))
    )


def undirected_edges(edges: DataFrame) -> DataFrame:
    """One row per unordered pair, weights of both directions added."""
    a, b = F.col("pickup_h3"), F.col("dropoff_h3")
    return edges.groupBy(F.least(a, b).alias("cell_a"), F.greatest(a, b).alias("cell_b")).agg(
        F.sum("weight").alias("weight")
    )


def graph_size(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density of the directed graph without loops."""
    nodes = graph_nodes(edges).agg(F.count(F.lit(1)))
    n, e = F.col("nodes"), F.col("edges")
    return (
        edges.agg(F.count(F.lit(1)).alias("edges"))
        .select(nodes.scalar().alias("nodes"), "edges")
        .withColumn("density", F.when(n > 1, e / (n * (n - 1)).cast("double")))
    )


def graph_summary(
    edges: DataFrame,
    metrics: DataFrame,
    generated_at: str,
    min_weight: int = MIN_EDGE_WEIGHT,
    top: int = 10,
) -> DataFrame:
    """One nested row: size, density, settings and the cells with most flow."""
    leaders = metrics.orderBy(F.col("total_flow").desc(), "h3_cell").limit(top)
    listed = leaders.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("total_flow")).alias("_order"), "h3_cell", "total_flow", "pagerank")))
        .alias("cells")
    ).select(
        F.transform("cells", lambda c: F.struct(c["h3_cell"].alias("h3_cell"), c["total_flow"].alias("total_flow"), c["pagerank"].alias("pagerank")))
    )
    return graph_size(edges).select(
        F.lit(generated_at).alias("generated_at"),
        "nodes",
        "edges",
        F.lit(min_weight).alias("min_edge_weight"),
        F.lit(True).alias("is_directed"),
        "density",
        listed.scalar().alias("top_10_by_flow"),
    )
