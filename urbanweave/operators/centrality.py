"""PageRank and betweenness as rounds of joins and aggregations.

Each round is settled in the checkpoint folder, so a lost executor repeats one
round and plans stay short. The loops only read back counts and sums.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanweave.operators.graph import graph_nodes, node_strength
from urbanweave.operators.ordering import with_position
from urbanweave.runtime import settle, settle_counted, settle_with, small_side

# Fixed value: share of a node's score that follows its links.
DAMPING = 0.85


# Rounds planned together before the scores are settled and compared.
ROUNDS_PER_STEP = 5
# Pairs of source and node held at a time by betweenness.
PAIRS_PER_BATCH = 50_000_000


def _score_links(edges: DataFrame) -> DataFrame:
    """(origin, target, share, base): the share of the origin's score each edge passes on.

    Every node also has a row to itself that passes nothing and carries its
    base score, so a round reads the scores only once.
    """
    out = edges.groupBy(F.col("pickup_h3").alias("origin")).agg(F.sum("weight").alias("out"))
    passing = (
        edges.withColumnRenamed("pickup_h3", "origin")
        .join(out, "origin")
        .selectExpr("origin", "dropoff_h3 AS target", "weight / out AS share", "0D AS base")
    )
    return passing.union(graph_nodes(edges).selectExpr("h3_cell", "h3_cell", "0D", "1D"))


def pagerank(edges: DataFrame, damping: float = DAMPING, tolerance: float = 1e-10) -> DataFrame:
    """(h3_cell, pagerank): weighted, directed, summing to 1.

    The edges are read three times, so pass a table or settled edges. Solves
    x = 1 + damping * (incoming share of x), ``damping`` lying between 0 and 1.
    Scaled to sum 1, this equals the form in which nodes without outgoing links
    spread their score evenly, but needs no total in each round. The change
    shrinks by ``damping`` per round at least, so the loop ends. After each step the scores are scaled so
    that their sums before and after a round agree, which takes out the error
    that fades slowest.
    """
    if not 0 < damping < 1:
        raise ValueError("damping must lie between 0 and 1")
    links = settle(_score_links(edges))
    start = links.where("base = 1").selectExpr("origin AS h3_cell", f"{1 / (1 - damping)}D AS score")
    scores, seen = settle_with(start, n=F.count(F.lit(1)), total=F.sum("score"))
    nodes, total = seen["n"], seen["total"]
    if nodes == 0:
        return scores.withColumnRenamed("score", "pagerank")

    enough = tolerance * (1 - damping) / damping
    longest = math.ceil(math.log(enough) / math.log(damping)) + 1
    for _ in range(math.ceil(longest / ROUNDS_PER_STEP)):
        for _ in range(ROUNDS_PER_STEP):
            known = small_side(scores.selectExpr("h3_cell AS origin", "score"), nodes)
            scores = (
                links.join(known, "origin")
                .groupBy(F.col("target").alias("h3_cell"))
                .agg(
                    F.expr(f"sum({damping}D * share * score + base)").alias("score"),
                    F.expr("sum(base * score)").alias("before"),
                )
            )
        scores, seen = settle_with(
            scores, change=F.expr("sum(abs(score - before))"), total=F.sum("score"), mass=F.sum("before")
        )
        total = seen["total"]
        if seen["change"] / total < enough:
            break
        scale = nodes / (seen["mass"] - total + nodes)
        scores = scores.selectExpr("h3_cell", f"1 + {scale}D * (score - 1) AS score")
    return scores.select("h3_cell", (F.col("score") / total).alias("pagerank"))


def edge_lengths(edges: DataFrame, length: str = "weight") -> DataFrame:
    """(tail, head, len). ``weight`` takes trips as length, so busy pairs are far
    apart, as in the published figures; ``inverse`` makes busy pairs close. Trips
    are whole numbers, so their sums are compared exactly."""
    measures = {"weight": F.col("weight").cast("bigint"), "inverse": 1.0 / F.col("weight")}
    if length not in measures:
        raise ValueError(f"length must be one of {sorted(measures)}")
    return edges.select(
        F.col("pickup_h3").alias("tail"), F.col("dropoff_h3").alias("head"), measures[length].alias("len")
    )


def _kind(arcs: DataFrame) -> str:
    return dict(arcs.dtypes)["len"]


def _same_length(a, b, kind: str):
    """Whole lengths must be equal; fractions may differ by rounding."""
    return a == b if kind == "bigint" else F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))


def shortest_distances(arcs: DataFrame, arc_rows: int, sources: DataFrame) -> DataFrame:
    """(source, node, dist) for every reachable node.

    Starts from the arcs that leave a source. Only pairs improved in the last
    round are extended in the next.
    """
    kind = _kind(arcs)
    own = sources.selectExpr("h3_cell AS source", "h3_cell AS node", f"cast(0 AS {kind}) AS dist", "false AS fresh")
    leaving = arcs.join(sources.withColumnRenamed("h3_cell", "tail"), "tail", "left_semi")
    state = settle(own.union(leaving.selectExpr("tail", "head", "len", "true")))
    arcs = small_side(arcs, arc_rows)
    while True:
        reached = (
            state.where("fresh")
            .join(arcs, F.col("node") == F.col("tail"))
            .selectExpr("source", "head", f"cast(NULL AS {kind})", "dist + len")
        )
        known = state.selectExpr("source", "node", "dist AS old", f"cast(NULL AS {kind}) AS new")
        merged = known.union(reached).groupBy("source", "node").agg(F.min("old").alias("old"), F.min("new").alias("new"))
        state, seen = settle_with(
            merged.selectExpr(
                "source", "node", "least(old, new) AS dist", "coalesce(new < old, old IS NULL) AS fresh"
            ),
            fresh=F.count_if("fresh"),
        )
        if seen["fresh"] == 0:
            return state.select("source", "node", "dist")


def _shortest_path_arcs(dist: DataFrame, arcs: DataFrame, arc_rows: int) -> DataFrame:
    """(source, tail, head): arcs that lie on some shortest path from ``source``.

    The head must be farther away than the tail, so the arcs never form a cycle
    and the waves along them end.
    """
    via = dist.join(small_side(arcs, arc_rows), F.col("node") == F.col("tail")).select(
        "source", "tail", "head", F.col("dist").alias("at_tail"), (F.col("dist") + F.col("len")).alias("through")
    )
    ends = dist.withColumnRenamed("node", "head")
    return (
        via.join(ends, ["source", "head"])
        .where(_same_length(F.col("through"), F.col("dist"), _kind(arcs)) & (F.col("dist") > F.col("at_tail")))
        .select("source", "tail", "head")
    )


def _path_counts(dag: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, paths): number of shortest paths, summed over their hop counts."""
    wave, rows = settle_counted(dag.where("tail = source").selectExpr("source", "head AS node", "1D AS paths"))
    waves = [sources.selectExpr("h3_cell AS source", "h3_cell AS node", "1D AS paths"), wave]
    while rows:
        grown = (
            dag.join(small_side(wave.withColumnRenamed("node", "tail"), rows), ["source", "tail"])
            .groupBy("source", F.col("head").alias("node"))
            .agg(F.sum("paths").alias("paths"))
        )
        wave, rows = settle_counted(grown)
        waves.append(wave)
    return _all_of(waves).groupBy("source", "node").agg(F.sum("paths").alias("paths"))


def _all_of(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _dependencies(dag: DataFrame, paths: DataFrame, path_rows: int) -> DataFrame:
    """(node, score): how much the shortest paths of these sources depend on each node.

    A node's dependency is the sum over its successors of the share of paths
    through it, passed backwards hop by hop until nothing is left to pass.
    """
    tails = small_side(paths.select("source", F.col("node").alias("tail"), F.col("paths").alias("at_tail")), path_rows)
    heads = small_side(paths.select("source", F.col("node").alias("head"), F.col("paths").alias("at_head")), path_rows)
    shares = settle(
        dag.where(F.col("tail") != F.col("source"))
        .join(tails, ["source", "tail"])
        .join(heads, ["source", "head"])
        .select("source", "tail", "head", (F.col("at_tail") / F.col("at_head")).alias("share"))
    )
    wave = paths.where(F.col("node") != F.col("source")).select("source", "node", F.lit(1.0).alias("score"))
    rows, waves = path_rows, []
    while rows:
        passed = (
            shares.join(small_side(wave.withColumnRenamed("node", "head"), rows), ["source", "head"])
            .groupBy("source", F.col("tail").alias("node"))
            .agg(F.sum(F.col("share") * F.col("score")).alias("score"))
        )
        wave, rows = settle_counted(passed)
        waves.append(wave)
    return _all_of(waves).groupBy("node").agg(F.sum("score").alias("score"))


def betweenness(edges: DataFrame, length: str = "weight", batches: int | None = None) -> DataFrame:
    """(h3_cell, betweenness): directed, not normalised, ends of a path excluded.

    The working set holds one row per (source, reachable node). ``batches``
    splits the sources into that many hashed groups to bound it; every source is
    still used, and the result is the same. Unset, it follows from the nodes.
    """
    arcs, arc_rows = settle_counted(edge_lengths(edges, length))
    nodes = settle(arcs.selectExpr("explode(array(tail, head)) AS h3_cell").distinct())
    parts = [nodes.selectExpr("h3_cell", "0D AS score")]
    if batches is None:
        batches = math.ceil(max(1, nodes.count()) ** 2 / PAIRS_PER_BATCH)
    for batch in range(batches if arc_rows else 0):
        sources = nodes.where(F.pmod(F.xxhash64("h3_cell"), F.lit(batches)) == batch)
        dist = shortest_distances(arcs, arc_rows, sources)
        dag = settle(_shortest_path_arcs(dist, arcs, arc_rows))
        paths, path_rows = settle_counted(_path_counts(dag, sources))
        if path_rows:
            parts.append(_dependencies(dag, paths, path_rows).withColumnRenamed("node", "h3_cell"))
    return _all_of(parts).groupBy("h3_cell").agg(F.sum("score").alias("betweenness"))


def node_metrics(edges: DataFrame, length: str = "weight", batches: int | None = None) -> DataFrame:
    """Strengths, PageRank, betweenness (raw and relative to the largest) and rank by flow."""
    edges = settle(edges)
    scored = settle(
        node_strength(edges)
        .join(pagerank(edges), "h3_cell")
        .join(betweenness(edges, length, batches), "h3_cell")
    )
    largest = scored.agg(F.max("betweenness")).scalar()
    relative = F.when(largest > 0, F.col("betweenness") / largest).otherwise(F.lit(0.0))
    placed = with_position(
        scored.withColumn("betweenness_norm", relative), [F.col("total_flow").desc(), F.col("h3_cell")]
    )
    return placed.withColumn("rank", F.col("rank").cast("int"))  # the contract's type
