"""Communities of cells that exchange many trips.

Modularity is raised by moving nodes between neighbouring communities, then
communities are split into connected parts, merged into single nodes, and moved
again, as in the Leiden family of methods. The published method is random and
unseeded, so labels differ; the result here is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanweave.operators.graph import undirected_edges
from urbanweave.operators.ordering import with_position
from urbanweave.runtime import settle, settle_counted, settle_with, small_side

# Fixed value: passes over the whole graph, unless another number is asked for.
MAX_PASSES = 10
# A move must raise modularity by this much.
NO_GAIN = 1e-9
# Rounds of name passing planned together before names are compared.
ROUNDS_PER_STEP = 2


def _links(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair of different nodes.

    ``pairs`` is (a, b, w), each unordered pair once; a = b holds inner weight.
    """
    outer = pairs.where("a <> b").select("a", "b", "w")
    return outer.union(outer.select("b", "a", "w"))


def _placed(pairs: DataFrame, members: DataFrame) -> tuple[DataFrame, int, float]:
    """(node, community, degree) with the number of nodes and the total weight."""
    ends = _links(pairs).selectExpr("a AS node", "w").union(pairs.where("a = b").selectExpr("a", "2 * w"))
    degrees = ends.groupBy("node").agg(F.sum("w").alias("degree"))
    placed, seen = settle_with(
        degrees.join(members, "node").select("node", "community", "degree"),
        n=F.count(F.lit(1)),
        weight=F.sum("degree"),
    )
    return placed, seen["n"], (seen["weight"] or 0.0) / 2


def _with_ends(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs with the communities ca and cb of their ends."""
    of_a = members.selectExpr("node AS a", "community AS ca")
    return pairs.join(of_a, "a").join(members.selectExpr("node AS b", "community AS cb"), "b")


def modularity_parts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(community, inside, degree): weight inside and total degree of each community."""
    placed = _with_ends(pairs, members)
    within = F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(F.lit(0.0))
    # One row per pair and end, so the weights are summed in a single aggregation.
    ends = placed.select(
        F.explode(
            F.array(
                F.struct(F.col("ca").alias("community"), within.alias("inside"), F.col("w").alias("degree")),
                F.struct(F.col("cb").alias("community"), F.lit(0.0).alias("inside"), F.col("w").alias("degree")),
            )
        ).alias("end")
    ).select("end.*")
    return ends.groupBy("community").agg(F.sum("inside").alias("inside"), F.sum("degree").alias("degree"))


def modularity_of(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row with the weighted modularity of a partition (NULL for a graph without weight)."""
    return (
        modularity_parts(pairs, members)
        .agg(
            F.sum("inside").alias("inside"),
            (F.sum("degree") / 2).alias("m"),
            F.sum(F.col("degree") * F.col("degree")).alias("squares"),
        )
        .select(
            F.when(
                F.col("m") > 0,
                F.col("inside") / F.col("m") - F.col("squares") / (4 * F.col("m") * F.col("m")),
            ).alias("modularity")
        )
    )


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Modularity of (h3_cell, community) on the undirected graph of the directed edges."""
    members = communities.select(F.col("h3_cell").alias("node"), "community")
    return modularity_of(_pairs(edges), members)


def _pairs(edges: DataFrame) -> DataFrame:
    return undirected_edges(edges).select(
        F.col("cell_a").alias("a"), F.col("cell_b").alias("b"), F.col("weight").cast("double").alias("w")
    )


def _best_moves(links: DataFrame, placed: DataFrame, nodes: int, total: float) -> DataFrame:
    """(node, community, degree, target, gain, kept, size): the best community of every node.

    ``gain`` is what moving there alone adds to modularity, 0 where the node is
    best off. ``kept`` is its weight into its own community and ``size`` that
    community's degree; they give the modularity of the present placing. A node
    weighs up the communities it has links into; ties go to the smallest name.
    """
    sizes = placed.groupBy(F.col("community").alias("target")).agg(F.sum("degree").alias("size"))
    small = small_side(placed, nodes)
    toward = (
        links.join(small.selectExpr("node AS b", "community AS target"), "b")
        .groupBy(F.col("a").alias("node"), "target")
        .agg(F.sum("w").alias("weight"))
    )
    own = placed.selectExpr("node", "community AS target", "0D AS weight")
    value = f"""weight / {total}D
        - degree * (size - if(target = community, degree, 0D)) / {2 * total * total}D"""
    best = (
        toward.union(own)
        .groupBy("node", "target")
        .agg(F.sum("weight").alias("weight"))
        .join(small, "node")
        .join(small_side(sizes, nodes), "target")
        .selectExpr("*", f"{value} AS value", "target = community AS stays")
        .groupBy("node")
        .agg(
            F.expr("min(struct(-value AS cost, target))").alias("best"),
            F.expr("max(if(stays, value, NULL))").alias("stay"),
            F.expr("max(if(stays, weight, NULL))").alias("kept"),
            F.expr("max(if(stays, size, NULL))").alias("size"),
            F.min("community").alias("community"),
            F.min("degree").alias("degree"),
        )
    )
    gain = f"if(best.target <> community AND -best.cost - stay > {NO_GAIN}D, -best.cost - stay, 0D)"
    return best.selectExpr("node", "community", "degree", "best.target AS target", f"{gain} AS gain", "kept", "size")


def _local_moves(pairs: DataFrame, members: DataFrame) -> tuple[DataFrame, bool]:
    """Move single nodes until none gains; returns (node, community) and whether any moved.

    A turn moves half of the gaining nodes, picked by hash, and counts only if it
    raises modularity. If not, half as many are tried from the same placing, down
    to the one node that gains most, which always raises it by its gain. Modularity
    therefore rises with every turn that counts, and the loop ends.
    """
    links = _links(pairs)
    placed, nodes, total = _placed(pairs, members)
    if not total:
        return members, False
    measures = {
        "waiting": F.count_if(F.col("gain") > 0),
        # Up to the inner weight of single nodes, which no move changes.
        "quality": F.expr(f"sum(kept) / {2 * total}D - sum(degree * size) / {4 * total * total}D"),
        "lead": F.expr("max(struct(gain, node)).node"),
    }
    moves, seen = settle_with(_best_moves(links, placed, nodes, total), **measures)
    turn, groups, any_moved = 0, 2, False
    while seen["waiting"]:
        alone = groups > seen["waiting"]
        picked = F.col("node") == F.lit(seen["lead"]) if alone else F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(groups)) == 0
        target = F.when(picked & (F.col("gain") > 0), F.col("target")).otherwise(F.col("community"))
        tried = moves.select("node", target.alias("community"), "degree")
        after, reached = settle_with(_best_moves(links, tried, nodes, total), **measures)
        turn += 1
        if alone or reached["quality"] > seen["quality"] + NO_GAIN / 2:
            moves, seen, groups, any_moved = after, reached, 2, True
        else:
            groups *= 2
    return moves.select("node", "community"), any_moved


def connected_parts(pairs: DataFrame, members: DataFrame, nodes: int | None = None) -> DataFrame:
    """(node, community) with every community split into its connected parts.

    Each part is named after its smallest node. A round passes the smallest known
    name along the links and then takes the name of the name, so names travel in
    leaps and the rounds grow with the logarithm of a part's width.
    """
    inner = _with_ends(pairs, members).where("ca = cb")
    links = settle(_links(inner).select("a", "b"))
    nodes = members.count() if nodes is None else nodes
    names = members.selectExpr("node", "node AS name")
    while True:
        start = names.selectExpr("node", "name AS old")
        for _ in range(ROUNDS_PER_STEP):
            heard = links.join(small_side(names.selectExpr("node AS a", "name"), nodes), "a").selectExpr("b AS node", "name")
            passed = names.union(heard).groupBy("node").agg(F.min("name").alias("name"))
            further = small_side(passed.selectExpr("node AS name", "name AS further"), nodes)
            names = passed.join(further, "name").selectExpr("node", "further AS name")
        named = names.join(small_side(start, nodes), "node")
        names, seen = settle_with(named.selectExpr("node", "name", "name < old AS fresh"), fresh=F.count_if("fresh"))
        names = names.select("node", "name")
        if not seen["fresh"]:
            return names.selectExpr("node", "name AS community")


def _merged(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The graph whose nodes are the communities."""
    return (
        _with_ends(pairs, members)
        .groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
        .agg(F.sum("w").alias("w"))
    )


def _one_pass(pairs: DataFrame, members: DataFrame, nodes: int) -> tuple[DataFrame, bool]:
    """Move nodes, then whole connected communities, until merging changes nothing.

    Returns (node, community), every community connected, and whether any node moved.
    """
    members, any_moved = _local_moves(pairs, members)
    if not any_moved:
        return members, False
    members, merged = connected_parts(pairs, members, nodes), False
    while True:
        coarse = settle(_merged(pairs, members))
        groups = members.select(F.col("community").alias("node")).distinct()
        start, count = settle_counted(groups.select("node", F.col("node").alias("community")))
        moved, any_moved = _local_moves(coarse, start)
        if not any_moved:
            return (connected_parts(pairs, members, nodes) if merged else members), True
        wider = moved.select(F.col("node").alias("community"), F.col("community").alias("wider"))
        members = settle(members.join(small_side(wider, count), "community").selectExpr("node", "wider AS community"))
        merged = True


def detect_communities(edges: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """(h3_cell, community, community_size); community 0 is the largest, ties by smallest cell.

    Every pass starts from the result of the one before and never lowers its
    modularity. The passes end when no single node gains by moving, so then the
    communities are connected and no move of one node raises modularity;
    ``max_passes`` ends them earlier.
    """
    pairs = settle(_pairs(edges))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    members, count = settle_counted(nodes.select("node", F.col("node").alias("community")))
    for _ in range(max_passes if count else 0):
        members, moved = _one_pass(pairs, members, count)
        if not moved:
            break
    return number_communities(members.select(F.col("node").alias("h3_cell"), "community"))


def partition_faults(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row on (h3_cell, community, community_size): labelled nodes, and what is wrong with the labels.

    misnumbered counts cells whose number or size is not that of ``number_communities``,
    unlabelled those of the graph without a label, split the connected parts beyond
    one per community, gaining the cells that would still raise modularity elsewhere.
    """
    pairs = settle(_pairs(edges))
    labels = settle(communities.select("h3_cell", "community", "community_size"))
    members = labels.select(F.col("h3_cell").alias("node"), "community")
    nodes = pairs.select(F.col("a").alias("h3_cell")).union(pairs.select("b")).distinct()
    unlabelled = nodes.join(labels, "h3_cell", "left_anti")
    again = number_communities(labels.select("h3_cell", "community")).withColumnsRenamed({"community": "number", "community_size": "size"})
    misnumbered = labels.join(again, "h3_cell").where("community <> number OR community_size <> size")
    parts = connected_parts(pairs, members)
    placed, count, total = _placed(pairs, members)
    gaining = _best_moves(_links(pairs), placed, count, total).where("gain > 0") if total else placed.limit(0)

    def rows(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    return edges.sparkSession.range(1).select(
        rows(labels).alias("nodes"),
        rows(misnumbered).alias("misnumbered"),
        rows(unlabelled).alias("unlabelled"),
        rows(gaining).alias("gaining"),
        (rows(parts.select("community").distinct()) - rows(labels.select("community").distinct())).alias("split"),
    )


def number_communities(members: DataFrame) -> DataFrame:
    """Integer numbers by size, largest first, and the size on every member."""
    sizes = members.groupBy("community").agg(
        F.count(F.lit(1)).cast("int").alias("community_size"), F.min("h3_cell").alias("first_cell")
    )
    numbered = with_position(sizes, [F.col("community_size").desc(), F.col("first_cell")], "position")
    return members.join(numbered, "community").select(
        "h3_cell", (F.col("position") - 1).cast("int").alias("community"), "community_size"
    )
