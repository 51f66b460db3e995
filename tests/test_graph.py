import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanweave.operators import graph
from urbanweave.operators.centrality import betweenness, node_metrics, pagerank
from urbanweave.operators.community import connected_parts, detect_communities, modularity, partition_faults

EDGE = "pickup_h3 string, dropoff_h3 string, weight bigint"


def edge_frame(spark, edges):
    return spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], EDGE)


def random_edges(seed, nodes=9, density=0.3, weights=4):
    rng = np.random.default_rng(seed)
    return {
        (f"n{a}", f"n{b}"): int(rng.integers(1, weights + 1))
        for a, b in itertools.permutations(range(nodes), 2)
        if rng.random() < density
    }


def all_shortest_paths(edges, source):
    """Every shortest path from ``source``, by walking all simple paths."""
    following = defaultdict(list)
    for (a, b), w in edges.items():
        following[a].append((b, w))
    best, paths = {}, defaultdict(list)

    def walk(path, length):
        node = path[-1]
        if length < best.get(node, float("inf")):
            best[node], paths[node] = length, [list(path)]
        elif length == best[node]:
            paths[node].append(list(path))
        else:
            return
        for other, w in following[node]:
            if other not in path:
                walk([*path, other], length + w)

    walk([source], 0)
    return paths


def brute_betweenness(edges):
    nodes = sorted({n for pair in edges for n in pair})
    scores = dict.fromkeys(nodes, 0.0)
    for source in nodes:
        for target, paths in all_shortest_paths(edges, source).items():
            if target == source:
                continue
            for path in paths:
                for node in path[1:-1]:
                    scores[node] += 1 / len(paths)
    return scores


def brute_pagerank(edges, damping=0.85):
    nodes = sorted({n for pair in edges for n in pair})
    index = {n: i for i, n in enumerate(nodes)}
    step = np.zeros((len(nodes), len(nodes)))
    for (a, b), w in edges.items():
        step[index[a], index[b]] = w
    out = step.sum(axis=1)
    step[out == 0] = 1
    step /= step.sum(axis=1, keepdims=True)
    score = np.full(len(nodes), 1 / len(nodes))
    for _ in range(500):
        score = (1 - damping) / len(nodes) + damping * score @ step
    return dict(zip(nodes, score))


def test_edges(spark):
    trips = [("a", "b")] * 5 + [("b", "a")] * 4 + [("a", "a")] * 9 + [(None, "a")] * 9 + [("a", None)] * 9 + [("b", "c")] * 6
    frame = spark.createDataFrame(trips, "pickup_h3 string, dropoff_h3 string")
    edges = graph.od_edges(frame)
    assert {tuple(r) for r in edges.collect()} == {("a", "b", 5), ("b", "c", 6)}
    strength = {r.h3_cell: (r.in_strength, r.out_strength, r.total_flow) for r in graph.node_strength(edges).collect()}
    assert strength == {"a": (0, 5, 5), "b": (5, 6, 11), "c": (6, 0, 6)}
    size = graph.graph_size(edges).first()
    assert (size.nodes, size.edges, size.density) == (3, 2, 2 / 6)


def test_published_density():
    assert 12058 / (414 * 413) == pytest.approx(0.07052204325601524, rel=1e-15)


def test_undirected_edges_add_both_directions(spark):
    edges = edge_frame(spark, {("b", "a"): 3, ("a", "b"): 4, ("c", "a"): 1})
    assert {tuple(r) for r in graph.undirected_edges(edges).collect()} == {("a", "b", 7), ("a", "c", 1)}


@pytest.mark.parametrize("seed, density", [(1, 0.2), (7, 0.35)])
def test_pagerank(spark, seed, density):
    edges = random_edges(seed, density=density)
    edges[("n0", "end")] = 3  # nothing leaves "end"
    found = {r.h3_cell: r.pagerank for r in pagerank(edge_frame(spark, edges)).collect()}
    expected = brute_pagerank(edges)
    assert found.keys() == expected.keys()
    assert sum(found.values()) == pytest.approx(1)
    for node, score in expected.items():
        assert found[node] == pytest.approx(score, abs=1e-10)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_betweenness(spark, seed):
    edges = random_edges(seed, nodes=8, weights=3)
    found = {r.h3_cell: r.betweenness for r in betweenness(edge_frame(spark, edges), batches=seed - 2).collect()}
    assert found == pytest.approx(brute_betweenness(edges))


def test_betweenness_of_equal_and_inverse_lengths(spark):
    diamond = {("s", "a"): 2, ("s", "b"): 2, ("a", "t"): 2, ("b", "t"): 2, ("s", "t"): 9}
    found = {r.h3_cell: r.betweenness for r in betweenness(edge_frame(spark, diamond)).collect()}
    assert found == {"s": 0.0, "a": 0.5, "b": 0.5, "t": 0.0}
    found = {r.h3_cell: r.betweenness for r in betweenness(edge_frame(spark, diamond), "inverse").collect()}
    assert set(found.values()) == {0.0}
    with pytest.raises(ValueError):
        betweenness(edge_frame(spark, diamond), "metres")


def test_empty_graph(spark):
    none = spark.createDataFrame([], EDGE)
    assert pagerank(none).collect() == [] == betweenness(none).collect() == detect_communities(none).collect()
    assert node_metrics(none).collect() == []
    assert graph.graph_size(none).first().density is None


def test_node_metrics(spark):
    edges = random_edges(6, nodes=7)
    rows = node_metrics(edge_frame(spark, edges)).collect()
    assert sorted(r.rank for r in rows) == list(range(1, len(rows) + 1))
    assert [r.rank for r in sorted(rows, key=lambda r: (-r.total_flow, r.h3_cell))] == list(range(1, len(rows) + 1))
    assert max(r.betweenness_norm for r in rows) == 1.0


def brute_modularity(edges, label):
    weight = defaultdict(float)
    for (a, b), w in edges.items():
        weight[frozenset((a, b))] += w
    total = sum(weight.values())
    degree = defaultdict(float)
    for pair, w in weight.items():
        for node in pair:
            degree[node] += w
    inside = sum(w for pair, w in weight.items() if len({label[n] for n in pair}) == 1)
    groups = defaultdict(float)
    for node, d in degree.items():
        groups[label[node]] += d
    return inside / total - sum(d * d for d in groups.values()) / (4 * total * total)


def test_two_cliques_are_found(spark):
    edges = {}
    for side in "ab":
        for x, y in itertools.permutations(range(5), 2):
            edges[(f"{side}{x}", f"{side}{y}")] = 10
    edges[("a0", "b0")] = 1
    edges[("c0", "c1")] = 5
    frame = edge_frame(spark, edges)
    found = detect_communities(frame)
    label = {r.h3_cell: r.community for r in found.collect()}
    assert [len({label[f"{side}{x}"] for x in range(5)}) for side in "ab"] == [1, 1]
    assert label["a0"] == 0 and label["b0"] == 1 and label["c0"] == label["c1"] == 2
    assert {r.community: r.community_size for r in found.collect()} == {0: 5, 1: 5, 2: 2}
    assert modularity(frame, found).first().modularity == pytest.approx(brute_modularity(edges, label))


def test_communities_beat_the_trivial_partition_and_are_connected(spark):
    edges = random_edges(9, nodes=14, density=0.18, weights=9)
    frame = edge_frame(spark, edges)
    label = {r.h3_cell: r.community for r in detect_communities(frame).collect()}
    assert brute_modularity(edges, label) > max(0.0, brute_modularity(edges, dict.fromkeys(label, 0)))
    for community in set(label.values()):
        members = {n for n, c in label.items() if c == community}
        seen, open_nodes = set(), [min(members)]
        while open_nodes:
            node = open_nodes.pop()
            seen.add(node)
            open_nodes += [b for a, b in [*edges, *[(b, a) for a, b in edges]] if a == node and b in members - seen]
        assert seen == members


def test_parts_of_a_split_community(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0), ("b", "x", 1.0), ("c", "x", 1.0)], "a string, b string, w double")
    members = spark.createDataFrame([(n, "one") for n in "abcd"] + [("x", "two")], "node string, community string")
    found = {r.node: r.community for r in connected_parts(pairs, members).collect()}
    assert found == {"a": "a", "b": "a", "c": "c", "d": "c", "x": "x"}


def planted(nodes=60, groups=4, seed=3):
    """Cells in groups that trade mostly among themselves."""
    rng = random.Random(seed)
    rows = []
    for a in range(nodes):
        for b in range(nodes):
            inside = a % groups == b % groups
            if a != b and rng.random() < (0.35 if inside else 0.06):
                rows.append((f"n{a:02d}", f"n{b:02d}", rng.randint(5, 40 if inside else 15)))
    return rows


def test_no_single_move_is_left_and_modularity_never_falls(spark):
    edges = spark.createDataFrame(planted(), "pickup_h3 string, dropoff_h3 string, weight bigint").cache()
    reached = []
    for passes in (1, 2, 10):
        found = detect_communities(edges, passes).cache()
        reached.append(modularity(edges, found).first()["modularity"])
    assert reached == sorted(reached)
    faults = partition_faults(edges, found).first().asDict()
    assert faults == {"nodes": 60, "misnumbered": 0, "unlabelled": 0, "gaining": 0, "split": 0}


def test_faults_are_seen(spark):
    edges = spark.createDataFrame(planted(12, 2), "pickup_h3 string, dropoff_h3 string, weight bigint")
    alone = spark.createDataFrame([(f"n{i:02d}", 11 - i, 1) for i in range(11)], "h3_cell string, community int, community_size int")
    faults = partition_faults(edges, alone).first()
    assert faults.unlabelled == 1 and faults.misnumbered > 0 and faults.gaining > 0


def heavy(spark, rows):
    return spark.createDataFrame(rows, "pickup_h3 string, dropoff_h3 string, weight bigint")


def test_betweenness_tells_long_lengths_apart(spark):
    near, far = 10**9, 10**9 + 1
    edges = heavy(spark, [("s", "a", near), ("a", "t", near), ("s", "b", near), ("b", "t", far)])
    scores = {r.h3_cell: r.betweenness for r in betweenness(edges).collect()}
    assert scores == {"a": 1.0, "b": 0.0, "s": 0.0, "t": 0.0}


@pytest.mark.parametrize("length", ["weight", "inverse"])
def test_betweenness_ends_on_short_cycles_far_away(spark, length):
    far, short = (2 * 10**10, 5) if length == "weight" else (1, 10**11)
    edges = heavy(spark, [("s", "u", far), ("s", "v", far), ("u", "v", short), ("v", "u", short), ("u", "t", far)])
    scores = {r.h3_cell: r.betweenness for r in betweenness(edges, length).collect()}
    assert scores["s"] == 0 and scores["u"] >= 1
