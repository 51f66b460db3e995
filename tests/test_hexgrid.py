import math

import pytest
from pyspark.sql import functions as F

from urbanweave.functions.hexgrid import add_cells, cell_boundary, cell_centre, cell_distance, point_cell

# Cells of the city's busiest places.
KNOWN_CELLS = """892664c1ecfffff 892664c1a8bffff 892664c1a87ffff 892664c1e2fffff 892664ca913ffff 892664c1acfffff
    892664c1607ffff 892664c1e0fffff 892664c13d3ffff 892664d8973ffff 892664520afffff 89266419157ffff""".split()


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([(c,) for c in KNOWN_CELLS], "cell string")


def test_centre_of_a_known_cell(spark, known):
    at = known.where(F.col("cell") == "892664c1ecfffff").select(cell_centre(F.col("cell")).alias("at")).first()["at"]
    assert at.lat == pytest.approx(41.899983936599895, abs=1e-12)
    assert at.lon == pytest.approx(-87.63237205146329, abs=1e-12)


def test_centres_and_near_points_encode_to_their_cell(known):
    at = known.select("cell", cell_centre(F.col("cell")).alias("at"))
    again = at.select(
        "cell",
        point_cell(F.col("at.lat"), F.col("at.lon")).alias("centre"),
        point_cell(F.col("at.lat") + 0.0008, F.col("at.lon") - 0.0008).alias("near"),
    )
    assert all(r.centre == r.cell == r.near for r in again.collect())


def test_boundary_has_six_corners_around_the_centre(known):
    rows = known.select(cell_boundary(F.col("cell")).alias("corners"), cell_centre(F.col("cell")).alias("at")).collect()
    for row in rows:
        assert len(row.corners) == 6
        turns = []
        for first, second in zip(row.corners, row.corners[1:] + row.corners[:1]):
            shrink = math.cos(math.radians(row["at"].lat))
            ax, ay = (first.lon - row["at"].lon) * shrink, first.lat - row["at"].lat
            bx, by = (second.lon - row["at"].lon) * shrink, second.lat - row["at"].lat
            metres = math.hypot(ax, ay) * 111_195
            assert 150 < metres < 230
            turns.append(ax * by - ay * bx)
        assert all(t > 0 for t in turns)


def test_neighbours_are_one_step_apart(spark, known):
    """Points just across each corner's opposite sides lie one step away."""
    rows = known.select("cell", cell_centre(F.col("cell")).alias("at"), F.explode(cell_boundary(F.col("cell"))).alias("c"))
    beyond = rows.select(
        "cell",
        point_cell(F.col("at.lat") + (F.col("c.lat") - F.col("at.lat")) * 1.2, F.col("at.lon") + (F.col("c.lon") - F.col("at.lon")) * 1.2).alias("other"),
    )
    found = beyond.select("cell", "other", cell_distance(F.col("cell"), F.col("other")).alias("steps"), cell_distance(F.col("other"), F.col("cell")).alias("back"))
    assert all(r.steps == r.back == 1 for r in found.collect())


def test_distance_follows_the_metres(known):
    pairs = known.selectExpr("cell AS a").crossJoin(known.selectExpr("cell AS b"))
    rows = pairs.select(
        cell_distance(F.col("a"), F.col("b")).alias("steps"), "a", "b",
        cell_centre(F.col("a")).alias("p"), cell_centre(F.col("b")).alias("q"),
    ).collect()
    for r in rows:
        if r.a == r.b:
            assert r.steps == 0
            continue
        metres = math.hypot(r.p.lat - r.q.lat, (r.p.lon - r.q.lon) * math.cos(math.radians(41.85))) * 111_195
        assert 250 < metres / r.steps < 370


def test_unknown_input_gives_null(spark):
    points = spark.createDataFrame([(None, -87.6), (41.9, None), (float("nan"), -87.6), (-33.9, 151.2), (0.0, 0.0)], "lat double, lon double")
    assert all(r.cell is None for r in points.select(point_cell(F.col("lat"), F.col("lon")).alias("cell")).collect())
    texts = spark.createDataFrame([("zz",), (None,), ("8928308280fffff",), ("ffffffffffffffff",), ("882664c1edfffff",)], "cell string")
    steps = texts.select(cell_distance(F.col("cell"), F.lit("892664c1ecfffff")).alias("steps"), cell_boundary(F.col("cell")).alias("b"))
    assert all(r.steps is None and r.b is None for r in steps.collect())


def test_trip_cells(spark):
    trips = spark.createDataFrame(
        [(41.9, -87.63, 41.9, -87.63), (41.9, -87.63, 41.97, -87.90), (41.9, -87.63, None, -87.9)],
        "pickup_centroid_latitude double, pickup_centroid_longitude double, dropoff_centroid_latitude double, dropoff_centroid_longitude double",
    )
    same, far, open_end = add_cells(trips).collect()
    assert same.pickup_h3 == same.dropoff_h3 and same.h3_distance == 0.0
    assert far.h3_distance > 50
    assert open_end.pickup_h3 == same.pickup_h3 and open_end.dropoff_h3 is None and open_end.h3_distance is None
