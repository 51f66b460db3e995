"""Monthly states against the trips: equal, replaced by month, and read instead of the trips."""

import pytest
from pyspark.sql import functions as F

from checks.compare import difference, open_tables
from checks.sql_oracles import oracles
from urbanweave.operators import cube, flow
from urbanweave.plans.cube_queries import CUBE_QUERIES, cube_root

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return open_tables(SF)


@pytest.mark.parametrize("name", CUBE_QUERIES)
def test_states_give_the_rows_of_the_trips(spark, tables, name):
    assert difference(CUBE_QUERIES[name](spark, SF), tables, oracles()[f"cube_{name}"]) is None


@pytest.mark.parametrize("name", CUBE_QUERIES)
def test_only_states_are_read(spark, name):
    files = CUBE_QUERIES[name](spark, SF).inputFiles()
    assert files and all("/cube-" in path for path in files)


_COLUMNS = "trip_start_timestamp timestamp_ntz, neighborhood string, pickup_h3 string, hour int, day_of_week int, is_weekend int, is_rush_hour int, season string, total_amount double, trip_miles double, trip_seconds double, speed_mph double, tip_percentage double"


def made(spark, months, amount):
    rows = [
        f"({when}, {hood}, {cell}, {i % 3}, {i % 2}, {i % 2}, {i % 2}, {season}, {amount + i}D, {i}D, {60 * i}D, NULL, {i}D)"
        for when in months
        for i, (hood, cell, season) in enumerate([("'Loop'", "'a'", "'Winter'"), ("'Loop'", "'b'", "'Winter'"), ("NULL", "'a'", "NULL"), ("'Loop'", "NULL", "'Summer'")])
    ]
    names = ", ".join(c.split()[0] for c in _COLUMNS.split(", "))
    made = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({names})")
    return made.select(*[F.col(n).cast(t).alias(n) for n, t in (c.split() for c in _COLUMNS.split(", "))])


def stamps(*months):
    return [f"timestamp_ntz'{m}-05 10:00:00'" if m else "NULL" for m in months]


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_month_landed_again_replaces_its_states(spark, tmp_path):
    root = str(tmp_path / "cube")
    old = made(spark, stamps("2024-01", "2024-02", ""), -1.0)
    new = made(spark, stamps("2024-02"), 50.0)
    cube.refresh(old, root)
    for _ in range(2):  # a repeated run changes nothing
        cube.refresh(new, root)
    ts = F.col("trip_start_timestamp")
    now = old.where(ts.isNull() | (F.month(ts) != 2)).unionByName(new)
    time, place = (cube.read_states(spark, root, name) for name in ("time", "place"))
    assert rows(cube.summary(place)) == rows(flow.summary(now))
    assert rows(cube.neighborhoods(time)) == rows(flow.neighborhoods(now))
    assert rows(cube.priciest_neighborhoods(time)) == rows(flow.priciest_neighborhoods(now))
    assert rows(cube.rush_flow(time)) == rows(flow.rush_flow(now))
    assert rows(cube.breakdowns_of_top_origins(place, 1)) == rows(flow.temporal_breakdowns(flow.from_top_origins(now, 1)))
    january = old.where(F.month(ts) == 1)
    assert rows(cube.hourly_flow(cube.read_states(spark, root, "time", 2024, 1))) == rows(flow.hourly_flow(january))
    cube.drop_months(spark, root, [(2024, 2)])
    left = old.where(ts.isNull() | (F.month(ts) != 2))
    assert rows(cube.summary(cube.read_states(spark, root, "place"))) == rows(flow.summary(left))


def test_no_trips(spark, tmp_path):
    root = str(tmp_path / "cube")
    cube.refresh(made(spark, stamps("2024-01"), 1.0), root)
    none = cube.read_states(spark, root, "place", 1999)
    assert rows(cube.summary(none)) == rows(flow.summary(made(spark, stamps("2024-01"), 1.0).limit(0)))
    assert cube.neighborhood_general(cube.read_states(spark, root, "time"), "nowhere").count() == 0
