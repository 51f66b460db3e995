import numpy as np
from pyspark.sql import functions as F

from urbanweave.operators.ordering import exact_quantiles, with_position, with_running_total
from urbanweave.operators.profile import describe_columns


def test_positions_with_many_equal_values(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id) AS v").repartition(8)
    found = with_position(rows, [F.col("v").desc(), F.col("id")], "place").collect()
    expected = sorted(found, key=lambda r: (-r.v, r.id))
    assert [r.place for r in expected] == list(range(1, 3001))


def test_positions_of_nothing(spark):
    assert with_position(spark.range(0), [F.col("id")]).collect() == []


def test_running_totals(spark):
    rows = spark.range(1000).selectExpr("id", "id % 5 AS n").repartition(8)
    found = sorted(with_running_total(rows, ["id"], "n", "seen").collect(), key=lambda r: r.id)
    total = 0
    for row in found:
        assert row.seen == total
        total += row.n


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=501), "b": np.where(rng.random(1000) < 0.4, 3.0, rng.random(1000)), "c": np.array([5.0])}
    rows = [(k, float(v)) for k, values in data.items() for v in values] + [("a", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(8)
    found = {r.k: r for r in exact_quantiles(frame, "k", "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}).collect()}
    for key, values in data.items():
        expected = np.quantile(values, [0.25, 0.5, 0.9])
        np.testing.assert_allclose([found[key].q1, found[key].q2, found[key].q9], expected, rtol=1e-12)


def test_describe(spark):
    rows = spark.createDataFrame([(1.0, "5"), (2.0, "x"), (4.0, None)], "a double, b string")
    found = {r.column: r for r in describe_columns(rows, ["a", "b"]).collect()}
    assert found["a"]["count"] == 3 and found["a"].p50 == 2.0 and found["a"].p75 == 3.0
    assert found["b"]["count"] == 1 and found["b"]["std"] is None and found["b"]["max"] == 5.0
