"""The exact index against brute force, and local boosting against values that follow from its definition."""

import numpy as np
import pytest

from tidegauge.operators import cells, huber, online, retrieval
from tidegauge.plans import registry

SF = "/root/testdata/sf0.001"


def frame(spark, n=700, seed=1, hot=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[n // 2 : n // 2 + n // 8] = x[: n // 8]  # ties
    if hot:
        x[:hot] = 0.5
    t = rng.integers(0, 1000, n)
    rows = [(i, int(t[i]), float(i % 7), x[i].tolist()) for i in range(n)]
    return x, t, spark.createDataFrame(rows, "id long, t long, y double, z array<double>")


def brute(kind, x, t, i, k, delay):
    d = cells.DISTANCES[kind](x, x[i])
    known = sorted((d[j], j) for j in range(len(x)) if j != i and (delay is None or t[j] <= t[i] - delay))
    return [(rank, j, dist) for rank, (dist, j) in enumerate(known[:k], 1)]


@pytest.mark.parametrize("kind", ["euclidean", "median"])
@pytest.mark.parametrize("delay", [None, 100])
def test_nearest_is_exact(spark, kind, delay):
    x, t, df = frame(spark)
    index = cells.build_index(df, kind, 40)
    assert index.slices.n.sum() == len(x) and index.slices.n.max() <= 40
    found = {}
    for r in cells.nearest(df.where("id % 3 = 0"), index, 6, delay).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["case_id"], r["distance"]))
        assert (r["t"], r["y"]) == (t[r["case_id"]], r["case_id"] % 7)
    for i in range(0, len(x), 3):
        assert sorted(found.get(i, [])) == brute(kind, x, t, i, 6, delay)


def test_a_hot_cell_is_cut_into_slices(spark, monkeypatch):
    """A third of all cases are one vector; queries in several parts."""
    monkeypatch.setattr(cells, "PART_QUERIES", 50)
    x, t, df = frame(spark, 600, 3, hot=200)
    index = cells.build_index(df, "euclidean", 30)
    assert index.slices.n.max() <= 30
    found = {}
    for r in cells.nearest(df.where("id % 4 = 0"), index, 5).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["case_id"], r["distance"]))
    assert all(sorted(found[i]) == brute("euclidean", x, t, i, 5, None) for i in range(0, 600, 4))


def test_far_slices_are_passed_over(spark):
    """Ten distant groups: the second round visits next to nothing outside a query's own group."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) + 100 * (i % 10)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, z array<double>")
    slices = cells.build_index(df, "euclidean", 50).slices
    for i in (0, 13, 777):
        bounds, first = slices.first(np.array(rows[i][1]), 0, 5)
        assert first.sum() <= 3 and (bounds <= 5).sum() < 0.25 * len(bounds)
    flat = cells.build_index(df, "median", 50).slices
    assert (flat.bounds(np.array(rows[0][1])) <= 5).sum() < 0.25 * len(flat.n)


def test_edges_of_the_index(spark):
    x, t, df = frame(spark, 50)
    odd = spark.createDataFrame([(900, 0, 1.0, None), (901, 0, 1.0, []), (902, 0, 1.0, [1.0, float("nan"), 0.0, 0.0]), (903, None, 1.0, [0.0] * 4)], df.schema)
    index = cells.build_index(df.unionByName(odd), "euclidean")
    got = cells.nearest(odd, index, 60, 0).collect()
    assert got == []  # no vector, or no time
    assert {r["query_id"] for r in cells.nearest(odd, index, 60).collect()} == {903}
    assert 903 not in {r["case_id"] for r in cells.nearest(df.where("id = 1"), index, 60, 0).collect()}
    assert len(cells.nearest(df.where("id = 1"), index, 60).collect()) == 50  # fewer cases than k
    empty = cells.build_index(df.limit(0), "median")
    assert cells.nearest(df, empty, 3).collect() == [] and cells.nearest(df.limit(0), index, 3).collect() == []


@pytest.mark.parametrize("name", ["knn_context", "delayed_neighbour_estimates"])
def test_no_nested_loops(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_recommendation_neighbours_keep_their_shape(spark):
    _, _, df = frame(spark, 60)
    assert retrieval.neighbours(df, df, 3).columns == ["query_id", "case_id", "distance", "rank"]


def test_weighted_quantile():
    v, w = np.array([3.0, 1.0, 2.0]), np.array([1.0, 1.0, 2.0])
    assert [huber.weighted_quantile(v, w, q) for q in (0.1, 0.5, 0.9, 1.0)] == [1.0, 2.0, 3.0, 3.0]


def test_local_boosting():
    x = np.arange(40.0).reshape(-1, 1)
    y = (x[:, 0] >= 20).astype(float)
    one = np.ones(40)
    low, high = (huber.local_boosting(x, y, one, np.array([q]), trees=200) for q in (5.0, 35.0))
    assert low < 0.05 and high > 0.95
    assert huber.local_boosting(x, np.full(40, 0.3), one, np.array([3.0])) == pytest.approx(0.3)
    # a weight of zero is an absent row; doubled weights change nothing
    w = np.where(x[:, 0] >= 20, 0.0, 1.0)
    assert huber.local_boosting(x, y, w, np.array([35.0])) == pytest.approx(0.0)
    noisy = y + np.sin(x[:, 0])
    assert huber.local_boosting(x, noisy, one, np.array([7.0])) == pytest.approx(huber.local_boosting(x, noisy, 2 * one, np.array([7.0])))
    # one stage by hand: the median is 0 (the lower of two), the cut splits at 20, its leaves step by a twentieth of their residual
    assert huber.local_boosting(x, y, one, np.array([35.0]), trees=1) == pytest.approx(0.05)


def test_local_models_of_delayed_neighbours(spark):
    from pyspark.sql import functions as F

    day = 86_400_000_000
    df = spark.range(300).select("id", (F.col("id") * day).alias("t"), (F.col("id") % 10 / 10.0).alias("a"), (F.col("id") % 10 >= 5).cast("double").alias("y"), F.when(F.col("id") < 150, "old").otherwise("new").alias("month"))
    args = (df.where("id >= 290"), df, ["a"], 60, day, 100.0, 20, F.lit(0.25))
    got = {r["id"]: r for r in online.delayed_neighbours(*args, model_weight=0.6).collect()}
    assert all(abs(r["local_model"] - (i % 10 >= 5)) < 0.2 and r["local_blend"] == pytest.approx(0.6 * r["local_model"] + 0.4 * r["local_mean"]) for i, r in got.items())
    assert {r["route"] for r in online.delayed_neighbours(*args, blocked=["old", "new"]).collect()} == {"static"}
    assert {r["neighbours"] for r in online.delayed_neighbours(*args[:3], 200, *args[4:], blocked=["old"]).collect()} <= set(range(139, 151))
