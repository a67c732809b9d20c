"""Exact quantiles, ranks and running totals against sorted lists, with ranges forced on small data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import aggregates, metrics, selection, slices


def data(n=900, seed=1):
    """A hot value that holds a third of all rows, heavy tails, ties, nulls, infinities; a null key and one of nulls alone."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["a", "a", "a", "b", None])
        v = rng.choice([7.0, rng.gauss(0, 1), rng.gauss(0, 1), 10.0 ** rng.randrange(-200, 200), float(rng.randrange(5)), None])
        rows.append((key, v))
    return [*rows, ("c", None), ("d", 3.5), ("b", math.inf), ("b", -math.inf)]


def interpolated(values, p):
    v = sorted(values)
    at = (len(v) - 1) * p
    a, b = v[math.floor(at)], v[math.ceil(at)]
    return a if a == b else (1 - (at - math.floor(at))) * a + (at - math.floor(at)) * b


@pytest.mark.parametrize("finish, ranges", [(10**6, 1024), (40, 1024), (3, 8), (1, 3)])
@pytest.mark.parametrize("by", [["k"], []])
def test_quantiles(spark, monkeypatch, finish, ranges, by):
    monkeypatch.setattr(selection, "RANGES", ranges)
    rows = data()
    probs = [0.0, 0.1, 0.5, 0.9, 0.95, 1.0]
    names = [f"q{i}" for i in range(6)]
    got = selection.exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), by, "v", probs, names, finish).collect()
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k if by else 0, []).append(v)
    assert len(got) == len(groups)
    for r in got:
        own = groups[r["k"] if by else 0]
        assert [r[c] for c in names] == pytest.approx([interpolated(own, p) for p in probs], rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    assert selection.exact_quantiles(df, ["k"], "v", [0.5], ["m"]).collect() == []
    assert selection.exact_quantiles(df.limit(0), [], "v", [0.5], ["m"]).collect() == []
    nan = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 2.0)], "k string, v double")
    assert selection.exact_quantiles(nan, ["k"], "v", [0.5], ["m"]).first()["m"] == 2.0


def test_range_of_counts_cuts(spark):
    rng = random.Random(4)
    for n in (0, 1, 2, 5, 16, 17, 100):
        cuts = sorted({rng.gauss(0, 1) for _ in range(n)})
        values = [*cuts[::3], *(rng.gauss(0, 1) for _ in range(20)), math.inf, -math.inf, math.nan]
        df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", selection.range_of(F.col("v"), cuts))
        for r in df.collect():
            assert r["b"] == (len(cuts) if math.isnan(r["v"]) else sum(c < r["v"] for c in cuts))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("size", [10**6, 20])
def test_running_totals(spark, descending, size):
    rng = random.Random(2)
    rows = [(g, float(v), rng.randrange(1, 9)) for g in ("a", "b", None) for v in {round(rng.gauss(0, 3), 2) for _ in range(90)}]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = selection.running_totals(df, ["g"], "v", ["n"], descending, size).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [(v, n) for g, v, n in rows if g == r["g"]]
        assert r["n_before"] == sum(n for v, n in own if (v > r["v"] if descending else v < r["v"])) and r["n_all"] == sum(n for _, n in own)


def test_ranks_and_conformal_quantiles_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(selection, "RANGE_VALUES", 10)
    monkeypatch.setattr(selection, "FINISH_ROWS", 10)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=400), 1)
    df = spark.createDataFrame([(i, "ab"[i % 2], float(x)) for i, x in enumerate(v)], "i long, g string, v double")
    ranks = {r["i"]: r["r"] for r in aggregates.average_rank(df, ["g"], "v", "r").collect()}
    for i in range(0, 400, 7):
        own = v[i % 2 :: 2]
        assert ranks[i] == (own < v[i]).sum() + ((own == v[i]).sum() + 1) / 2
    for r in metrics.conformal_quantile(df, "v", 0.1, ["g"]).collect():
        own = np.sort(v["ab".index(r["g"]) :: 2])
        assert (r["qhat"], r["n"]) == (own[min(math.ceil(201 * 0.9), 200) - 1], 200)
    assert metrics.conformal_quantile(df, "v", 0.1, ["g"], min_rows=500).collect() == []


def test_no_percentile_state_in_the_plans(spark):
    """Nothing buffers the values of a group."""
    df = spark.createDataFrame(data(), "k string, v double")
    frames = [
        aggregates.range_summary(df, ["k"], "v"),
        aggregates.robust_reference(df, "k", "v"),
        aggregates.accuracy_summary(df.withColumn("c", F.lit(True)), ["k"], "v", "c"),
        aggregates.drift_flags(df.select("k", F.col("v").alias("shift")), F.col("k") == "a", "k"),
        slices.binned_information(df.withColumn("y", F.col("v") > 1), "k", "v", "y"),
    ]
    for f in frames:
        assert "percentile" not in f._jdf.queryExecution().executedPlan().toString()


def test_drift_without_calibration_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "period int, shift double")
    assert [(r["p90"], r["confidence"]) for r in aggregates.drift_flags(df, F.lit(False), "period").collect()] == [(None, "high")] * 2
