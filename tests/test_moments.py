"""Moment buckets against plain statistics of each slice."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import moments
from tidegauge.plans import registry

STATS = ["rows", "count", "mean", "var", "std", "min", "max", "range", "first", "last", "delta", "valid_ratio", "slope", "cv"]


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    ok = [(t, v) for t, v in rows if v is not None]
    v = [x for _, x in ok]
    mean = sum(v) / len(v)
    tm = sum(t for t, _ in ok) / len(ok) / 6e7
    t2 = sum((t / 6e7 - tm) ** 2 for t, _ in ok)
    std = statistics.pstdev(v)
    return {
        "rows": len(rows), "count": len(v), "mean": mean, "var": std * std, "std": std, "min": min(v), "max": max(v), "range": max(v) - min(v), "first": v[0], "last": v[-1],
        "delta": v[-1] - v[0], "valid_ratio": len(v) / len(rows), "slope": sum((t / 6e7 - tm) * (x - mean) for t, x in ok) / t2 if len(v) > 1 and t2 > 0 else None, "cv": std / abs(mean) if mean else None,
    }


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-8))


@pytest.mark.parametrize("width, seed", [(100, 1), (1000, 2), (7, 3), (16 * 8 * 8 * 5, 4)])
def test_every_statistic_of_every_slice(spark, width, seed):
    """Three sensors, null values, repeated times, slices at and across the edges of steps of several levels."""
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), rng.randrange(0, 6000), rng.choice([None, rng.gauss(1e6, 1), float(rng.randrange(5))])) for _ in range(700)]
    stream = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "sensor string, t long, value double, event_id long")
    times = [rng.randrange(-50, 6500) for _ in range(60)] + [0, 96, 960, 5999]
    samples = spark.createDataFrame(list(enumerate(times)), "sample_id long, t long")
    got = {(r["sample_id"], r["sensor"]): r for r in moments.encode(samples, stream, width, ["sample_id"], STATS, per=["sensor"]).collect()}
    n = 0
    for i, t in enumerate(times):
        for sensor in "abc":
            inside = [(at, v) for s, at, v in rows if s == sensor and t - width <= at <= t]
            if any(v is not None for _, v in inside):
                n += 1
                want, own = plain(inside), got[i, sensor]
                assert all(close(own[c], want[c]) for c in STATS), (i, sensor, [(c, own[c], want[c]) for c in STATS if not close(own[c], want[c])])
    assert len(got) == n > 20


def test_medians_by_the_interval_that_holds_the_rank(spark):
    rng = random.Random(5)
    rows = [("ab"[i % 2], rng.randrange(0, 3000), None if i % 11 == 0 else float(rng.randrange(40)) ** 2) for i in range(900)]
    stream = spark.createDataFrame(rows, "sensor string, t long, value double")
    asks = spark.createDataFrame([(k, k * 70 - 20, k * 70 + rng.randrange(400)) for k in range(40)], "k long, lo long, hi long")
    for cuts in (moments.value_cuts(stream), [], [10.0], [100.0, 100.5]):
        b = moments.Buckets(stream, [], ["sensor"], 16, 400, cuts or [-1.0])
        found = moments.slice_medians(asks, moments.slice_moments(asks, b, ["k"]), b, ["k"]).collect()
        got = {(r["k"], r["sensor"]): r["median"] for r in found}
        want = {}
        for a in asks.collect():
            for s in "ab":
                v = [x for q, t, x in rows if q == s and a["lo"] <= t <= a["hi"] and x is not None]
                if v:
                    want[a["k"], s] = statistics.median(v)
        assert got == want and len(got) == len(found)


def test_spread_of_large_values(spark):
    """Values of a billion that differ by thousandths: no large sums are subtracted."""
    rows = [(i * 10, 1e9 + (i % 7) / 1000) for i in range(5000)]
    stream = spark.createDataFrame(rows, "t long, value double")
    sample = spark.createDataFrame([(1, 49_000)], "sample_id long, t long")
    own = moments.encode(sample, stream, 45_000, ["sample_id"], ["std"]).first()["std"]
    assert own == pytest.approx(statistics.pstdev([v - 1e9 for t, v in rows if 4000 <= t <= 49_000]), rel=1e-3)


def test_empty_and_keyed(spark):
    stream = spark.createDataFrame([("u", 5, 1.0), ("v", 6, 2.0), (None, 7, 3.0)], "unit string, t long, value double")
    samples = spark.createDataFrame([(1, "u", 10), (2, "v", 10), (3, "w", 10), (4, "u", None)], "sample_id long, unit string, t long")
    got = moments.encode(samples, stream, 8, ["sample_id"], ["mean"], by=["unit"])
    assert {(r["sample_id"], r["mean"]) for r in got.collect()} == {(1, 1.0), (2, 2.0)}
    assert moments.encode(samples.limit(0), stream, 8, ["sample_id"], ["mean"]).collect() == []
    assert moments.encode(samples, stream.limit(0), 8, ["sample_id"], ["mean"]).collect() == []


def test_rows_are_not_copied_to_every_slice(spark):
    """A dense stream under many overlapping slices: the joins give far fewer rows than the slices hold."""
    stream = spark.range(4000).select((F.col("id") * 10).alias("t"), F.col("id").cast("double").alias("value"))
    samples = spark.range(400).select(F.col("id").alias("sample_id"), (F.col("id") * 50 + 15_000).alias("t"))
    b = moments.Buckets(stream, [], [], 800, 12_800)
    asks = samples.select("sample_id", (F.col("t") - 12_800).alias("lo"), F.col("t").alias("hi"))
    whole = asks.select("sample_id", F.inline(b.cover())).count()
    edges = asks.select(F.explode(b.edges())).count() * 80
    assert whole + edges < 0.2 * 400 * 1280
    assert moments.encode(samples, stream, 12_800, ["sample_id"], ["count"]).agg(F.sum("count")).first()[0] == sum(
        sum(1 for i in range(4000) if a * 50 + 2200 <= i * 10 <= a * 50 + 15_000) for a in range(400)
    )


def test_no_nested_loop(spark):
    for name in ("slice_features_60m", "window_lag_grid"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
