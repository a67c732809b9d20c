"""Operators whose work per row must not grow with the rows of a window: results by brute force, and the plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import runs, series


def rows(spark, n=300):
    draw = random.Random(3)
    made = [(i, draw.choice("ab"), draw.randrange(400), draw.choice([None, 1.0, 5.0, 80.0])) for i in range(n)]
    return spark.createDataFrame(made, "event_id long, sensor string, t long, value double"), made


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("width", [7, 90, 1_000])
def test_segment_ewma(spark, width):
    df, made = rows(spark)
    got = series.segment_ewma(df, ["sensor"], 0.25, width)
    assert not re.search(r"FlatMapGroups\w+ \[[^\]]*segment", plan(got))  # a run is no group
    want, state, key = {}, None, None
    for i, k, _, v in sorted(made, key=lambda r: (r[1], r[2], r[0])):
        state = None if v is None else v if state is None or k != key else 0.25 * v + 0.75 * state
        key = k
        if v is not None:
            want[i] = round(state, 9)
    assert {r["event_id"]: round(r["ewma"], 9) for r in got.collect()} == want


def test_merged_segments(spark):
    draw, at, made = random.Random(4), 1, []
    for _ in range(400):
        at += draw.randrange(1, 5)
        n = draw.randrange(1, 4)
        made.append((draw.choice("ab"), at, at + n - 1, n))
        at += n
    got = series.merge_segments(spark.createDataFrame(made, "sensor string, first_row int, last_row int, points long").repartition(3), ["sensor"], 9, 2)
    assert "collect_list" not in plan(got)  # no list of a key's segments, copied at every step
    want = []
    for k in "ab":
        kept = []
        for _, a, b, n in (r for r in made if r[0] == k):
            gap = a - kept[-1][2] - 1 if kept else 99
            if gap <= 9 and kept[-1][3] >= 2 and n >= 2:
                kept[-1] = (k, kept[-1][1], b, kept[-1][3] + gap + n)
            else:
                kept.append((k, a, b, n))
        want += kept
    assert sorted(map(tuple, got.collect())) == want


def test_future_flag(spark):
    df, made = rows(spark)
    df = df.withColumn("t", F.when(F.col("event_id") % 50 > 0, F.col("t")))
    made = [(i, k, t if i % 50 else None, v) for i, k, t, v in made]
    got = series.future_flag(df, ["sensor"], 30, F.col("value") > 60)
    assert not re.search(r"RangeFrame, -?\d", plan(got))  # no frame that is read anew for every row
    inside = lambda t, u: u is None if t is None else u is not None and t < u <= t + 30
    want = {i: max((int(v > 60) for _, q, u, v in made if q == k and v is not None and inside(t, u)), default=None) for i, k, t, _ in made}
    found = got.collect()
    assert len(found) == len(made) and {r["event_id"]: r["future"] for r in found} == want


def test_prewarn_lead(spark):
    df, made = rows(spark)
    df = df.withColumns({"bad": F.coalesce(F.col("value") > 60, F.lit(False)), "w": F.col("event_id") % 10 < 2})
    got = runs.prewarn_lead(df, ["sensor"], "bad", "w", 1_000, 9)
    assert not re.search(r"RangeFrame, -?\d", plan(got))
    want = []
    for k in "ab":
        before = None
        for i, q, t, v in sorted((r for r in made if r[1] == k), key=lambda r: (r[2], r[0])):
            bad = v == 80.0
            if bad and not before:
                first = min((u for j, p, u, _ in made if p == k and j % 10 < 2 and t - 9 <= u < t), default=None)
                want.append((k, i % 10 < 2, None if first is None else (t - first) / 60e6))
            before = bad
    found = [(r["sensor"], r["start_hit"], r["lead_minutes"]) for r in got.orderBy("sensor", "segment").collect()]
    assert found == want and any(x[2] for x in want)


def test_warned_before(spark):
    df, made = rows(spark)
    df = df.withColumns({"bad": F.coalesce(F.col("value") > 60, F.lit(False)), "state": (F.col("event_id") % 10 < 2).cast("int")})
    got = runs.evaluate_states(df, ["sensor"], "bad", "state", 1_000, 9)
    assert not re.search(r"RangeFrame, -\d", plan(got).replace("unboundedpreceding$(), -1", ""))
    starts = []
    for k in "ab":
        before = None
        for _, _, t, v in sorted((r for r in made if r[1] == k), key=lambda r: (r[2], r[0])):
            if v == 80.0 and not before:
                starts.append(any(p == k and j % 10 < 2 and t - 9 <= u < t for j, p, u, _ in made))
            before = v == 80.0
    assert got.first()["prewarned"] == sum(starts) / len(starts)
