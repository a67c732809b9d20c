"""Ties: what decides where values, times or sums are equal."""

from pyspark.sql import functions as F

from tidegauge.functions import decide
from tidegauge.operators import aggregates, asof

M = 60_000_000


def test_rows_at_the_same_time_go_by_their_order(spark):
    right = spark.createDataFrame([(5 * M, 1, 9.0), (5 * M, 2, 1.0), (9 * M, 3, 2.0), (9 * M, 4, 1.0)], "t long, event_id long, v double")
    left = spark.createDataFrame([(1, 6 * M), (2, 8 * M)], "sample_id long, t long")
    snap = asof.lagged_snapshots(left, right, ["v"], [0], 10, order=["event_id"])
    assert {r["sample_id"]: r["v__lag0"] for r in snap.collect()} == {1: 1.0, 2: 1.0}
    near = asof.asof_join(left, right, ["v"], 2 * M, direction="nearest", order=["event_id"])
    assert {r["sample_id"]: r["v"] for r in near.collect()} == {1: 1.0, 2: 2.0}  # ahead: the first


def test_a_sum_of_one_shifts_no_probability(spark):
    for seed in range(300):
        m = sorted((seed * a % b) / b for a, b in ((37, 101), (53, 103), (71, 107), (91, 109)))
        raw = [b - a for a, b in zip([0.0, *m], [*m, 1.0], strict=True)]
        total = 0.0
        for v in raw:
            total += v
        if total != 1.0 and [v / total for v in raw] != raw:
            break
    got = spark.range(1).select(decide.interval_probabilities([F.lit(x) for x in m]).alias("p")).first()["p"]
    assert total != 1.0 and got == raw
    other = spark.range(1).select(decide.normalised(F.array(F.lit(1.0), F.lit(3.0))).alias("p")).first()["p"]
    assert other == [0.25, 0.75]


def test_equal_sums_of_periods_tie_whatever_their_last_bit(spark):
    rows = spark.createDataFrame([(1, 1, 0.3), (1, 2, 0.1), (1, 2, 0.2), (1, 3, 0.05)], "k long, week long, w double").coalesce(1)
    assert aggregates.weighted_shares(rows, ["k"], "week", "w", 1).first()["shares"] == {1: 1.0}


def test_sums_in_order_of_rows_rank_as_the_sql_has_them(spark, tmp_path):
    """Rows lie in several files and tasks; the SQL adds them as they lie in the table. The third place goes to a last bit or to a tiny sum."""
    import random

    import duckdb

    from tidegauge.plans import registry

    draw, rows, i = random.Random(5), [], 0
    for unit in range(60):
        small = 1e-8 if unit % 2 else 1.0
        parts = [draw.randint(1, 4000) for _ in range(6)]
        for week, cents in ((0, [9000] * 2), (1, [7000] * 3), (2, parts), (3, parts[::2] + [sum(parts[1::2])]), (4, [1])):
            for c in cents:
                rows.append((i, 1704067200 + week * 7 * 86400 + len(rows) % 86400, unit, "view", round(small * c / 100, 12), "{}"))
                i += 1
    made = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    made.selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type", "value", "props").repartition(8).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute("SET timezone = 'UTC'")
    duck.execute("SET threads = 1")
    duck.execute(f"CREATE TABLE events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' ORDER BY event_id")
    names = ["unit", "share_now", "share_before", "share_older"]
    want = sorted(duck.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLE['weighted_share_by_week']})").fetchall())
    got = sorted(tuple(r) for r in registry.QUERIES["weighted_share_by_week"](spark, str(tmp_path)).select(names).collect())
    assert len(got) == 60 and got == want
