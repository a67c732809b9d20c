"""The streaming queries give all rows of their batch forms on an input of several files in no order of time."""

import pytest
from pyspark.sql import functions as F

from tidegauge.operators.runs import NORMAL, next_state
from tidegauge.plans import learning, registry
from tidegauge.streaming import alarms


@pytest.fixture(autouse=True, params=["a batch a file", "one batch"])
def batches(request, spark, monkeypatch):
    if request.param == "one batch":
        yield
        return
    monkeypatch.setattr(learning, "STREAM_BATCH", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet("/root/testdata/sf0.01/events.parquet").repartition(6, F.xxhash64("event_id")).write.parquet(f"{base}/events.parquet")
    return base


def batch(spark, base):
    return registry.read(spark, base, "events").select("event_id", F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("sensor"), "value")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_tumbling_gives_every_window(spark, scattered):
    want = alarms.tumbling_last(batch(spark, scattered), "6 hours", ["sensor"]).select("sensor", F.unix_micros("start").alias("start"), "value")
    assert rows(registry.QUERIES["stream_tumbling_last"](spark, scattered)) == rows(registry.rounded(want))


def test_sessions_hold_every_row(spark, scattered):
    events = batch(spark, scattered)
    want = alarms.sessions(events, "30 minutes", ["sensor"]).select("sensor", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "rows")
    got = rows(registry.QUERIES["stream_sessions"](spark, scattered))
    assert got == rows(want) and sum(r[3] for r in got) == events.count()


def test_hysteresis_follows_time(spark, scattered):
    want, state = {}, {}
    for r in batch(spark, scattered).orderBy("time", "event_id").collect():
        want[r["event_id"]] = state[r["sensor"]] = next_state(state.get(r["sensor"], NORMAL), r["value"], 60.0, 120.0, 0.80, 0.85)
    got = registry.QUERIES["stream_hysteresis"](spark, scattered).collect()
    assert len(got) == len(want) and {r["event_id"]: r["state"] for r in got} == want


@pytest.mark.parametrize("name", ["stream_ordered_hysteresis", "stream_filled_steps", "stream_released_labels"])
def test_streams_in_no_order_match_sql(spark, name):
    """Files of rows in no order of time, each a micro-batch or all in one: the SQL over the whole table."""
    import duckdb
    from test_queries import SF, plain

    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    cursor = c.execute(registry.ORACLE[name])
    columns = [x[0] for x in cursor.description]
    want = sorted((tuple(plain(r[columns.index(x)]) for x in names) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[x]) for x in names) for r in df.collect()), key=repr) == want and want
