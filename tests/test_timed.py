"""Folds and state of the watermark-driven streams, small inputs in several micro-batches."""

import datetime

import pytest

from tidegauge.operators.runs import ALARM, NORMAL, WARNING, next_state
from tidegauge.streaming import timed

S = 1_000_000
AT = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "key string, time timestamp, t long, event_id long, value double, kind int"


def run(spark, tmp_path, batches, make):
    """Each batch is a file, and a micro-batch; seconds as times."""
    for i, rows in enumerate(batches):
        made = [(k, AT + datetime.timedelta(seconds=s), s * S, n, v, kind) for k, s, n, v, kind in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    ordered = sorted((tmp_path / "in").glob("b=*/part-*"), key=lambda p: int(p.parent.name[2:]))
    import os

    for i, p in enumerate(ordered):
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    flow = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/b=*"))
    with timed.rocksdb(spark):
        q = flow.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/ck").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect()), key=repr)


def test_hysteresis_holds_an_alarm_between_the_warning_levels():
    assert next_state(ALARM, 50.0, 60.0, 120.0) == ALARM
    assert next_state(ALARM, 70.0, 60.0, 120.0) == WARNING
    assert next_state(ALARM, 110.0, 60.0, 120.0) == ALARM
    assert next_state(ALARM, 40.0, 60.0, 120.0) == next_state(WARNING, 40.0, 60.0, 120.0) == NORMAL
    assert next_state(WARNING, 50.0, 60.0, 120.0) == WARNING and next_state(NORMAL, 50.0, 60.0, 120.0) == NORMAL
    assert next_state(ALARM, None, 60.0, 120.0) == ALARM


def test_rows_wait_for_the_watermark_and_late_ones_fall(spark, tmp_path):
    batches = [
        [("a", 50, 2, 1.0, 0), ("a", 10, 1, 9.0, 0), ("b", 20, 7, 5.0, 0)],
        [("a", 30, 3, 1.0, 0), (None, 200, 0, None, 0)],  # 30 is in time: the watermark stands at 0
        [("a", 190, 5, 2.0, 0)],  # timers give out all before 140
        [("a", 40, 4, 9.0, 0), (None, 900, 0, None, 0)],  # 40 is late now
    ]
    got = run(spark, tmp_path, batches, lambda s: timed.ordered_hysteresis(s, "key", 4.0, 8.0, 10 * S, "60 seconds"))
    assert got == [("a", 1, 2), ("a", 2, 0), ("a", 3, 0), ("a", 5, 0), ("b", 7, 1)]


def test_empty_steps_are_filled_by_timers(spark, tmp_path):
    batches = [[("a", 5, 1, 1.0, 0), ("a", 7, 2, None, 0)], [("a", 41, 3, 2.0, 0)], [(None, 300, 0, None, 0)], [(None, 310, 0, None, 0)]]
    got = run(spark, tmp_path, batches, lambda s: timed.filled_steps(s, "key", 10 * S, "20 seconds", 2))
    assert got == sorted(
        [("a", 0, 1.0, False), ("a", 10 * S, 1.0, True), ("a", 20 * S, 1.0, True), ("a", 40 * S, 2.0, False), ("a", 50 * S, 2.0, True), ("a", 60 * S, 2.0, True)], key=repr
    )


def test_labels_are_released_late_and_forgotten(spark, tmp_path):
    batches = [
        [("a", 1, 1, 1.0, timed.LABEL), ("a", 5, 2, 9.0, timed.BLOCKED), ("a", 31, 10, None, timed.QUERY)],
        [("a", 20, 3, 3.0, timed.LABEL), ("a", 29, 11, None, timed.QUERY), ("a", 60, 12, None, timed.QUERY)],
        [("a", 100, 13, None, timed.QUERY), ("b", 100, 14, None, timed.QUERY)],
        [(None, 900, 0, None, 0)],
    ]
    got = run(spark, tmp_path, batches, lambda s: timed.released_labels(s, "key", 30 * S, 40 * S, 10 * S, "100 seconds"))
    assert got == sorted([("a", 10, 1, 1.0), ("a", 11, 0, None), ("a", 12, 2, 2.0), ("a", 13, 0, None), ("b", 14, 0, None)], key=repr)


def test_idle_keys_lose_their_state(spark, tmp_path):
    batches = [[("a", 1, 1, 9.0, 0)], [(None, 500, 0, None, 0)], [(None, 510, 0, None, 0)], [("a", 505, 2, 5.0, 0)], [(None, 990, 0, None, 0)]]
    make = lambda idle: lambda s: timed.ordered_hysteresis(s, "key", 4.0, 8.0, 10 * S, "20 seconds", idle=idle)
    (tmp_path / "x").mkdir()
    (tmp_path / "y").mkdir()
    assert run(spark, tmp_path / "x", batches, make(100 * S)) == [("a", 1, 2), ("a", 2, 1)]  # from normal
    assert run(spark, tmp_path / "y", batches, make(5000 * S)) == [("a", 1, 2), ("a", 2, 1)]
    later = [*batches[:3], [("a", 505, 2, 3.5, 0)], batches[4]]
    (tmp_path / "z").mkdir()
    (tmp_path / "w").mkdir()
    assert run(spark, tmp_path / "z", later, make(100 * S))[1] == ("a", 2, 0)  # the alarm is forgotten
    assert run(spark, tmp_path / "w", later, make(5000 * S))[1] == ("a", 2, 2)  # the alarm holds


def test_a_fold_gets_one_piece_at_a_time(spark, tmp_path):
    """All pieces fall due at once; none is gathered with another, and a second micro-batch adds to a piece."""
    batches = [[("a", s, s, 1.0, 0) for s in (1, 2, 11, 12, 13, 35)], [("a", 3, 3, None, 0)], [(None, 900, 0, None, 0)], [(None, 910, 0, None, 0)]]

    def fold(state, rows, upto):
        rows = list(rows)
        return state, [(len(rows), upto)] if rows else [], None

    got = run(spark, tmp_path, batches, lambda s: timed.timed(s, "key", 10 * S, "100 seconds", "n long, upto long", fold))
    assert got == [("a", 1, 40 * S), ("a", 3, 10 * S), ("a", 3, 20 * S)]
