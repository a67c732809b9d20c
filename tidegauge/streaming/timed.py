"""Stateful streams that wait for the watermark: rows in any order of arrival, results in order of time.

A key's rows are held in pieces of time, packed. A timer at the end of the earliest piece fires when the watermark has passed it;
all rows up to there are then final, and a fold takes them piece by piece in order of time from the state that the rows before have
left, so a task holds one piece of one key, or its rows of one micro-batch. What a
fold wants to do without new rows (filling an empty step) it asks a timer for. Rows that come behind what is final are
dropped. A key without rows for ``idle`` loses its state. State is bounded by the delay, the fold's own memory and ``idle``.

These queries need the RocksDB state store (``rocksdb``).
"""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.functions.timeline import DAY
from tidegauge.operators.runs import NORMAL, next_state

#: Rows that a stream must have besides its key: micros, an id that orders equal times, a value, and what the row is.
ROW = "t long, event_id long, value double, kind int"
_COLUMNS = ("t", "event_id", "value", "kind")
_PACKED = np.dtype([("t", "<i8"), ("event_id", "<i8"), ("value", "<f8"), ("kind", "<i4")])
_EVER = 2**62
#: Rows of a result that are handed over at once.
FRAME_ROWS = 50_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: state, rows of a piece in order of time, all time up to here is final -> new state, rows of the result, when to look again
Fold = Callable[[list[float], Iterable[tuple], int], tuple[list[float], list[tuple], int | None]]


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store for streams that start inside; the session's own setting comes back afterwards."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if was is None else spark.conf.set(_PROVIDER, was)


class _Timed(StatefulProcessor):
    def __init__(self, names: Sequence[str], piece: int, idle: int, fold: Fold):
        self.names, self.piece, self.idle, self.fold = list(names), piece, idle, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: a piece's rows of one micro-batch, packed; what was held before is not read for it
        self.held = handle.getMapState("held", "piece long, part long", "rows binary")
        self.known = handle.getValueState("known", "state array<double>, final long, newest long, parts long, next long")

    def _known(self) -> tuple[list[float], int, int, int, int]:
        own = self.known.get() if self.known.exists() else None
        return (list(own[0]), *own[1:5]) if own else ([], -_EVER, -_EVER, 0, _EVER)

    def _timer(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[0] is not None:
            state, final, newest, part, following = self._known()
            fresh = [p[p["t"] >= final] for p in map(_packed, rows)]
            fresh = np.concatenate(fresh) if fresh else np.empty(0, _PACKED)
            if len(fresh):
                piece = fresh["t"] // self.piece
                place = np.argsort(piece, kind="stable")
                fresh, piece = fresh[place], piece[place]
                edges = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(piece)]
                for a, b in zip(edges, edges[1:], strict=False):
                    self.held.updateValue((int(piece[a]), part), (fresh[a:b].tobytes(),))
                newest = max(newest, (int(piece[-1]) + 1) * self.piece)
                first = (int(piece[0]) + 1) * self.piece
                if first < following:  # one timer waits, for the earliest piece held
                    following = first
                    self._timer(first)
                self.known.update((state, final, newest, part + 1, following))
                self._timer(newest + self.idle)
        yield pd.DataFrame(columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000 // self.piece * self.piece
        state, final, newest, parts, _ = self._known()
        frame = lambda out: pd.DataFrame([(key[0], *r) for r in out], columns=self.names)
        out: list[tuple] = []
        if upto > final and (state or newest > -_EVER):
            held = sorted(tuple(k) for k in self.held.keys())  # noqa: SIM118
            ready = [k for k in held if (k[0] + 1) * self.piece <= upto]
            later = [k for k in held if (k[0] + 1) * self.piece > upto]
            for piece, own in itertools.groupby(ready, lambda k: k[0]):  # a piece at a time, so that one alone is in memory
                own = list(own)
                rows = np.concatenate([np.frombuffer(bytes(self.held.getValue(k)[0]), _PACKED) for k in own])
                for k in own:
                    self.held.removeKey(k)
                state, found, _ = self.fold(state, _ordered(rows), (piece + 1) * self.piece)
                out += found
                if len(out) >= FRAME_ROWS:
                    yield frame(out)
                    out = []
            state, found, again = self.fold(state, [], upto)
            out += found
            if newest + self.idle <= upto:
                self.known.clear()
            else:
                following = (later[0][0] + 1) * self.piece if later else _EVER
                self.known.update(([float(x) for x in state], upto, newest, parts, following))
                if later:
                    self._timer(following)
                if again is not None:
                    self._timer(again)
        yield frame(out)


def _packed(frame: pd.DataFrame) -> np.ndarray:
    """A frame's rows with a time, 28 bytes each; a null value is NaN."""
    frame = frame[frame["t"].notna()]
    out = np.empty(len(frame), _PACKED)
    for c in _COLUMNS:
        out[c] = frame[c].to_numpy(_PACKED[c])
    return out


def _ordered(rows: np.ndarray) -> Iterator[tuple]:
    """``t, event_id, value, kind`` in order of time, then id; NaN is None."""
    rows = rows[np.lexsort((rows["event_id"], rows["t"]))]
    for a in range(0, len(rows), FRAME_ROWS):
        for t, i, v, k in rows[a : a + FRAME_ROWS].tolist():
            yield t, i, None if v != v else v, k


def timed(stream: DataFrame, key: str, piece: int, delay: str, out: str, fold: Fold, idle: int = 400 * DAY) -> DataFrame:
    """``key`` and the columns ``out`` of what ``fold`` gives for each key; the stream has ``key, time`` (a timestamp) and ``ROW``. Rows
    may come up to ``delay`` behind the newest; ``piece`` and ``idle`` are micros. Rows without a key move the watermark alone."""
    kind = dict(stream.dtypes)[key]
    names = [key, *[c.split()[0] for c in out.split(", ")]]
    rows = stream.withWatermark("time", delay).select(key, "time", *_COLUMNS)
    return rows.groupBy(key).transformWithStateInPandas(_Timed(names, piece, idle, fold), f"{key} {kind}, {out}", "Append", "EventTime")


def ordered_hysteresis(stream: DataFrame, key: str, warn: float, alarm: float, piece: int, delay: str, warn_release: float = 0.80, alarm_release: float = 0.85, idle: int = 400 * DAY) -> DataFrame:
    """``key, event_id, state``: two-level hysteresis in the order of time, however the rows arrive within ``delay``."""

    def fold(state, rows, upto):
        now, out = int(state[0]) if state else NORMAL, []
        for _, event_id, value, _ in rows:
            now = next_state(now, value, warn, alarm, warn_release, alarm_release)
            out.append((event_id, now))
        return [float(now)], out, None

    return timed(stream, key, piece, delay, "event_id long, state int", fold, idle)


def filled_steps(stream: DataFrame, key: str, step: int, delay: str, limit: int, idle: int = 400 * DAY) -> DataFrame:
    """``key, start, value, filled``: the last valid value of each step (micros) and, for up to ``limit`` empty steps behind it, that
    value again, given out as soon as the watermark has passed the step."""

    def fold(state, rows, upto):
        held = [(int(state[0]), state[1], int(state[2]))] if state else []  # start of the last step given, its value, steps filled
        last, out = held[0] if held else None, []
        steps: dict[int, float] = {}
        for t, _, value, _ in rows:
            if value is not None:
                steps[t // step * step] = value
        for start in [*sorted(steps), upto]:
            while last and last[0] + step < start and last[2] < limit:
                last = (last[0] + step, last[1], last[2] + 1)
                out.append((last[0], last[1], True))
            if start < upto:
                last = (start, steps[start], 0)
                out.append((start, steps[start], False))
        again = last[0] + 2 * step if last and last[2] < limit else None
        return [float(x) for x in last] if last else [], out, again

    return timed(stream, key, step, delay, "start long, value double, filled boolean", fold, idle)


LABEL, QUERY, BLOCKED = 0, 1, 2


def released_labels(stream: DataFrame, key: str, label_delay: int, memory: int, piece: int, delay: str, idle: int = 400 * DAY) -> DataFrame:
    """``key, event_id, library, mean``: for every query row (kind ``QUERY``) the number and the mean of the key's labels (kind ``LABEL``)
    that are known by then: a label of time t is released at t + ``label_delay`` and forgotten ``memory`` later. Labels of kind
    ``BLOCKED`` are never released. State is the labels of the last ``label_delay + memory``."""

    def fold(state, rows, upto):
        times, values = list(state[: len(state) // 2]), list(state[len(state) // 2 :])
        out, first, ready, total = [], 0, 0, 0.0
        for t, event_id, value, kind in rows:
            if kind == LABEL and value is not None:
                times.append(t)
                values.append(value)
            elif kind == QUERY:
                while ready < len(times) and times[ready] <= t - label_delay:
                    total += values[ready]
                    ready += 1
                while first < ready and times[first] <= t - label_delay - memory:
                    total -= values[first]
                    first += 1
                n = ready - first
                if not n:
                    total = 0.0
                out.append((event_id, n, total / n if n else None))
        keep = next((i for i, t in enumerate(times) if t > upto - label_delay - memory), len(times))
        return [*times[keep:], *values[keep:]], out, None

    return timed(stream, key, piece, delay, "event_id long, library long, mean double", fold, idle)
