"""Parameter relations: cartesian grids with a validity filter, policy specifications, feature combinations."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def candidates(axes: Mapping[str, Sequence], valid: Callable[[dict], bool] = lambda c: True, default: dict | None = None) -> list[dict]:
    """All valid combinations, the default first (once)."""
    rows = [dict(zip(axes, v, strict=True)) for v in itertools.product(*axes.values())]
    rows = [r for r in rows if valid(r)]
    return [default, *[r for r in rows if r != default]] if default else rows


def grid_frame(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    names = list(rows[0])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], names)


@dataclass(frozen=True)
class Policy:
    name: str
    kind: str  # point, consecutive, k_of_n, ema
    on: float
    k: int = 1
    n: int = 1
    alpha: float = 1.0
    off: float | None = None


def alarm_policies(low: float, mid: float, high: float) -> list[Policy]:
    """Eleven policies from three thresholds: the points, runs of two and three, k of n, and two smoothed ones."""
    out = [Policy(f"point_{n}", "point", t) for n, t in (("low", low), ("mid", mid), ("high", high))]
    out += [Policy(f"run{k}_{n}", "consecutive", t, k=k) for k in (2, 3) for n, t in (("low", low), ("mid", mid))]
    out += [Policy(f"{k}of{m}_mid", "k_of_n", mid, k=k, n=m) for k, m in ((2, 3), (3, 5))]
    return out + [Policy(f"ema_{a}", "ema", mid, alpha=a, off=low) for a in (0.3, 0.5)]


def feature_pairs(features: Sequence[str]) -> list[tuple[str, str]]:
    """Pairs of features with the same statistic (the part behind ``__``)."""
    stat = lambda f: f.split("__", 1)[-1]
    return [(a, b) for a, b in itertools.combinations(features, 2) if stat(a) == stat(b)]


def feature_catalog(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """``feature, sensor, stat, lag, window`` parsed from names."""
    from tidegauge.functions.text import feature_parts

    rows = [(c, p["sensor"], p["stat"], int(p["lag"]) if p["lag"] else None, int(p["window"]) if p["window"] else None) for c in columns for p in [feature_parts(c)]]
    return spark.createDataFrame(rows, "feature string, sensor string, stat string, lag int, window int")


#: Lag (minutes) of a sensor by the stage its tag belongs to, first match.
STAGE_TAGS = {"feed": ("FI", "FEED"), "reactor": ("RX", "TI"), "separator": ("SEP", "LI")}


def stage_of(sensor: str, tags: Mapping[str, Sequence[str]] = STAGE_TAGS) -> str | None:
    return next((s for s, marks in tags.items() if any(m in sensor.upper() for m in marks)), None)


def lag_policy(spark: SparkSession, sensors: Sequence[str], stage_lags: Mapping[str, Sequence[int]], fallback: int, tags=STAGE_TAGS) -> DataFrame:
    """``sensor, stage, lag``: one row per candidate lag of the sensor's stage (one for a single lag)."""
    rows = [(s, stage_of(s, tags), int(m)) for s in sensors for m in stage_lags.get(stage_of(s, tags) or "", [fallback])]
    return spark.createDataFrame(rows, "sensor string, stage string, lag int")
