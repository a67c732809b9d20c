"""Row-ordered cleaning per key: gap filling, outlier filters, smoothing, step features.

Every function takes key columns ``by``; sensors in the long form are keys. Very long series are split by adding a
period (for example the day) to the key where the operator's look-back is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from tidegauge.functions.timeline import DAY, carried_fold, halo

PAST, NOW = Window.unboundedPreceding, Window.currentRow


def _order(by: list[str], order: list[str] | None = None) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*(order or ["t", "event_id"]))


def _next(by: list[str], value: Column) -> Column:
    """The next non-null value at or after a row: a running last over the reversed order (frames that end at the last row
    are recomputed for every row)."""
    w = Window.partitionBy(*by).orderBy(F.col("t").desc(), F.col("event_id").desc()).rowsBetween(PAST, NOW)
    return F.last(value, ignorenulls=True).over(w)


def runs(df: DataFrame, by: list[str], flag: Column, out: str = "run") -> DataFrame:
    """Number of the maximal run of equal ``flag`` that a row belongs to."""
    w = _order(by)
    marked = df.withColumn("_f", flag)
    change = F.coalesce(F.col("_f") != F.lag("_f").over(w), F.lit(True)).cast("int")
    return marked.withColumn("_c", change).withColumn(out, F.sum("_c").over(w)).drop("_f", "_c")


def fill_gaps(df: DataFrame, by: list[str], max_points: int, method: str = "previous") -> DataFrame:
    """Null runs of at most ``max_points`` rows filled: ``previous`` takes the left value, else the right one; ``linear``
    interpolates in time, inside only. Adds ``filled``."""
    w = _order(by)
    rows = runs(df, by, F.col("value").isNull())
    seen = F.when(F.col("value").isNotNull(), F.struct("t", "value"))
    left = F.last(seen, ignorenulls=True).over(w.rowsBetween(PAST, NOW))
    right = _next(by, seen)
    rows = rows.withColumns({"_l": left, "_r": right, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by, "run"))})
    short = F.col("value").isNull() & (F.col("_n") <= max_points)
    share = F.try_divide(F.col("t") - F.col("_l.t"), F.col("_r.t") - F.col("_l.t"))
    linear = F.col("_l.value") + share * (F.col("_r.value") - F.col("_l.value"))
    guess = F.coalesce("_l.value", "_r.value") if method == "previous" else linear
    out = rows.withColumn("_v", F.when(short, guess).otherwise(F.col("value")))
    return out.withColumn("filled", F.col("value").isNull() & F.col("_v").isNotNull()).withColumn("value", F.col("_v")).drop("_l", "_r", "_n", "_v", "run")


def hold_fill(df: DataFrame, by: list[str]) -> DataFrame:
    """Forward, then backward fill."""
    w = _order(by)
    return df.withColumn("value", F.coalesce(F.last("value", True).over(w.rowsBetween(PAST, NOW)), _next(by, F.col("value"))))


def _median(v: Column, w: WindowSpec, minimum: int) -> Column:
    return F.when(F.count(v).over(w) >= minimum, F.percentile(v, F.lit(0.5)).over(w))


def causal_hampel(df: DataFrame, by: list[str], window: int, sigmas: float = 3.0, minimum: int = 1) -> DataFrame:
    """Trailing Hampel filter: each row's deviation from its own trailing median; the scale is the trailing median of those
    deviations. Adds ``clean`` and ``replaced``."""
    w = _order(by).rowsBetween(-(window - 1), 0)
    rows = df.withColumn("_m", _median(F.col("value"), w, minimum))
    rows = rows.withColumn("_d", F.abs(F.col("value") - F.col("_m")))
    rows = rows.withColumn("_s", _median(F.col("_d"), w, minimum) * 1.4826)
    out = F.coalesce(F.col("_d") > sigmas * F.col("_s"), F.lit(False))
    return rows.withColumns({"clean": F.when(out, F.col("_m")).otherwise(F.col("value")), "replaced": out}).drop("_m", "_d", "_s")


def centered_hampel(df: DataFrame, by: list[str], half: int, sigmas: float = 3.0) -> DataFrame:
    """Centred window of 2 half + 1 rows with that window's own median and MAD."""
    w = _order(by).rowsBetween(-half, half)
    rows = df.withColumns({"_m": _median(F.col("value"), w, 1), "_all": F.collect_list("value").over(w)})
    rows = rows.withColumn("_s", 1.4826 * array_median(F.transform("_all", lambda x: F.abs(x - F.col("_m")))))
    out = F.coalesce(F.abs(F.col("value") - F.col("_m")) > sigmas * F.col("_s"), F.lit(False))
    return rows.withColumns({"clean": F.when(out, F.col("_m")).otherwise(F.col("value")), "replaced": out}).drop("_m", "_all", "_s")


def array_median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def rolling_mad(df: DataFrame, by: list[str], window: int) -> DataFrame:
    """MAD inside one trailing frame around that frame's own median."""
    w = _order(by).rowsBetween(-(window - 1), 0)
    rows = df.withColumn("_all", F.collect_list("value").over(w))
    rows = rows.withColumn("_m", array_median(F.col("_all")))
    return rows.withColumn("mad", array_median(F.transform("_all", lambda x: F.abs(x - F.col("_m"))))).drop("_all", "_m")


def savgol(df: DataFrame, by: list[str]) -> DataFrame:
    """Quadratic Savitzky-Golay smoothing over five rows; rows without two neighbours on both sides keep their value."""
    #: Fixed convolution weights of the five-point quadratic filter.
    weights = (-3, 12, 17, 12, -3)
    w = _order(by)
    at = lambda k: F.col("value") if k == 0 else (F.lag("value", -k).over(w) if k < 0 else F.lead("value", k).over(w))
    total = sum((c * at(k) for c, k in zip(weights, range(-2, 3), strict=True)), F.lit(0.0)) / 35
    return df.withColumn("smooth", F.coalesce(total, F.col("value")))


def trailing_mean(df: DataFrame, by: list[str], window: int) -> DataFrame:
    return df.withColumn("smooth", F.avg("value").over(_order(by).rowsBetween(-(window - 1), 0)))


def ewma(df: DataFrame, by: list[str], alpha: float, width: int = DAY) -> DataFrame:
    """``s_t = a x_t + (1 - a) s_(t-1)`` seeded at the first valid value, held over nulls; one row per row with ``ewma``.

    Over the n valid rows of a piece of time the step is affine, ``(1 - a)^n s + b``, so the state before each piece follows from
    its summary (n, b, and the value where the piece itself seeds the series), and a task holds ``width`` micros of a key.
    """

    def fold(g, state):
        out = []
        for x in g["value"]:
            if x is not None and x == x:
                state = x if state is None else alpha * x + (1 - alpha) * state
            out.append(state)
        return out

    def summarise(g):
        n, b, seeded = 0, 0.0, None
        for x in g["value"]:
            if x is not None and x == x:
                n, b, seeded = n + 1, alpha * x + (1 - alpha) * b, x if seeded is None else alpha * x + (1 - alpha) * seeded
        return [float(n), b, float("nan") if seeded is None else seeded]

    def carry(state, s):
        if not s[0]:
            return state
        return s[2] if state is None else (1 - alpha) ** s[0] * state + s[1]

    return carried_fold(df, by, ["value"], width, summarise, carry, None, fold, "ewma")


def tau_alpha(tau: float) -> float:
    from math import exp

    return 1 - exp(-1 / tau)


def segment_ewma(df: DataFrame, by: list[str], alpha: float, width: int = DAY) -> DataFrame:
    """EWMA started anew in every contiguous run of valid rows.

    A missing row ends the state. A piece of time without one is affine in the state before it, as in ``ewma``; one with such a row
    ends in a state of its own. So a run is no group of its own, and a task holds ``width`` micros of a key."""

    def after(state, x):
        return state if x != x else x if state is None else alpha * x + (1 - alpha) * state

    def fold(g, state):
        out = []
        for x, ok in zip(g["value"], g["_ok"], strict=True):
            state = after(state, x) if ok else None
            out.append(state)
        return out

    def summarise(g):
        n, b, own, cut = 0, 0.0, None, False
        for x, ok in zip(g["value"], g["_ok"], strict=True):
            if not ok:
                own, cut = None, True
            elif x == x:
                n, b, own = n + 1, alpha * x + (1 - alpha) * b, after(own, x)
        return [float(n), b, float("nan") if own is None else own, float(cut)]

    def carry(state, s):
        own = None if s[2] != s[2] else s[2]
        if s[3] or state is None:
            return own
        return (1 - alpha) ** s[0] * state + s[1]

    marked = runs(df, by, F.col("value").isNotNull(), "segment").withColumn("_ok", F.col("value").isNotNull())
    folded = carried_fold(marked, by, ["value", "_ok", "segment"], width, summarise, carry, None, fold, "ewma")
    return folded.where("_ok").select(*by, "segment", "event_id", "t", "value", "ewma")


def invalid_segments(df: DataFrame, by: list[str], bad: Column) -> DataFrame:
    """``run, first_row, last_row, points`` of the runs where ``bad`` holds."""
    numbered = df.withColumn("rn", F.row_number().over(_order(by))).withColumn("_bad", bad)
    marked = runs(numbered, by, F.col("_bad"))
    return marked.where("_bad").groupBy(*by, "run").agg(F.min("rn").alias("first_row"), F.max("rn").alias("last_row"), F.count(F.lit(1)).alias("points"))


def merge_segments(segments: DataFrame, by: list[str], max_gap: int, min_points: int) -> DataFrame:
    """Left-to-right merge of segments of at least ``min_points`` (the merged one counts with the gap) when at most ``max_gap``
    rows lie between. A merged segment is at least as long as its last part, so each pair of neighbours decides by itself."""
    w = Window.partitionBy(*by).orderBy("first_row", "last_row", "points")
    gap = F.col("first_row") - F.lag("last_row").over(w) - 1
    joins = (gap <= max_gap) & (F.lag("points").over(w) >= min_points) & (F.col("points") >= min_points)
    marked = segments.select(*by, "first_row", "last_row", "points", gap.alias("_gap"), F.coalesce(joins, F.lit(False)).alias("_joins"))
    placed = marked.withColumn("_group", F.sum((~F.col("_joins")).cast("int")).over(w))
    points = F.sum("points") + F.sum(F.when(F.col("_joins"), F.col("_gap")).otherwise(0))
    last = F.max(F.struct("first_row", "last_row"))["last_row"]
    merged = placed.groupBy(*by, "_group").agg(F.min("first_row").alias("first_row"), last.alias("last_row"), points.cast("long").alias("points"))
    return merged.select(*by, F.col("first_row").cast("int").alias("first_row"), F.col("last_row").cast("int").alias("last_row"), "points")


def continuous_base(df: DataFrame, by: list[str]) -> DataFrame:
    """Level, mean, MAD, activity, slope and range over the last three or five rows."""
    w = _order(by)
    three, five = w.rowsBetween(-2, 0), w.rowsBetween(-4, 0)
    rows = df.withColumn("_d", F.abs(F.col("value") - F.lag("value").over(w)))
    rows = rows.withColumns(
        {
            "lvl3": F.percentile("value", F.lit(0.5)).over(three),
            "mean5": F.avg("value").over(five),
            "act5": F.sum("_d").over(five),
            "slope5": (F.col("value") - F.lag("value", 4).over(w)) / 4,
            "range5": F.max("value").over(five) - F.min("value").over(five),
        }
    ).drop("_d")
    return rolling_mad(rows, by, 5).withColumnRenamed("mad", "mad5")


def step_base(df: DataFrame, by: list[str], window: int = 30) -> DataFrame:
    """Changed flag, rows since the last change, last step size carried forward, changes over the last rows."""
    w = _order(by)
    rows = df.withColumns({"_rn": F.row_number().over(w), "_step": F.col("value") - F.lag("value").over(w)})
    rows = rows.withColumn("changed", F.coalesce(F.col("_step") != 0, F.lit(False)).cast("int"))
    hit = F.col("changed") == 1
    past = w.rowsBetween(PAST, NOW)
    return rows.withColumns(
        {
            "age": F.col("_rn") - F.coalesce(F.last(F.when(hit, F.col("_rn")), True).over(past), F.first("_rn").over(past)),
            "last_step": F.coalesce(F.last(F.when(hit, F.col("_step")), True).over(past), F.lit(0.0)),
            "changes": F.sum("changed").over(w.rowsBetween(-(window - 1), 0)),
        }
    ).drop("_rn", "_step")


def segment_lags(df: DataFrame, by: list[str], lags: list[int]) -> DataFrame:
    """Lags that never leave a contiguous run of valid rows."""
    rows = runs(df, by, F.col("value").isNotNull(), "segment")
    w = _order([*by, "segment"])
    return rows.withColumns({f"lag{k}": F.lag("value", k).over(w) for k in lags})


def row_rolling(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """Row-count rolling mean, sample std, min and max, NULL below max(5, n // 3) values; the point and its change over n - 1 rows."""
    w = _order(by)
    f, least = w.rowsBetween(-(n - 1), 0), max(5, n // 3)
    ok = F.count("value").over(f) >= least
    v = F.col("value")
    stats = {"mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)}
    return df.withColumns({**{k: F.when(ok, a.over(f)) for k, a in stats.items()}, "delta": v - F.lag(v, n - 1).over(w)})


def resample_last(df: DataFrame, by: list[str], step: int) -> DataFrame:
    """Last value per step of ``step`` micros from a key's first to its last step, forward filled."""
    steps = df.where("value is not null").groupBy(*by, F.floor(F.col("t") / step).alias("step")).agg(F.max(F.struct("t", "event_id", "value"))["value"].alias("value"))
    spans = steps.groupBy(*by).agg(F.min("step").alias("_a"), F.max("step").alias("_b"))
    full = spans.select(*by, F.explode(F.sequence("_a", "_b")).alias("step"))
    w = Window.partitionBy(*by).orderBy("step").rowsBetween(PAST, NOW)
    return full.join(steps, [*by, "step"], "left").withColumn("value", F.last("value", True).over(w))


def future_flag(df: DataFrame, by: list[str], horizon: int, flag: Column) -> DataFrame:
    """Max of a 0/1 flag in (t, t + horizon]; NULL where no row follows in time.

    It is the next flagged row's time that decides, and a frame that only grows finds it; buckets of the horizon, each with a copy of
    the next, keep a long key parallel. Rows without a time are one another's window."""
    rows = halo(df.withColumn("_flag", flag.cast("int")), "t", horizon, False, True)
    part = Window.partitionBy(*by, "_bucket")
    after = part.orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    end = F.col("t") + F.lit(horizon)
    raised = F.min(F.when(F.col("_flag") > 0, F.col("t"))).over(after) <= end
    known = F.min(F.when(F.col("_flag").isNotNull(), F.col("t"))).over(after) <= end
    untimed = F.max(F.when(F.col("t").isNull(), F.col("_flag"))).over(part)
    future = F.when(F.col("t").isNull(), untimed).when(raised, 1).when(known, 0)
    return rows.withColumn("future", future).where("_own").select(*df.columns, "future")


#: Policies by the leading letters of a tag: kind, fill, time constant (rows).
TAG_POLICIES = {"LV": ("step", "previous", 1), "SP": ("step", "previous", 1), "TI": ("slow", "linear", 10), "LI": ("slow", "linear", 10), "FI": ("fast", "linear", 3), "PI": ("fast", "linear", 3)}


def column_policy(tag: str, note: str = "") -> tuple[str, str, int]:
    """Kind, fill method and time constant from a tag's prefix, else from its description."""
    for prefix, policy in TAG_POLICIES.items():
        if tag.upper().startswith(prefix):
            return policy
    words = {"temperature": "TI", "level": "LI", "flow": "FI", "pressure": "PI", "valve": "LV"}
    return next((TAG_POLICIES[p] for w, p in words.items() if w in note.lower()), ("unknown", "previous", 5))


def batched(columns: list[str], size: int) -> list[list[str]]:
    return [columns[i : i + size] for i in range(0, len(columns), size)]


def preprocess(df: DataFrame, by: list[str], half: int = 3, sigmas: float = 3.0, smooth: str | None = "savgol", window: int = 5) -> DataFrame:
    """Hold-last fill, centred Hampel filter, then Savitzky-Golay, a trailing mean, or nothing: ``value`` cleaned."""
    clean = centered_hampel(hold_fill(df, by), by, half, sigmas).withColumn("value", F.col("clean")).drop("clean")
    if smooth == "savgol":
        clean = savgol(clean, by).withColumn("value", F.col("smooth")).drop("smooth")
    elif smooth == "mean":
        clean = trailing_mean(clean, by, window).withColumn("value", F.col("smooth")).drop("smooth")
    return clean


def fill_pchip(df: DataFrame, by: list[str], max_points: int) -> DataFrame:
    """Null runs of at most ``max_points`` rows filled by shape-preserving cubics through the valid points, inside only.

    The cubic of a gap needs two valid points on either side; each key's rows are streamed once in a grouped task."""
    import numpy as np
    import pandas as pd

    def slopes(x, y):
        h, d = np.diff(x), np.diff(y) / np.diff(x)
        m = np.zeros(len(x))
        if len(x) == 2:
            return np.array([d[0], d[0]])
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = (np.sign(d[1:]) == np.sign(d[:-1])) & (d[1:] != 0) & (d[:-1] != 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)
        for i, (a, b, ha, hb) in ((0, (d[0], d[1], h[0], h[1])), (-1, (d[-1], d[-2], h[-1], h[-2]))):
            e = ((2 * ha + hb) * a - ha * b) / (ha + hb)
            m[i] = 0.0 if np.sign(e) != np.sign(a) else (3 * a if np.sign(a) != np.sign(b) and abs(e) > 3 * abs(a) else e)
        return m

    def fill(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["t", "event_id"]).reset_index(drop=True)
        v = g["value"].to_numpy(float)
        t = g["t"].to_numpy(float) / 1e6
        ok = np.flatnonzero(~np.isnan(v))
        ok = ok[np.concatenate([[True], np.diff(t[ok]) > 0])] if len(ok) else ok
        out, filled = v.copy(), np.zeros(len(v), bool)
        if len(ok) >= 2:
            x, y = t[ok], v[ok]
            m = slopes(x, y)
            for k in np.flatnonzero(np.diff(ok) > 1):
                a, b = ok[k], ok[k + 1]
                if b - a - 1 <= max_points:
                    h = x[k + 1] - x[k]
                    s = (t[a + 1 : b] - x[k]) / h
                    out[a + 1 : b] = (1 + 2 * s) * (1 - s) ** 2 * y[k] + s * (1 - s) ** 2 * h * m[k] + s**2 * (3 - 2 * s) * y[k + 1] + s**2 * (s - 1) * h * m[k + 1]
                    filled[a + 1 : b] = np.isnan(v[a + 1 : b])
        return g.assign(value=out, filled=filled)

    rows = df.select(*by, "event_id", "t", "value")
    return rows.groupBy(*by).applyInPandas(fill, StructType([*rows.schema.fields, StructField("filled", BooleanType())]))


def period_key(ts: str, freq: str) -> Column:
    """Calendar period of a time: ``month`` as yyyy-MM, otherwise the truncated date."""
    return F.date_format(ts, "yyyy-MM") if freq == "month" else F.date_format(F.date_trunc(freq, F.col(ts)), "yyyy-MM-dd")
