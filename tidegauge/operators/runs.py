"""Segments, alarm policies and their event-level evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.timeline import DAY, carried_fold
from tidegauge.operators.series import ewma

NORMAL, WARNING, ALARM = 0, 1, 2


def segments(df: DataFrame, by: list[str], label: str, gap: int, t: str = "t", order: str = "event_id") -> DataFrame:
    """Rows with ``segment``: a new one where the label changes or more than ``gap`` micros pass."""
    w = Window.partitionBy(*by).orderBy(t, order)
    new = (~F.col(label).eqNullSafe(F.lag(label).over(w))) | (F.col(t) - F.lag(t).over(w) > gap) | F.lag(t).over(w).isNull()
    return df.withColumn("_new", new.cast("int")).withColumn("segment", F.sum("_new").over(w)).drop("_new")


def segment_table(df: DataFrame, by: list[str], label: str, gap: int, t: str = "t") -> DataFrame:
    return segments(df, by, label, gap, t).groupBy(*by, "segment").agg(
        F.first(label).alias(label), F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("rows")
    )


def run_stats(df: DataFrame, by: list[str], on: str, t: str = "t", order: str = "event_id") -> DataFrame:
    """Per key: number of on-runs, mean length of an on-run, and switches between on and off."""
    w = Window.partitionBy(*by).orderBy(t, order)
    before = F.lag(on).over(w)
    rows = df.withColumns({"_start": (F.col(on) & ~F.coalesce(before, F.lit(False))).cast("int"), "_switch": F.coalesce(F.col(on) != before, F.lit(False)).cast("int")})
    n = F.sum("_start")
    return rows.groupBy(*by).agg(
        n.alias("runs"),
        F.coalesce(F.count_if(F.col(on)) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("mean_run"),
        F.sum("_switch").alias("switches"),
    )


def two_level(p: Column, warn: float, alarm: float) -> Column:
    return F.when(p >= alarm, ALARM).when(p >= warn, WARNING).otherwise(NORMAL)


def consecutive(df: DataFrame, by: list[str], flag: str, k: int, t: str = "t", order: str = "event_id") -> DataFrame:
    """``alarm`` once the flag has held for ``k`` rows in line; a frame of k rows, no state."""
    w = Window.partitionBy(*by).orderBy(t, order).rowsBetween(-(k - 1), 0)
    return df.withColumn("alarm", (F.sum(F.col(flag).cast("int")).over(w) == k))


def k_of_n(df: DataFrame, by: list[str], flag: str, k: int, n: int, t: str = "t", order: str = "event_id") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(t, order).rowsBetween(-(n - 1), 0)
    return df.withColumn("alarm", F.sum(F.col(flag).cast("int")).over(w) >= k)


def next_state(state: int, p: float | None, warn: float, alarm: float, warn_release: float = 0.80, alarm_release: float = 0.85) -> int:
    """One step of the two-level hysteresis: up at a threshold at once, down below its release share; a missing score holds. An
    alarm gives way to a warning from the warning's threshold up to its own release, and to normal below the warning's release;
    between the warning's release and its threshold it holds."""
    if p is None or p != p:
        return state
    if p >= alarm or (state == ALARM and (p >= alarm * alarm_release or warn * warn_release <= p < warn)):
        return ALARM
    if p >= warn or (state == WARNING and p >= warn * warn_release):
        return WARNING
    return NORMAL


def hysteresis(df: DataFrame, by: list[str], score: str, warn: float, alarm: float, warn_release: float = 0.80, alarm_release: float = 0.85, width: int = DAY) -> DataFrame:
    """``state`` per row, by a fold over each key's rows in time.

    A piece of time maps each of the three states before it to one after it; the maps are followed from piece to piece, so a
    task holds ``width`` micros of a key.
    """

    def fold(g, state):
        out, state = [], int(state)
        for p in g[score]:
            state = next_state(state, p, warn, alarm, warn_release, alarm_release)
            out.append(state)
        return out

    ends = lambda g: [float(fold(g, s)[-1]) for s in (NORMAL, WARNING, ALARM)]
    folded = carried_fold(df, by, [score], width, ends, lambda state, s: s[int(state)], float(NORMAL), fold, "state")
    return folded.withColumn("state", F.col("state").cast("int"))


def ema_hysteresis(df: DataFrame, by: list[str], score: str, alpha: float, on: float, off: float, width: int = DAY) -> DataFrame:
    """Alarm from an exponential mean of the score: on at ``on``, off below ``off``; a missing score holds the mean. Both the mean
    and the alarm are carried from piece to piece of ``width`` micros."""

    def fold(g, state):
        out, state = [], bool(state)
        for level in g["ewma"]:
            if level is not None and level == level:
                state = level >= on or (state and level >= off)
            out.append(float(state))
        return out

    level = ewma(df.select(*by, "event_id", "t", F.col(score).alias("value")), by, alpha, width)
    ends = lambda g: [fold(g, s)[-1] for s in (False, True)]
    folded = carried_fold(level.withColumnRenamed("value", score), by, [score, "ewma"], width, ends, lambda state, s: s[int(state)], 0.0, fold, "alarm")
    return folded.drop("ewma").withColumn("alarm", F.col("alarm") == 1.0)


def evaluate_states(df: DataFrame, by: list[str], bad: str, state: str, gap: int, horizon: int) -> DataFrame:
    """Segment-level results of a policy, one row: bad-segment recall by warning and by alarm, share of bad segments warned
    within ``horizon`` before they start, share of good segments with an alarm, median first-hit delay in rows and minutes."""
    rows = segments(df, by, bad, gap)
    w = Window.partitionBy(*by, "segment").orderBy("t", "event_id")
    rows = rows.withColumn("pos", F.row_number().over(w) - 1)
    # the last warning before a row decides, and a frame that only grows finds it
    back = Window.partitionBy(*by).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col(state) >= WARNING, F.col("t"))).over(back)
    rows = rows.withColumn("warned_before", F.coalesce((last >= F.col("t") - F.lit(horizon)).cast("int"), F.lit(0)))
    hit = F.when(F.col(state) >= WARNING, F.struct("pos", "t"))
    per = rows.groupBy(*by, "segment").agg(
        F.first(bad).alias("bad"),
        F.max((F.col(state) >= WARNING).cast("int")).alias("warned"),
        F.max((F.col(state) == ALARM).cast("int")).alias("alarmed"),
        F.max(F.when(F.col("pos") == 0, F.col("warned_before"))).alias("prewarned"),
        F.min(hit)["pos"].alias("delay_rows"),
        ((F.min(hit)["t"] - F.min("t")) / F.lit(60e6)).alias("delay_minutes"),
    )
    is_bad = lambda x: F.when(F.col("bad"), x)
    return per.agg(
        F.count_if("bad").alias("bad_segments"),
        F.avg(is_bad(F.col("warned"))).alias("warning_recall"),
        F.avg(is_bad(F.col("alarmed"))).alias("alarm_recall"),
        F.avg(is_bad(F.col("prewarned"))).alias("prewarned"),
        F.avg(F.when(~F.col("bad"), F.col("alarmed"))).alias("false_alarm_share"),
        F.percentile(is_bad(F.col("delay_rows")), F.lit(0.5)).alias("median_delay_rows"),
        F.percentile(is_bad(F.col("delay_minutes")), F.lit(0.5)).alias("median_delay_minutes"),
    )


def prewarn_lead(df: DataFrame, by: list[str], bad: str, warned: str, gap: int, horizon: int) -> DataFrame:
    """Per bad segment: hit at its start, and the lead (minutes) of the earliest warning within ``horizon`` before it."""
    rows = segments(df, by, bad, gap)
    # backwards in time the frame of all rows from ``t - horizon`` on only grows
    since = Window.partitionBy(*by).orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, horizon)
    rows = rows.withColumn("_first", F.min(F.when(F.col(warned), F.col("t"))).over(since))
    rows = rows.withColumn("_first", F.when(F.col("_first") < F.col("t"), F.col("_first")))
    first = F.min(F.struct("t", "event_id", warned, "_first"))
    per = rows.where(bad).groupBy(*by, "segment").agg(first.alias("x"))
    return per.select(*by, "segment", F.col(f"x.{warned}").alias("start_hit"), ((F.col("x.t") - F.col("x._first")) / F.lit(60e6)).alias("lead_minutes"))


def joint_states(now: DataFrame, future: DataFrame, key: str, now_threshold: float, future_threshold: float) -> DataFrame:
    """Alarm if the current score reaches its threshold, else warning if the future score reaches its own, else normal."""
    state = F.when(F.col("now_score") >= now_threshold, "alarm").when(F.col("future_score") >= future_threshold, "warning").otherwise("normal")
    return now.join(future, key).withColumn("state", state)


def segment_hits(df: DataFrame, by: list[str], actual: str, predicted: str, gap: int) -> DataFrame:
    """Segments by the actual label with the largest prediction in each: recall over true segments, false-alarm share over the others,
    and the pointwise confusion, one row."""
    per = segments(df, by, actual, gap).groupBy(*by, "segment").agg(
        F.first(actual).alias("a"),
        F.max(F.col(predicted).cast("int")).alias("hit"),
        F.count_if(F.col(actual) & F.col(predicted)).alias("tp"),
        F.count_if(~F.col(actual) & F.col(predicted)).alias("fp"),
        F.count_if(F.col(actual) & ~F.col(predicted)).alias("fn"),
    )
    return per.agg(
        F.avg(F.when(F.col("a"), F.col("hit"))).alias("segment_recall"),
        F.avg(F.when(~F.col("a"), F.col("hit"))).alias("segment_false_share"),
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
        F.sum("fn").alias("fn"),
    )
