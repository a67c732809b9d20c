"""Queries over slices, as-of joins, series cleaning and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.timeline import DAY, HOUR, MINUTE
from tidegauge.operators import asof, runs, series, slices, sweep
from tidegauge.plans.registry import EVENTS_SQL as EV
from tidegauge.plans.registry import events, query, samples, stream

H = 3_600_000_000
CORE = """arg_max(r.value, r.t) AS last, avg(r.value) AS mean, stddev_pop(r.value) AS std, min(r.value) AS min, max(r.value) AS max,
  arg_max(r.value, r.t) - arg_min(r.value, r.t) AS delta, count(r.value) / count(*) AS valid_ratio"""
SLOPE = "CASE WHEN count(*) > 1 THEN regr_slope(r.value, (r.t - s.t) / 6e7) END"


@query(f"{EV} SELECT sample_id, count(*) AS n, {CORE}, {SLOPE} AS slope, any_value(s.value BETWEEN 40 AND 60) AS in_spec FROM s JOIN r ON r.t BETWEEN s.t - {H} AND s.t GROUP BY sample_id HAVING count(*) >= 3", "last mean std min max delta valid_ratio slope")
def slice_features_60m(spark, d):
    s = samples(spark, d).withColumn("in_spec", F.col("value").between(40, 60))
    return sweep.encode(s, stream(spark, d), HOUR, ["sample_id", "in_spec"], ["count", *slices.CORE_STATS], 3).withColumnRenamed("count", "n")


@query(f"{EV} SELECT sample_id, {CORE}, coalesce({SLOPE}, 0) AS slope FROM s JOIN r ON r.t BETWEEN s.t - {H // 2} AND s.t GROUP BY sample_id", "last mean std min max delta valid_ratio slope")
def slice_zero_policy(spark, d):
    return sweep.encode(samples(spark, d), stream(spark, d), HOUR // 2, ["sample_id"], slices.CORE_STATS, zero_undefined=True, min_rows=1)


@query(f"{EV} SELECT sample_id, r.sensor, count(*) AS count, avg(r.value) AS mean, quantile_cont(r.value, 0.5) AS median, max(r.value) - min(r.value) AS range FROM s JOIN r ON r.t BETWEEN s.t - {2 * H} AND s.t GROUP BY ALL", "mean median range")
def slice_by_sensor(spark, d):
    return sweep.encode(samples(spark, d), stream(spark, d), 2 * HOUR, ["sample_id"], ["count", "mean", "median", "range"], per="sensor")


@query(f"{EV} SELECT sample_id, {CORE} FROM s JOIN r ON s.unit = r.unit AND r.t BETWEEN s.t - {24 * H} AND s.t GROUP BY sample_id", "last mean std min max delta valid_ratio")
def slice_by_unit(spark, d):
    return slices.encode_slices(slices.slice_join(samples(spark, d), stream(spark, d), DAY, by=["unit"]), ["sample_id"], slices.CORE_STATS[:-1])


@query(f"{EV}, l(sensor, lag) AS (VALUES ('click', 15), ('view', 30), ('error', 45), ('signup', 60)) SELECT sample_id, l.sensor, count(*) AS count, avg(r.value) AS mean, max(r.value) AS max FROM s, l JOIN r ON r.sensor = l.sensor AND r.t BETWEEN s.t - l.lag * 60000000::bigint - {2 * H} AND s.t - l.lag * 60000000::bigint GROUP BY ALL", "mean max")
def slice_sensor_lags(spark, d):
    lags = spark.createDataFrame([("click", 15 * MINUTE), ("view", 30 * MINUTE), ("error", 45 * MINUTE), ("signup", 60 * MINUTE)], "sensor string, lag long")
    asked = samples(spark, d).crossJoin(F.broadcast(lags))
    return sweep.encode(asked, stream(spark, d), 2 * HOUR, ["sample_id", "sensor"], ["count", "mean", "max"], by=["sensor"], lag=F.col("lag"))


_MULTI = ", ".join(f"avg(r.value) FILTER (WHERE r.t >= s.t - {w} * 60000000::bigint) AS w{w}__mean, count(r.value) FILTER (WHERE r.t >= s.t - {w} * 60000000::bigint) AS w{w}__count" for w in (15, 60, 180))


@query(f"{EV} SELECT sample_id, {_MULTI} FROM s JOIN r ON r.t BETWEEN s.t - {3 * H} AND s.t GROUP BY sample_id", "w15__mean w60__mean w180__mean")
def multiscale_windows(spark, d):
    return sweep.multi_window(samples(spark, d), stream(spark, d), [15, 60, 180], ["mean", "count"])


@query(
    f"""{EV}, y AS (SELECT sample_id, l.lag, max(r.t) AS e FROM s, (VALUES (0), (60)) l(lag) JOIN r ON r.t BETWEEN s.t - l.lag * 60000000::bigint - 600000000 AND s.t - l.lag * 60000000::bigint GROUP BY ALL),
j AS (SELECT y.sample_id, y.lag, w.w AS "window", r.sensor, r.value FROM y, (VALUES (30), (120)) w(w) JOIN r ON r.t > y.e - w.w * 60000000::bigint AND r.t <= y.e),
n AS (SELECT sample_id, lag, "window", count(*) AS whole FROM j GROUP BY ALL),
g AS (SELECT sample_id, lag, "window", sensor, count(value) AS n, avg(value) AS mean, var_pop(value) AS var, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
  max(value) - min(value) AS range, stddev_pop(value) / nullif(abs(avg(value)), 0) AS cv, quantile_cont(value, 0.5) AS median FROM j GROUP BY ALL)
SELECT g.* , 1 - n / whole AS missing_rate,
  max(CASE WHEN "window" = 30 THEN mean END) OVER p - max(CASE WHEN "window" = 120 THEN mean END) OVER p AS drift
FROM g JOIN n USING (sample_id, lag, "window") WINDOW p AS (PARTITION BY sample_id, lag, sensor)""",
    "mean var std min max range cv median missing_rate drift",
)
def window_lag_grid(spark, d):
    return sweep.window_lag_grid(samples(spark, d), stream(spark, d), [30, 120], [0, 60], 10 * MINUTE, "sensor")


SLICE2H = f"{EV}, j AS (SELECT sample_id, s.t AS sample_t, r.* EXCLUDE (unit) FROM s JOIN r ON r.t BETWEEN s.t - {2 * H} AND s.t)"


@query(
    f"""{SLICE2H}, a AS (SELECT *, lag(value) OVER w AS prev FROM j WINDOW w AS (PARTITION BY sample_id ORDER BY t, event_id)),
b AS (SELECT *, value - prev AS d, CASE WHEN value <> prev THEN sign(value - prev) END AS s FROM a),
c AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
SELECT sample_id, avg(d) AS diff_mean, stddev_pop(d) AS diff_std, max(abs(d)) AS diff_max_abs, count_if(coalesce(s <> before, false))::bigint AS sign_changes,
  count_if(coalesce(d > 0, false)) / nullif(count(d), 0) AS up_ratio, count_if(coalesce(d < 0, false)) / nullif(count(d), 0) AS down_ratio, stddev_pop(d) / nullif(stddev_pop(value), 0) AS std_ratio FROM c GROUP BY sample_id""",
    "diff_mean diff_std diff_max_abs up_ratio down_ratio std_ratio",
)
def slice_dynamics(spark, d):
    return sweep.dynamics(samples(spark, d), stream(spark, d), 2 * HOUR).drop("autocorr")


@query(
    f"""{SLICE2H}, k AS (SELECT * REPLACE (floor(value / 25) AS value) FROM j), a AS (SELECT *, lag(value) OVER w AS prev, (t - lag(t) OVER w) / 6e7 AS gap FROM k WINDOW w AS (PARTITION BY sample_id ORDER BY t, event_id)),
b AS (SELECT *, sum(CASE WHEN value = prev THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id ORDER BY t, event_id) AS run FROM a),
c AS (SELECT sample_id, run, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT sample_id, max(n) AS longest FROM c GROUP BY ALL)
SELECT sample_id, 0.0::double AS missing_ratio, count(*) AS valid, any_value(longest) AS longest_run, any_value(longest) / count(*) AS freeze_ratio, max(abs(value - prev)) AS max_jump,
  round((any_value(sample_t) - max(CASE WHEN abs(value - prev) > 1 THEN t END)) / 6e7, 2) AS minutes_since_jump, stddev_pop(gap) AS gap_std FROM b JOIN m USING (sample_id) GROUP BY sample_id""",
    "missing_ratio freeze_ratio max_jump minutes_since_jump gap_std",
)
def slice_quality(spark, d):
    rows = stream(spark, d).withColumn("value", F.floor(F.col("value") / 25).cast("double"))
    return sweep.data_quality(samples(spark, d), rows, 2 * HOUR, 1.0).withColumn("minutes_since_jump", F.round("minutes_since_jump", 2))


@query(
    f"""{SLICE2H}, a AS (SELECT sample_id, t, event_id, CASE WHEN stddev_pop(value) OVER p > 0 THEN (value - avg(value) OVER p) / stddev_pop(value) OVER p ELSE 0 END AS z,
  row_number() OVER (PARTITION BY sample_id ORDER BY t, event_id) AS rn, count(*) OVER p AS n FROM j WINDOW p AS (PARTITION BY sample_id)),
b AS (SELECT *, sum(CASE WHEN abs(z) <= 1.05 THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id ORDER BY rn) AS o FROM a),
c AS (SELECT *, sum(CASE WHEN abs(z) <= 1.05 THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, o) AS stay FROM b)
SELECT sample_id, avg(abs(z)) AS mean_abs_z, avg(CASE WHEN abs(z) <= 1.05 THEN 1 ELSE 0 END) AS band_ratio, max(stay) / max(n) AS stay_ratio, arg_max(z, rn) AS last_z,
  avg(z) FILTER (WHERE rn > n - ceil(n / 4)) AS tail_bias, -arg_max(z, rn) * CASE WHEN count(*) > 1 THEN regr_slope(z, rn) ELSE 0 END AS reversion FROM c GROUP BY sample_id""",
    "mean_abs_z band_ratio stay_ratio last_z tail_bias reversion",
)
def slice_centered(spark, d):
    return sweep.centered(samples(spark, d), stream(spark, d), 2 * HOUR, 1.05)


@query(
    f"""{SLICE2H}, a AS (SELECT sample_id, value, row_number() OVER (PARTITION BY sample_id ORDER BY t, event_id) AS rn, count(*) OVER (PARTITION BY sample_id) AS n FROM j),
b AS (SELECT *, floor((rn - 1) * 3 / n) AS third, CASE WHEN n > 1 THEN (rn - 1) / (n - 1) ELSE 0 END AS place FROM a),
c AS (SELECT sample_id, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, avg(value) FILTER (WHERE third = 0) AS head,
  avg(value) FILTER (WHERE third = 1) AS middle, avg(value) FILTER (WHERE third = 2) AS tail, first(place ORDER BY value DESC, rn)::double AS argmax_place, first(place ORDER BY value, rn)::double AS argmin_place FROM b GROUP BY sample_id)
SELECT *, q75 - q25 AS iqr, head - 2 * middle + tail AS curvature FROM c""",
    "q25 q50 q75 head middle tail argmax_place argmin_place iqr curvature",
)
def slice_shape(spark, d):
    return sweep.shape(samples(spark, d), stream(spark, d), 2 * HOUR)


@query(
    f"""{SLICE2H}, a AS (SELECT sample_id, list(value ORDER BY t, event_id) AS v FROM j GROUP BY sample_id HAVING count(*) >= 3),
b AS (SELECT sample_id, v[-1] AS last, list_reduce(v, lambda x, y: 0.8 * x + 0.2 * y) AS ewma FROM a) SELECT *, last - ewma AS last_minus_ewma FROM b""",
    "last ewma last_minus_ewma",
)
def slice_ewma(spark, d):
    return sweep.ewma(samples(spark, d), stream(spark, d), 2 * HOUR, 0.8)


_PATH = ", ".join(f"max(CASE WHEN k = {i} THEN v END) AS r{i}" for i in range(6))
_FILL = ", ".join("coalesce(" + ", ".join(f"r{j}" for j in range(i, -1, -1)) + f", NULL) AS p{i}" for i in range(6))
PATH_SQL = f"""{EV}, j AS (SELECT sample_id, 5 - floor((s.t - r.t) / 1200000000)::int AS k, r.t, r.event_id, r.value FROM s JOIN r ON r.t BETWEEN s.t - {2 * H - 1} AND s.t),
l AS (SELECT sample_id, k, arg_max(value, (t, event_id)) AS v FROM j GROUP BY ALL), w AS (SELECT sample_id, {_PATH} FROM l GROUP BY sample_id), path AS (SELECT sample_id, {_FILL} FROM w)"""


@query(f"{PATH_SQL} SELECT * FROM path", "p0 p1 p2 p3 p4 p5")
def slice_step_path(spark, d):
    return sweep.step_path(samples(spark, d), stream(spark, d), 6, 20 * MINUTE)


@query(
    f"""{PATH_SQL}, u AS (SELECT sample_id, unnest([0, 1, 2, 3, 4, 5]) AS i, unnest([p5, p4, p3, p2, p1, p0]) AS x FROM path),
g AS (SELECT sample_id, CASE WHEN count(x) > 1 THEN regr_slope(x, i) END AS path_slope FROM u WHERE x IS NOT NULL GROUP BY sample_id)
SELECT sample_id, p5 - p0 AS change, (coalesce(p5, p4) + coalesce(p4, p5)) / 2 - (coalesce(p1, p0) + coalesce(p0, p1)) / 2 AS near_minus_far, path_slope FROM path LEFT JOIN g USING (sample_id)""",
    "change near_minus_far path_slope",
)
def path_key_change(spark, d):
    path = sweep.step_path(samples(spark, d), stream(spark, d), 6, 20 * MINUTE)
    return slices.key_change(path, [f"p{i}" for i in range(5, -1, -1)]).select("sample_id", "change", "near_minus_far", "path_slope")


@query(
    f"""{EV} SELECT event_id, count(value) OVER w AS n, avg(value) OVER w AS mean, min(value) OVER w AS min, max(value) OVER w AS max FROM r
WINDOW w AS (PARTITION BY sensor ORDER BY t RANGE BETWEEN {2 * H - 1} PRECEDING AND CURRENT ROW)""",
    "mean min max",
)
def rolling_time_windows(spark, d):
    return sweep.rolling(stream(spark, d), ["sensor"], 2 * HOUR).select("event_id", "n", "mean", "min", "max")


@query(
    f"""{EV}, f AS (SELECT sample_id, {CORE} FROM s JOIN r ON r.t BETWEEN s.t - {H} AND s.t GROUP BY sample_id)
SELECT sample_id, (last - min) / (max - min + 1e-6) AS place, std / (abs(mean) + 1e-6) AS std_over_mean, (max - min) / (abs(mean) + 1e-6) AS range_over_mean, delta / (abs(std) + 1e-6) AS delta_over_std, last - mean AS last_minus_mean,
  mean - min AS mean_minus_min, mean / nullif(min, 0) AS mean_over_min FROM f WHERE std > 0.001""",
    "place std_over_mean range_over_mean delta_over_std last_minus_mean mean_minus_min mean_over_min",
)
def relative_dynamics(spark, d):
    f = sweep.encode(samples(spark, d), stream(spark, d), HOUR, ["sample_id"], slices.CORE_STATS[:-1]).where("std > 0.001")
    both = slices.interactions(slices.relative(f), [("mean", "min")])
    return both.select("sample_id", "place", "std_over_mean", "range_over_mean", "delta_over_std", "last_minus_mean", "mean_minus_min", "mean_over_min")


@query(
    """SELECT event_id, sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS minute_sin, cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS minute_cos, sin(2 * pi() * (isodow(ts) - 1) / 7) AS day_sin,
  cos(2 * pi() * (isodow(ts) - 1) / 7) AS day_cos, (hour(ts) < 8)::int AS shift_0, (hour(ts) >= 8 AND hour(ts) < 16)::int AS shift_1, (hour(ts) >= 16)::int AS shift_2 FROM events""",
    "minute_sin minute_cos day_sin day_cos",
)
def time_context(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts")
    return slices.time_context(rows, "ts").drop("ts")


@query(f"{EV} SELECT sample_id, CASE WHEN s.t - r.t <= {12 * H} THEN r.value END AS found, CASE WHEN s.t - r.t <= {12 * H} THEN r.t - s.t END AS gap FROM s ASOF LEFT JOIN r ON s.unit = r.unit AND s.t >= r.t", "found")
def asof_backward_12h(spark, d):
    r = stream(spark, d).select("unit", "t", F.col("value").alias("found"), "event_id")
    return asof.asof_join(samples(spark, d), r, ["found"], 12 * HOUR, ["unit"], order=["event_id"]).select("sample_id", "found", "gap")


@query(
    f"""{EV}, b AS (SELECT sample_id, s.t, r.t AS bt, r.value AS bv FROM s ASOF LEFT JOIN r ON s.t >= r.t), f AS (SELECT sample_id, r.t AS ft, r.value AS fv FROM s ASOF LEFT JOIN r ON s.t <= r.t),
x AS (SELECT sample_id, t, CASE WHEN bt IS NULL OR ft - t < t - bt THEN ft ELSE bt END AS nt, CASE WHEN bt IS NULL OR ft - t < t - bt THEN fv ELSE bv END AS nv FROM b JOIN f USING (sample_id))
SELECT sample_id, CASE WHEN abs(nt - t) <= 120000000 THEN nv END AS found, CASE WHEN abs(nt - t) <= 120000000 THEN nt - t END AS gap FROM x""",
    "found",
)
def asof_nearest_2m(spark, d):
    r = stream(spark, d).select("t", F.col("value").alias("found"), "event_id")
    return asof.asof_join(samples(spark, d), r, ["found"], 2 * MINUTE, direction="nearest", order=["event_id"]).select("sample_id", "found", "gap")


def _lag_sql(m):
    return f"(SELECT sample_id, CASE WHEN a.at - r.t <= 600000000 THEN r.value END AS v{m} FROM (SELECT sample_id, t - {m * 60000000} AS at FROM s) a ASOF LEFT JOIN r ON a.at >= r.t)"


@query(
    f"""{EV} SELECT sample_id, v0 AS v__lag0, v30 AS v__lag30, v60 AS v__lag60, ((v0 IS NOT NULL)::int + (v30 IS NOT NULL)::int + (v60 IS NOT NULL)::int) / 3 AS available
FROM {_lag_sql(0)} JOIN {_lag_sql(30)} USING (sample_id) JOIN {_lag_sql(60)} USING (sample_id)""",
    "v__lag0 v__lag30 v__lag60 available",
)
def lagged_snapshot_grid(spark, d):
    r = stream(spark, d).select("t", F.col("value").alias("v"), "event_id")
    return asof.lagged_snapshots(samples(spark, d), r, ["v"], [0, 30, 60], 10, order=["event_id"]).drop("unit", "t", "value")


@query(
    f"""{EV}, q AS (SELECT unit, floor(t / {H}) * {H} AS t, arg_max(value, event_id) AS v FROM r GROUP BY ALL) SELECT sample_id, CASE WHEN s.t - 1800000000 - q.t <= {24 * H} THEN q.v END AS v
FROM s ASOF LEFT JOIN q ON s.unit = q.unit AND s.t - 1800000000 >= q.t""",
    "v",
)
def asof_snapshot_unique(spark, d):
    r = stream(spark, d).select("unit", (F.floor(F.col("t") / HOUR) * HOUR).alias("t"), F.col("value").alias("v"), "event_id")
    return asof.asof_snapshot(samples(spark, d), r, ["v"], 30, 24 * 60, "event_id", ["unit"]).select("sample_id", "v")


@query(
    f"""{EV}, n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t, event_id) AS rn FROM r), x AS (SELECT sample_id, s.unit, n.rn AS e FROM s ASOF JOIN n ON s.unit = n.unit AND s.t >= n.t WHERE s.t - n.t <= {24 * H})
SELECT sample_id, count(*) AS n, max(n.t) - min(n.t) AS span, avg(n.value) AS mean FROM x JOIN n ON x.unit = n.unit AND n.rn BETWEEN e - 2 AND e GROUP BY sample_id HAVING count(*) = 3 AND max(n.t) - min(n.t) <= {72 * H}""",
    "mean",
)
def row_count_slice(spark, d):
    return asof.row_window_slices(samples(spark, d), stream(spark, d), 3, DAY, 3 * DAY, ["unit"])


HOLES = f"{EV}, h AS (SELECT * REPLACE (CASE WHEN event_id % 7 IN (0, 1) OR event_id % 50 < 6 THEN NULL ELSE value END AS value) FROM e)"
W = "(PARTITION BY sensor ORDER BY t, event_id)"


def holes(spark, d):
    return events(spark, d).withColumn("value", F.when(~((F.col("event_id") % 7).isin(0, 1) | (F.col("event_id") % 50 < 6)), F.col("value")))


GAPS = f"""{HOLES}, g AS (SELECT *, sum(c) OVER {W} AS run FROM (SELECT *, CASE WHEN (value IS NULL) = lag(value IS NULL) OVER {W} THEN 0 ELSE 1 END AS c FROM h)),
k AS (SELECT *, count(*) OVER (PARTITION BY sensor, run) AS n, last_value(CASE WHEN value IS NOT NULL THEN {{'t': t, 'v': value}} END IGNORE NULLS) OVER (PARTITION BY sensor ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
 first_value(CASE WHEN value IS NOT NULL THEN {{'t': t, 'v': value}} END IGNORE NULLS) OVER (PARTITION BY sensor ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM g)"""


@query(f"{GAPS}, o AS (SELECT event_id, value AS old, CASE WHEN value IS NULL AND n <= 2 THEN coalesce(l.v, f.v) ELSE value END AS value FROM k) SELECT event_id, value, old IS NULL AND value IS NOT NULL AS filled FROM o", "value")
def fill_previous(spark, d):
    return series.fill_gaps(holes(spark, d), ["sensor"], 2).select("event_id", "value", "filled")


@query(f"{GAPS}, o AS (SELECT event_id, value AS old, CASE WHEN value IS NULL AND n <= 2 THEN l.v + (t - l.t) / (f.t - l.t) * (f.v - l.v) ELSE value END AS value FROM k) SELECT event_id, value, old IS NULL AND value IS NOT NULL AS filled FROM o", "value")
def fill_linear_gap(spark, d):
    return series.fill_gaps(holes(spark, d), ["sensor"], 2, "linear").select("event_id", "value", "filled")


@query(f"{GAPS} SELECT event_id, coalesce(l.v, f.v) AS value FROM k", "value")
def hold_fill(spark, d):
    return series.hold_fill(holes(spark, d), ["sensor"]).select("event_id", "value")


def _frame(n):
    return f"(PARTITION BY sensor ORDER BY t, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(
    f"""{EV}, a AS (SELECT *, quantile_cont(value, 0.5) OVER {_frame(7)} AS m FROM e), b AS (SELECT *, abs(value - m) AS dev FROM a),
c AS (SELECT *, 1.4826 * quantile_cont(dev, 0.5) OVER {_frame(7)} AS s FROM b) SELECT event_id, CASE WHEN dev > 3 * s THEN m ELSE value END AS clean, dev > 3 * s AS replaced FROM c""",
    "clean",
)
def hampel_causal(spark, d):
    return series.causal_hampel(events(spark, d), ["sensor"], 7).select("event_id", "clean", "replaced")


@query(
    f"""{EV}, a AS (SELECT *, list(value) OVER (PARTITION BY sensor ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS l FROM e),
b AS (SELECT *, list_median(l) AS m FROM a), c AS (SELECT *, 1.4826 * list_median(list_transform(l, lambda x: abs(x - m))) AS s FROM b)
SELECT event_id, CASE WHEN abs(value - m) > 3 * s THEN m ELSE value END AS clean, abs(value - m) > 3 * s AS replaced FROM c""",
    "clean",
)
def hampel_centered(spark, d):
    return series.centered_hampel(events(spark, d), ["sensor"], 3).select("event_id", "clean", "replaced")


@query(f"{EV}, a AS (SELECT *, list(value) OVER {_frame(5)} AS l FROM e), b AS (SELECT *, list_median(l) AS m FROM a) SELECT event_id, list_median(list_transform(l, lambda x: abs(x - m))) AS mad FROM b", "mad")
def rolling_mad(spark, d):
    return series.rolling_mad(events(spark, d), ["sensor"], 5).select("event_id", "mad")


@query(
    f"""{EV} SELECT event_id, coalesce((-3 * lag(value, 2) OVER w + 12 * lag(value, 1) OVER w + 17 * value + 12 * lead(value, 1) OVER w - 3 * lead(value, 2) OVER w) / 35, value) AS smooth,
avg(value) OVER (PARTITION BY sensor ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS trail FROM e WINDOW w AS {W}""",
    "smooth trail",
)
def smooth_savgol(spark, d):
    a = series.savgol(events(spark, d), ["sensor"]).withColumnRenamed("smooth", "sg")
    return series.trailing_mean(a, ["sensor"], 6).select("event_id", F.col("sg").alias("smooth"), F.col("smooth").alias("trail"))


@query(
    HOLES.replace("WITH e", "WITH RECURSIVE e")
    + f""", n AS MATERIALIZED (SELECT sensor, event_id, value, row_number() OVER {W} AS rn FROM h),
x AS (SELECT sensor, event_id, rn, value AS ewma FROM n WHERE rn = 1 UNION ALL
  SELECT n.sensor, n.event_id, n.rn, CASE WHEN n.value IS NULL THEN x.ewma WHEN x.ewma IS NULL THEN n.value ELSE 0.25 * n.value + 0.75 * x.ewma END FROM x JOIN n ON n.sensor = x.sensor AND n.rn = x.rn + 1)
SELECT event_id, ewma FROM x""",
    "ewma",
)
def ewma_hold(spark, d):
    return series.ewma(holes(spark, d), ["sensor"], 0.25).select("event_id", "ewma")


_ALPHA = f"{series.tau_alpha(4.0)!r}::double"


@query(
    GAPS.replace("WITH e", "WITH RECURSIVE e")
    + f""", n AS MATERIALIZED (SELECT sensor, run, event_id, value, row_number() OVER (PARTITION BY sensor, run ORDER BY t, event_id) AS rn FROM g WHERE value IS NOT NULL),
x AS (SELECT sensor, run, event_id, rn, value AS ewma FROM n WHERE rn = 1 UNION ALL
  SELECT n.sensor, n.run, n.event_id, n.rn, {_ALPHA} * n.value + (1 - {_ALPHA}) * x.ewma FROM x JOIN n ON n.sensor = x.sensor AND n.run = x.run AND n.rn = x.rn + 1)
SELECT event_id, run::bigint AS segment, ewma FROM x""",
    "ewma",
)
def ewma_segments(spark, d):
    return series.segment_ewma(holes(spark, d), ["sensor"], series.tau_alpha(4.0)).select("event_id", "segment", "ewma")


@query(
    f"""{HOLES}, n AS (SELECT *, row_number() OVER {W} AS rn FROM h), b AS (SELECT sensor, rn, rn - row_number() OVER (PARTITION BY sensor ORDER BY rn) AS g FROM n WHERE value IS NULL)
SELECT sensor, min(rn) AS first_row, max(rn) AS last_row, count(*) AS points FROM b GROUP BY sensor, g"""
)
def invalid_segments(spark, d):
    return series.invalid_segments(holes(spark, d), ["sensor"], F.col("value").isNull()).drop("run")


_JOINS = "n.first_row - x.last_row - 1 <= 2 AND x.points >= 2 AND n.points >= 2"


@query(
    HOLES.replace("WITH e", "WITH RECURSIVE e")
    + f""", o AS (SELECT *, row_number() OVER {W} AS rn FROM h), b AS (SELECT sensor, rn, rn - row_number() OVER (PARTITION BY sensor ORDER BY rn) AS g FROM o WHERE value IS NULL),
n AS MATERIALIZED (SELECT sensor, min(rn) AS first_row, max(rn) AS last_row, count(*) AS points, row_number() OVER (PARTITION BY sensor ORDER BY min(rn)) AS k FROM b GROUP BY sensor, g),
x AS (SELECT sensor, k, first_row, last_row, points FROM n WHERE k = 1 UNION ALL
  SELECT n.sensor, n.k, CASE WHEN {_JOINS} THEN x.first_row ELSE n.first_row END, n.last_row, CASE WHEN {_JOINS} THEN x.points + n.first_row - x.last_row - 1 + n.points ELSE n.points END
  FROM x JOIN n ON n.sensor = x.sensor AND n.k = x.k + 1)
SELECT sensor, first_row::int AS first_row, max(last_row)::int AS last_row, max(points) AS points FROM x GROUP BY sensor, first_row"""
)
def merged_segments(spark, d):
    found = series.invalid_segments(holes(spark, d), ["sensor"], F.col("value").isNull())
    return series.merge_segments(found, ["sensor"], 2, 2)


@query(
    f"""{EV}, a AS (SELECT *, abs(value - lag(value) OVER {W}) AS dd, list(value) OVER {_frame(5)} AS l FROM e), b AS (SELECT *, list_median(l) AS m FROM a)
SELECT event_id, quantile_cont(value, 0.5) OVER {_frame(3)} AS lvl3, avg(value) OVER {_frame(5)} AS mean5, list_median(list_transform(l, lambda x: abs(x - m))) AS mad5, sum(dd) OVER {_frame(5)} AS act5,
 (value - lag(value, 4) OVER {W}) / 4 AS slope5, max(value) OVER {_frame(5)} - min(value) OVER {_frame(5)} AS range5 FROM b""",
    "lvl3 mean5 mad5 act5 slope5 range5",
)
def continuous_base(spark, d):
    return series.continuous_base(events(spark, d), ["sensor"]).select("event_id", "lvl3", "mean5", "mad5", "act5", "slope5", "range5")


@query(
    f"""{EV}, v AS (SELECT * REPLACE (floor(value / 50) AS value) FROM e), a AS (SELECT *, row_number() OVER {W} AS rn, value - lag(value) OVER {W} AS st FROM v),
b AS (SELECT *, CASE WHEN coalesce(st, 0) <> 0 THEN 1 ELSE 0 END AS changed FROM a)
SELECT event_id, changed, rn - coalesce(last_value(CASE WHEN changed = 1 THEN rn END IGNORE NULLS) OVER {W}, 1) AS age, coalesce(last_value(CASE WHEN changed = 1 THEN st END IGNORE NULLS) OVER {W}, 0) AS last_step,
 (sum(changed) OVER {_frame(30)})::bigint AS changes FROM b""",
    "last_step",
)
def step_base(spark, d):
    v = events(spark, d).withColumn("value", F.floor(F.col("value") / 50).cast("double"))
    return series.step_base(v, ["sensor"]).select("event_id", "changed", "age", "last_step", "changes")


@query(f"{GAPS} SELECT event_id, lag(value, 1) OVER w AS lag1, lag(value, 3) OVER w AS lag3 FROM g WINDOW w AS (PARTITION BY sensor, run ORDER BY t, event_id)", "lag1 lag3")
def segment_safe_lags(spark, d):
    return series.segment_lags(holes(spark, d), ["sensor"], [1, 3]).select("event_id", "lag1", "lag3")


_R15 = _frame(15)


@query(
    f"""{HOLES} SELECT event_id, CASE WHEN count(value) OVER {_R15} >= 5 THEN avg(value) OVER {_R15} END AS mean, CASE WHEN count(value) OVER {_R15} >= 5 THEN stddev_samp(value) OVER {_R15} END AS std, CASE WHEN count(value) OVER {_R15} >= 5 THEN min(value) OVER {_R15} END AS min,
 CASE WHEN count(value) OVER {_R15} >= 5 THEN max(value) OVER {_R15} END AS max, value - lag(value, 14) OVER {W} AS delta FROM h""",
    "mean std min max delta",
)
def row_rolling_channel(spark, d):
    return series.row_rolling(holes(spark, d), ["sensor"], 15).select("event_id", "mean", "std", "min", "max", "delta")


@query(
    f"""{HOLES}, p AS (SELECT sensor, floor(t / {6 * H})::bigint AS step, arg_max(value, (t, event_id)) AS value FROM h WHERE value IS NOT NULL GROUP BY ALL), q AS (SELECT sensor, unnest(range(min(step), max(step) + 1)) AS step FROM p GROUP BY sensor)
SELECT q.sensor, q.step, last_value(p.value IGNORE NULLS) OVER (PARTITION BY q.sensor ORDER BY q.step) AS value FROM q LEFT JOIN p USING (sensor, step)""",
    "value",
)
def resample_ffill(spark, d):
    return series.resample_last(holes(spark, d), ["sensor"], 6 * HOUR).select("sensor", "step", "value")


@query(f"{EV} SELECT event_id, max((value > 150)::int) OVER (PARTITION BY sensor ORDER BY t RANGE BETWEEN 1 FOLLOWING AND {24 * H} FOLLOWING) AS future FROM e")
def future_window_flag(spark, d):
    return series.future_flag(events(spark, d), ["sensor"], DAY, F.col("value") > 150).select("event_id", "future")


SEG = f"""{EV}, f AS (SELECT *, value > 60 AS bad FROM e), c AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR bad <> lag(bad) OVER w OR t - lag(t) OVER w > {6 * H} THEN 1 ELSE 0 END AS c FROM f WINDOW w AS {W}),
g AS (SELECT *, sum(c) OVER {W} AS segment FROM c)"""


def flagged(spark, d):
    return events(spark, d).withColumn("bad", F.col("value") > 60)


@query(f"{SEG} SELECT sensor, segment::bigint AS segment, any_value(bad) AS bad, min(t) AS start, max(t) AS \"end\", count(*) AS rows FROM g GROUP BY sensor, segment")
def segments_gap(spark, d):
    return runs.segment_table(flagged(spark, d), ["sensor"], "bad", 6 * HOUR)


@query(
    f"""{EV}, f AS (SELECT *, value > 60 AS bad, lag(value > 60) OVER {W} AS prev FROM e) SELECT sensor, count_if(bad AND NOT coalesce(prev, false))::bigint AS runs,
coalesce(count_if(bad) / nullif(count_if(bad AND NOT coalesce(prev, false)), 0), 0) AS mean_run, count_if(coalesce(bad <> prev, false))::bigint AS switches FROM f GROUP BY sensor""",
    "mean_run",
)
def alarm_run_stats(spark, d):
    return runs.run_stats(flagged(spark, d), ["sensor"], "bad")


@query(f"{EV} SELECT event_id, CASE WHEN value >= 120 THEN 2 WHEN value >= 60 THEN 1 ELSE 0 END AS level, sum((value > 60)::int) OVER {_frame(2)} = 2 AS consecutive, sum((value > 60)::int) OVER {_frame(5)} >= 3 AS k_of_n FROM e")
def alarm_policies(spark, d):
    a = runs.consecutive(flagged(spark, d), ["sensor"], "bad", 2).withColumnRenamed("alarm", "consecutive")
    b = runs.k_of_n(a, ["sensor"], "bad", 3, 5).withColumnRenamed("alarm", "k_of_n")
    return b.select("event_id", runs.two_level(F.col("value"), 60, 120).alias("level"), "consecutive", "k_of_n")


RECURSE = EV.replace("WITH e", "WITH RECURSIVE e") + f", n AS MATERIALIZED (SELECT sensor, event_id, value, row_number() OVER {W} AS rn FROM e)"
_STEP = "CASE WHEN v >= 120 OR (s = 2 AND (v >= 102 OR (v >= 48 AND v < 60))) THEN 2 WHEN v >= 60 OR (s = 1 AND v >= 48) THEN 1 ELSE 0 END"


@query(
    f"""{RECURSE}, x AS (SELECT sensor, event_id, rn, CASE WHEN value >= 120 THEN 2 WHEN value >= 60 THEN 1 ELSE 0 END AS state FROM n WHERE rn = 1 UNION ALL
 SELECT sensor, event_id, rn, {_STEP} FROM (SELECT n.sensor, n.event_id, n.rn, n.value AS v, x.state AS s FROM x JOIN n ON n.sensor = x.sensor AND n.rn = x.rn + 1)) SELECT event_id, state FROM x"""
)
def alarm_hysteresis(spark, d):
    return runs.hysteresis(events(spark, d).select("sensor", "event_id", "t", "value"), ["sensor"], "value", 60.0, 120.0).select("event_id", "state")


@query(
    f"""{RECURSE}, x AS (SELECT sensor, event_id, rn, value AS level, value >= 80 AS alarm FROM n WHERE rn = 1 UNION ALL
 SELECT sensor, event_id, rn, level, level >= 80 OR (alarm AND level >= 50) FROM (SELECT n.sensor, n.event_id, n.rn, 0.3 * n.value + 0.7 * x.level AS level, x.alarm FROM x JOIN n ON n.sensor = x.sensor AND n.rn = x.rn + 1)) SELECT event_id, alarm FROM x"""
)
def alarm_ema(spark, d):
    return runs.ema_hysteresis(events(spark, d).select("sensor", "event_id", "t", "value"), ["sensor"], "value", 0.3, 80.0, 50.0).select("event_id", "alarm")


@query(
    f"""{SEG}, a AS (SELECT *, (row_number() OVER (PARTITION BY sensor, segment ORDER BY t, event_id)) - 1 AS pos, event_id % 10 < 3 AS w, event_id % 10 = 0 AS al FROM g),
b AS (SELECT *, coalesce(max(w::int) OVER (PARTITION BY sensor ORDER BY t RANGE BETWEEN {2 * H} PRECEDING AND 1 PRECEDING), 0) AS wb FROM a),
p AS (SELECT sensor, segment, any_value(bad) AS bad, max(w::int) AS warned, max(al::int) AS alarmed, max(CASE WHEN pos = 0 THEN wb END) AS pre, min(pos) FILTER (WHERE w) AS dr, (min(t) FILTER (WHERE w) - min(t)) / 6e7 AS dm FROM b GROUP BY ALL)
SELECT count_if(bad)::bigint AS bad_segments, avg(warned) FILTER (WHERE bad) AS warning_recall, avg(alarmed) FILTER (WHERE bad) AS alarm_recall, avg(pre) FILTER (WHERE bad) AS prewarned, avg(alarmed) FILTER (WHERE NOT bad) AS false_alarm_share,
 quantile_cont(dr, 0.5) FILTER (WHERE bad) AS median_delay_rows, quantile_cont(dm, 0.5) FILTER (WHERE bad) AS median_delay_minutes FROM p""",
    "warning_recall alarm_recall prewarned false_alarm_share median_delay_rows median_delay_minutes",
)
def segment_recall(spark, d):
    state = F.when(F.col("event_id") % 10 == 0, 2).when(F.col("event_id") % 10 < 3, 1).otherwise(0)
    return runs.evaluate_states(flagged(spark, d).withColumn("state", state), ["sensor"], "bad", "state", 6 * HOUR, 2 * HOUR)


@query(
    f"""{SEG}, a AS (SELECT *, event_id % 10 < 3 AS w FROM g), b AS (SELECT *, min(CASE WHEN w THEN t END) OVER (PARTITION BY sensor ORDER BY t RANGE BETWEEN {4 * H} PRECEDING AND 1 PRECEDING) AS f FROM a)
SELECT sensor, segment::bigint AS segment, arg_min(w, (t, event_id)) AS start_hit, (min(t) - first(f ORDER BY t, event_id)) / 6e7 AS lead_minutes FROM b WHERE bad GROUP BY sensor, segment""",
    "lead_minutes",
)
def prewarn_lead(spark, d):
    rows = flagged(spark, d).withColumn("w", F.col("event_id") % 10 < 3)
    return runs.prewarn_lead(rows, ["sensor"], "bad", "w", 6 * HOUR, 4 * HOUR)


@query(
    f"""{EV}, a AS (SELECT unit, avg(value) AS x, max(value) > 200 AS o FROM r GROUP BY unit), b AS (SELECT unit, avg(value) AS y FROM s GROUP BY unit),
j AS (SELECT o, CASE WHEN x >= 55 THEN 'alarm' WHEN y >= 50 THEN 'warning' ELSE 'normal' END AS state FROM a JOIN b USING (unit)) SELECT o AS actual, state, count(*) AS n FROM j GROUP BY ALL"""
)
def joint_states(spark, d):
    a = stream(spark, d).groupBy("unit").agg(F.avg("value").alias("now_score"), (F.max("value") > 200).alias("actual"))
    b = samples(spark, d).groupBy("unit").agg(F.avg("value").alias("future_score"))
    return runs.joint_states(a, b, "unit", 55.0, 50.0).groupBy("actual", "state").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{EV} SELECT sample_id, avg(r.value) FILTER (WHERE s.t - r.t < {H // 2}) AS seg0__mean, count(r.value) FILTER (WHERE s.t - r.t < {H // 2}) AS seg0__count, avg(r.value) FILTER (WHERE s.t - r.t >= {H // 2} AND s.t - r.t < {2 * H}) AS seg1__mean,
 count(r.value) FILTER (WHERE s.t - r.t >= {H // 2} AND s.t - r.t < {2 * H}) AS seg1__count FROM s JOIN r ON r.t BETWEEN s.t - {2 * H} AND s.t GROUP BY sample_id""",
    "seg0__mean seg1__mean",
)
def slice_segments(spark, d):
    return sweep.segment_stats(samples(spark, d), stream(spark, d), 2 * HOUR, [0, HOUR // 2, 2 * HOUR])


@query(
    f"""{SEG}, p AS (SELECT sensor, segment, any_value(bad) AS a, max((value > 90)::int) AS hit, count_if(bad AND value > 90) AS tp, count_if(NOT bad AND value > 90) AS fp, count_if(bad AND value <= 90) AS fn FROM g GROUP BY ALL)
SELECT avg(hit) FILTER (WHERE a) AS segment_recall, avg(hit) FILTER (WHERE NOT a) AS segment_false_share, sum(tp)::bigint AS tp, sum(fp)::bigint AS fp, sum(fn)::bigint AS fn FROM p""",
    "segment_recall segment_false_share",
)
def segment_hits(spark, d):
    return runs.segment_hits(flagged(spark, d).withColumn("called", F.col("value") > 90), ["sensor"], "bad", "called", 6 * HOUR)


@query(
    f"""{GAPS}, y AS (SELECT sensor, t, event_id, coalesce(l.v, f.v) AS value FROM k), a AS (SELECT *, list(value) OVER (PARTITION BY sensor ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS l FROM y),
m AS (SELECT *, list_median(l) AS m FROM a), q AS (SELECT *, 1.4826 * list_median(list_transform(l, lambda x: abs(x - m))) AS s FROM m), z AS (SELECT sensor, t, event_id, CASE WHEN abs(value - m) > 3 * s THEN m ELSE value END AS value FROM q)
SELECT event_id, coalesce((-3 * lag(value, 2) OVER w + 12 * lag(value, 1) OVER w + 17 * value + 12 * lead(value, 1) OVER w - 3 * lead(value, 2) OVER w) / 35, value) AS value FROM z WINDOW w AS {W}""",
    "value",
)
def preprocess_chain(spark, d):
    return series.preprocess(holes(spark, d), ["sensor"]).select("event_id", "value")


@query()
def fill_pchip(spark, d):
    return series.fill_pchip(holes(spark, d), ["sensor"], 2).select("event_id", "value", "filled")
