"""Queries over column screening, merges and group summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.timeline import DAY, HOUR
from tidegauge.operators import aggregates, columns, joins
from tidegauge.plans.registry import EVENTS_SQL as EV
from tidegauge.plans.registry import events, query, read, samples, stream

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber"]
LONG = "WITH l AS (" + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS feature, {c}::double AS value FROM lineitem" for c in NUMBERS) + ")"


def long_lines(spark, d, extra=()):
    df = read(spark, d, "lineitem").select(*KEYS, *NUMBERS, *extra)
    return columns.to_long(df, [*KEYS, *extra], NUMBERS)


@query(
    f"""{EV}, x AS (SELECT min(t) + {6 * HOUR} AS lo, max(t) - {6 * HOUR} AS hi FROM r) SELECT sample_id, CASE WHEN t < lo THEN 'before' WHEN t > hi THEN 'after' ELSE 'kept' END AS state FROM s, x"""
)
def stream_boundary_filter(spark, d):
    return columns.boundary_filter(samples(spark, d), stream(spark, d), 6 * HOUR).select("sample_id", "state")


PROFILE = f"""{LONG}, c AS (SELECT feature, round(value, 10) AS v, count(*) AS n, count(value) AS ok FROM l GROUP BY ALL), p AS (SELECT feature, max(n) FILTER (WHERE v IS NOT NULL) AS top, count(v) AS distinct_values FROM c GROUP BY feature),
q AS (SELECT feature, count(*) AS rows, 1 - count(value) / count(*) AS missing, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, count(value) AS ok FROM l GROUP BY feature)"""


@query(f"{PROFILE} SELECT feature, rows, missing, distinct_values AS \"distinct\", top / ok AS dominant, mean, std, min, max FROM p JOIN q USING (feature)", "missing dominant mean std min max")
def profile_columns(spark, d):
    return columns.profile(long_lines(spark, d))


@query(f"{PROFILE} SELECT feature, CASE WHEN distinct_values < 10 THEN 'constant' WHEN top / ok >= 0.1 THEN 'dominant' END AS reason FROM p JOIN q USING (feature)")
def screen_columns(spark, d):
    return columns.screen(columns.profile(long_lines(spark, d)), 0.4, 10, 0.1).select("feature", "reason")


@query("SELECT 'z_copy' AS feature, 'l_discount' AS keeper")
def duplicate_columns(spark, d):
    df = read(spark, d, "lineitem").dropDuplicates(KEYS).withColumn("z_copy", F.col("l_discount"))
    return columns.duplicate_features(columns.to_long(df, KEYS, [*NUMBERS, "z_copy"]), KEYS)


@query(
    "SELECT 'l_quantity' AS a, 'double_quantity' AS b, corr(l_quantity, 2 * l_quantity) AS corr, avg(l_quantity) AS mean_diff FROM lineitem",
    "corr mean_diff",
)
def near_duplicate_columns(spark, d):
    df = read(spark, d, "lineitem").withColumn("double_quantity", 2 * F.col("l_quantity"))
    return columns.near_duplicate_pairs(df, [*NUMBERS, "double_quantity"])


@query(
    f"""{EV}, a AS (SELECT unit, avg(value) AS main_a, count(*)::double AS main_b FROM e GROUP BY unit), b AS (SELECT unit, avg(value) + 0.001 AS extra_a, max(value) AS extra_b FROM e GROUP BY unit HAVING count(*) > 1),
m AS (SELECT unit, unnest(['main_a', 'main_b']) AS a, unnest([main_a, main_b]) AS x FROM a), n AS (SELECT unit, unnest(['extra_a', 'extra_b']) AS b, unnest([extra_a, extra_b]) AS y FROM b),
z AS (SELECT a, b, count(*) AS shared, avg((abs(x - y) <= 0.01)::int) AS agree FROM m JOIN n USING (unit) GROUP BY ALL) SELECT a, b, shared, agree FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY agree DESC, shared DESC, b) AS rn FROM z) WHERE rn = 1""",
    "agree",
)
def alias_columns(spark, d):
    e = events(spark, d)
    a = e.groupBy("unit").agg(F.avg("value").alias("main_a"), F.count(F.lit(1)).cast("double").alias("main_b"))
    b = e.groupBy("unit").agg((F.avg("value") + 0.001).alias("extra_a"), F.max("value").alias("extra_b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return columns.alias_pairs(a, b, "unit", ["main_a", "main_b"], ["extra_a", "extra_b"], 0.01)


@query(f"{LONG} SELECT feature, count(CASE WHEN value < 0.08 OR value > 20 THEN 1 END) / count(*) AS valid_ratio FROM l GROUP BY feature ORDER BY valid_ratio DESC, feature LIMIT 2", "valid_ratio")
def top_non_null_columns(spark, d):
    long = long_lines(spark, d).withColumn("value", F.when((F.col("value") < 0.08) | (F.col("value") > 20), F.col("value")))
    return columns.top_non_null(long, 2)


UNITS = f"""{EV}, a AS (SELECT unit, avg(value) AS x, count(*) AS n FROM e WHERE sensor = 'click' AND value > 30 GROUP BY unit), b AS (SELECT unit, avg(value) AS x, max(value) AS y FROM e WHERE sensor = 'view' AND value < 60 GROUP BY unit)"""


def two_tables(spark, d):
    e = events(spark, d)
    a = e.where("sensor = 'click' AND value > 30").groupBy("unit").agg(F.avg("value").alias("x"), F.count(F.lit(1)).alias("n"))
    b = e.where("sensor = 'view' AND value < 60").groupBy("unit").agg(F.avg("value").alias("x"), F.max("value").alias("y"))
    return a, b


@query(f"{UNITS} SELECT coalesce(a.unit, b.unit) AS unit, a.x, n, b.x AS x_supp, y FROM a FULL JOIN b ON a.unit = b.unit", "x x_supp y")
def outer_merge(spark, d):
    return joins.outer_merge(*two_tables(spark, d), "unit")


@query(f"{UNITS} SELECT coalesce(a.unit, b.unit) AS unit, coalesce(a.x, b.x) AS x, n, y FROM a FULL JOIN b ON a.unit = b.unit", "x y")
def combine_first(spark, d):
    return joins.combine_first(*two_tables(spark, d), "unit")


@query(f"{UNITS} SELECT unit, x FROM b UNION ALL SELECT unit, x FROM a WHERE unit NOT IN (SELECT unit FROM b)", "x")
def union_keep_last(spark, d):
    a, b = two_tables(spark, d)
    return joins.union_keep_last([a.select("unit", "x"), b.select("unit", "x")], "unit")


@query(f"{UNITS} SELECT unit FROM a INTERSECT SELECT unit FROM b")
def key_intersection(spark, d):
    return joins.common_keys(list(two_tables(spark, d)), "unit")


@query(f"{UNITS} SELECT a.unit, a.x AS a__x, n AS a__n, b.x AS b__x, y AS b__y FROM a JOIN b ON a.unit = b.unit", "a__x b__x b__y")
def align_common(spark, d):
    a, b = two_tables(spark, d)
    return joins.align_common({"a": a, "b": b}, "unit")


@query(f"{UNITS} SELECT a.unit, a.x, n, b.x AS other__x, y FROM a JOIN b ON a.unit = b.unit", "x other__x y")
def prefixed_inner(spark, d):
    return joins.prefixed_inner(*two_tables(spark, d), "unit", "other__")


@query(f"{UNITS} SELECT a.unit, 0.25 * a.x + 0.75 * b.x AS x FROM a JOIN b ON a.unit = b.unit", "x")
def weighted_blend(spark, d):
    a, b = two_tables(spark, d)
    return joins.weighted_blend({15: a, 60: b}, "unit", {15: 1.0, 60: 3.0}, ["x"])


@query(f"{UNITS} SELECT a.unit, b.x, n FROM a LEFT JOIN b ON a.unit = b.unit", "x")
def replace_columns(spark, d):
    return joins.replace_columns(*two_tables(spark, d), "unit", ["x"])


@query(f"{UNITS} SELECT a.unit, a.x, n, y FROM a JOIN b ON a.unit = b.unit WHERE y IS NOT NULL", "x y")
def attach_complete(spark, d):
    a, b = two_tables(spark, d)
    return joins.attach(a, b.drop("x"), "unit", ["y"])


@query(f"{EV} SELECT unit, floor(t / {DAY})::bigint AS day, arg_min(value, event_id) FILTER (WHERE value > 30) AS value, arg_min(sensor, event_id) FILTER (WHERE sensor <> 'view') AS sensor FROM e GROUP BY ALL", "value")
def first_non_null(spark, d):
    e = events(spark, d).withColumns({"value": F.when(F.col("value") > 30, F.col("value")), "sensor": F.when(F.col("sensor") != "view", F.col("sensor")), "day": F.floor(F.col("t") / DAY)})
    return aggregates.first_non_null(e, ["unit", "day"], ["value", "sensor"], "event_id")


@query(
    f"""{EV} SELECT unit, avg(CASE WHEN value > 40 THEN value END) AS mean, count(CASE WHEN value > 40 THEN value END) AS n, stddev_pop(CASE WHEN value > 40 THEN value END) AS std, string_agg(DISTINCT sensor, '|' ORDER BY sensor) AS tags,
count(*) AS rows, avg(t % 1000) AS ctx_mean, count(t % 1000) AS ctx_n FROM e GROUP BY unit HAVING count(CASE WHEN value > 40 THEN value END) > 0""",
    "mean std ctx_mean",
)
def repeat_group_stats(spark, d):
    e = events(spark, d).withColumns({"target": F.when(F.col("value") > 40, F.col("value")), "ctx": F.col("t") % 1000})
    return aggregates.repeat_stats(e, "unit", "target", "sensor", ["ctx"])


_Q = "quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90, min(value) AS min, max(value) AS max"


@query(f"{EV} SELECT sensor, {_Q} FROM e GROUP BY sensor", "p10 p25 median p75 p90 min max")
def range_summary(spark, d):
    return aggregates.range_summary(events(spark, d), ["sensor"], "value")


@query(
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, [l_quantity, CASE WHEN l_discount > 0.03 THEN l_discount END, l_tax] AS a FROM lineitem), f AS (SELECT *, list_filter(a, lambda x: x IS NOT NULL) AS b FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, list_avg(b) AS mean, list_stddev_samp(b) AS std, list_min(b) AS min, list_max(b) AS max FROM f""",
    "mean std min max",
)
def row_wise_stats(spark, d):
    df = read(spark, d, "lineitem").withColumn("disc", F.when(F.col("l_discount") > 0.03, F.col("l_discount")))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(n) for n, c in aggregates.row_stats(["l_quantity", "disc", "l_tax"]).items()])


@query(
    "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::double AS value, l_extendedprice AS y FROM lineitem" for c in NUMBERS if c != "l_extendedprice")
    + ") SELECT feature, count(value) AS valid, 1 - count(value) / count(*) AS missing_rate, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, corr(value, y) AS corr FROM l GROUP BY feature",
    "missing_rate mean std min max corr",
)
def feature_audit(spark, d):
    df = read(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice"))
    return aggregates.feature_audit(columns.to_long(df, ["y"], [c for c in NUMBERS if c != "l_extendedprice"]), "y")


@query(
    "WITH l AS (" + " UNION ALL ".join(f"SELECT l_returnflag AS grp, '{c}' AS feature, {c}::double AS value FROM lineitem" for c in NUMBERS)
    + "), o AS (SELECT feature, avg(value) AS overall FROM l GROUP BY feature), x AS (SELECT grp, feature, avg(value) - any_value(overall) AS shift FROM l JOIN o USING (feature) GROUP BY ALL), z AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(shift) DESC, feature) AS rank FROM x) SELECT l.* FROM z l WHERE rank <= 2",
    "shift",
)
def group_shifts(spark, d):
    long = columns.to_long(read(spark, d, "lineitem").withColumn("grp", F.col("l_returnflag")), ["grp"], NUMBERS)
    return aggregates.group_shifts(long, "grp", 2)


RANK = "(rank() OVER (PARTITION BY {p} ORDER BY {c}) + (count(*) OVER (PARTITION BY {p}, {c}) - 1) / 2.0)"


@query(
    f"{EV}, k AS (SELECT sensor, floor(value) AS x, unit AS y FROM e), a AS (SELECT sensor, {RANK.format(p='sensor', c='x')} AS rx, {RANK.format(p='sensor', c='y')} AS ry FROM k) SELECT sensor, count(*) AS n, corr(rx, ry) AS spearman FROM a GROUP BY sensor",
    "spearman",
)
def spearman(spark, d):
    return aggregates.spearman(events(spark, d).select("sensor", F.floor("value").alias("x"), F.col("unit").alias("y")), ["sensor"], "x", "y")


@query(
    f"""{EV}, k AS (SELECT sensor AS feature, floor(t / {5 * DAY})::bigint AS split, value AS x, unit AS y FROM e), c AS (SELECT feature, split, corr(x, y) AS spearman FROM k GROUP BY ALL)
SELECT feature, min(spearman) AS low, max(spearman) AS high, concat_ws(';', CASE WHEN min(spearman) < 0 AND max(spearman) > 0 THEN 'sign_flip' END, CASE WHEN max(spearman) - min(spearman) > 0.1 THEN 'wide_range' END) AS reasons FROM c GROUP BY feature""",
    "low high",
)
def split_stability(spark, d):
    e = events(spark, d).select(F.col("sensor").alias("feature"), F.floor(F.col("t") / (5 * DAY)).alias("split"), "value", "unit")
    return aggregates.stability(e.groupBy("feature", "split").agg(F.corr("value", "unit").alias("spearman")), max_range=0.1)


@query(f"{EV}, g AS (SELECT sensor, (t - lag(t) OVER (PARTITION BY sensor ORDER BY t)) / 6e7 AS gap FROM e) SELECT sensor, quantile_cont(gap, 0.1) AS p10, quantile_cont(gap, 0.5) AS median, quantile_cont(gap, 0.9) AS p90 FROM g GROUP BY sensor", "p10 median p90")
def interarrival_quantiles(spark, d):
    return aggregates.interarrival(events(spark, d), ["sensor"])


@query(
    f"""{EV}, w AS (SELECT width, s.sample_id, count(r.event_id) AS n FROM (VALUES (30), (60), (120)) AS v(width), s LEFT JOIN r ON r.t BETWEEN s.t - width * 60000000::bigint AND s.t GROUP BY ALL)
SELECT width, avg((n >= 5)::int) AS share FROM w GROUP BY width""",
    "share",
)
def window_coverage(spark, d):
    from tidegauge.operators.sweep import multi_window

    s = samples(spark, d)
    counts = s.select("sample_id").join(multi_window(s, stream(spark, d), [30, 60, 120], ["count"]), "sample_id", "left")
    long = counts.select(F.inline(F.array(*[F.struct(F.lit(w).alias("width"), F.coalesce(f"w{w}__count", F.lit(0)).alias("n")) for w in (30, 60, 120)])))
    return long.groupBy("width").agg(F.avg((F.col("n") >= 5).cast("int")).alias("share"))


SHARES = f"""{EV}, w AS (SELECT unit, floor(t / {7 * DAY})::bigint AS week, sum(value) AS w FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY w DESC, week) AS rn FROM w),
h AS (SELECT unit, week, w / sum(w) OVER (PARTITION BY unit) AS share FROM k WHERE rn <= 3), c AS (SELECT max(floor(t / {7 * DAY})::bigint) AS now FROM e)"""


@query(
    f"""{SHARES} SELECT unit, coalesce(sum(share) FILTER (WHERE week = now), 0) AS share_now, coalesce(sum(share) FILTER (WHERE week = now - 1), 0) AS share_before,
sum(share) - coalesce(sum(share) FILTER (WHERE week = now), 0) - coalesce(sum(share) FILTER (WHERE week = now - 1), 0) AS share_older FROM h, c GROUP BY unit, now""",
    "share_now share_before share_older",
)
def weighted_share_by_week(spark, d):
    e = events(spark, d).withColumn("week", F.floor(F.col("t") / (7 * DAY)))
    now = F.broadcast(e.agg(F.max("week").alias("now")))
    shares = aggregates.weighted_shares(e, ["unit"], "week", "value", 3, order=["event_id"]).crossJoin(now)
    return shares.select("unit", *[c.alias(n) for n, c in aggregates.period_shares(F.col("shares"), F.col("now"), F.col("now") - 1).items()])


ROBUST = f"""{EV}, m AS (SELECT sensor, quantile_cont(value, 0.5) AS median, stddev_pop(value) AS sd FROM e GROUP BY sensor), a AS (SELECT e.sensor, quantile_cont(abs(value - median), 0.5) AS mad FROM e JOIN m USING (sensor) GROUP BY e.sensor),
ref AS (SELECT sensor, median, mad, CASE WHEN mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd ELSE 1 END AS scale FROM m JOIN a USING (sensor)),
sc AS (SELECT unit, quantile_cont(least(abs(value - median) / scale, 20), 0.5) AS shift FROM e JOIN ref USING (sensor) GROUP BY unit)"""


@query(f"{ROBUST} SELECT * FROM ref", "median mad scale")
def robust_reference(spark, d):
    return aggregates.robust_reference(events(spark, d), "sensor")


@query(f"{ROBUST} SELECT * FROM sc", "shift")
def shift_scores(spark, d):
    e = events(spark, d)
    return aggregates.shift_scores(e, aggregates.robust_reference(e, "sensor"), "unit", "sensor")


@query(
    f"""{ROBUST}, k AS (SELECT *, unit % 7 AS period FROM sc), q AS (SELECT quantile_cont(shift, 0.9) AS p90, quantile_cont(shift, 0.95) AS p95 FROM k WHERE unit % 2 = 0), p AS (SELECT period, quantile_cont(shift, 0.5) AS period_median FROM k GROUP BY period)
SELECT unit, period, shift, period_median, p90, p95, CASE WHEN shift >= p95 THEN 'low' WHEN shift >= p90 THEN 'medium' ELSE 'high' END AS confidence FROM k JOIN p USING (period), q""",
    "shift period_median p90 p95",
)
def drift_flags(spark, d):
    e = events(spark, d)
    scored = aggregates.shift_scores(e, aggregates.robust_reference(e, "sensor"), "unit", "sensor").withColumn("period", F.col("unit") % 7)
    return aggregates.drift_flags(scored, F.col("unit") % 2 == 0, "period")


@query(
    f"{EV} SELECT sensor, count(*) AS n, avg(abs(value - 50)) AS mae, quantile_cont(abs(value - 50), 0.5) AS median_error, quantile_cont(abs(value - 50), 0.9) AS p90_error, max(abs(value - 50)) AS max_error, avg((value BETWEEN 20 AND 80)::int) AS coverage FROM e GROUP BY sensor",
    "mae median_error p90_error max_error coverage",
)
def accuracy_summary(spark, d):
    e = events(spark, d).withColumns({"err": F.col("value") - 50, "inside": F.col("value").between(20, 80)})
    return aggregates.accuracy_summary(e, ["sensor"], "err", "inside")


@query(f"{EV} SELECT unit % 10 AS grp, avg(value) FILTER (WHERE sensor = 'click') AS click, avg(value) FILTER (WHERE sensor = 'view') AS \"view\" FROM e GROUP BY grp", "click \"view\"")
def pivot_period_type(spark, d):
    return aggregates.pivot_mean(events(spark, d).withColumn("grp", F.col("unit") % 10), "grp", "sensor", "value", ["click", "view"])


@query(
    f"""{EV}, f AS (SELECT sensor || '__' || (unit % 4) AS feature, sensor, avg(value) AS score FROM e GROUP BY ALL)
SELECT sensor, count(*) AS n, arg_max(feature, (score, feature)) AS best, max(score) AS max_score, avg(score) AS mean_score, quantile_cont(score, 0.5) AS median_score FROM f GROUP BY sensor""",
    "max_score mean_score median_score",
)
def score_roll_up(spark, d):
    e = events(spark, d).groupBy(F.concat_ws("__", "sensor", F.col("unit") % 4).alias("feature"), "sensor").agg(F.avg("value").alias("score"))
    return aggregates.roll_up_scores(e, "sensor")
