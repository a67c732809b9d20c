"""Queries over labels, probability algebra, conformal sets and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import decide, labels
from tidegauge.operators import metrics, ranking
from tidegauge.plans.registry import EVENTS_SQL as EV
from tidegauge.plans.registry import events, query, read

CUTS = (20.0, 40.0, 60.0, 90.0)
NAMES = ("b1", "b2", "b3", "b4", "b5")
BUSINESS = ("acceptable", "acceptable", "acceptable", "warning", "unacceptable")


def _band(v, names):
    return "CASE " + " ".join(f"WHEN {v} < {c} THEN '{n}'" for c, n in zip(CUTS, names, strict=False)) + f" ELSE '{names[-1]}' END"


@query(
    f"""SELECT event_id, {_band('value', NAMES)} AS hard, {_band('value', BUSINESS)} AS business, (value < 20)::int AS target_lt_0, (value < 40)::int AS target_lt_1, (value < 60)::int AS target_lt_2, (value < 90)::int AS target_lt_3,
 least(abs(value - 20), abs(value - 40), abs(value - 60), abs(value - 90)) <= 1.5 AS boundary, value > 60 AS is_above, value < 40 AS is_below, value > 60 OR value < 40 AS is_out, value BETWEEN 40 AND 60 AS is_in,
 CASE WHEN value < 40 THEN 'below' WHEN value > 60 THEN 'above' ELSE 'in' END AS status, CASE WHEN value >= 0 AND value <= 10 THEN 0 WHEN value > 10 AND value <= 50 THEN 1 WHEN value > 50 AND value <= 100 THEN 2 END AS cut FROM events"""
)
def labels_ordinal(spark, d):
    v = F.col("value")
    made = {
        "hard": labels.band_label(v, CUTS, NAMES),
        "business": labels.band_label(v, CUTS, BUSINESS),
        **labels.cumulative_targets(v, CUTS),
        "boundary": labels.boundary_flag(v, CUTS, 1.5),
        **labels.spec_flags(v, 50.0, 10.0),
        "status": labels.status(v, 40.0, 60.0),
        "cut": labels.cut_label(v, [0.0, 10.0, 50.0, 100.0]),
    }
    return read(spark, d, "events").select("event_id", *[c.alias(n) for n, c in made.items()])


_GRID = "list_transform(range(0, 21), lambda i: {f})"
_O = "(value + (-5 + i * 0.5))"
_BELL = f"1 / (1 + pow(abs({_O} - 50) / 20, 4))"
_SOFT = "least(greatest(((20 - abs(value - 50)) / 8 + 1) / 2, 0), 1)"


@query(
    f"""SELECT event_id, greatest(0, least(1, 1 - abs(value - 50) / 20)) AS point, list_avg({_GRID.format(f=f'greatest(0, least(1, 1 - abs({_O} - 50) / 20))')}) AS uncertain, 1 / (1 + pow(abs(value - 50) / 20, 4)) AS bell,
 list_avg({_GRID.format(f=_BELL)}) AS bell_mean, list_stddev_pop({_GRID.format(f=_BELL)}) AS bell_std, exp(-pow(value - 50, 2) / 200) AS gaussian, greatest(0, least(value + 5, 60) - greatest(value - 5, 40)) / 10 AS pass,
 1 / (1 + exp(-(20 - abs(value - 50)) / 8)) AS logistic, (tanh((20 - abs(value - 50)) / 8) + 1) / 2 AS tanh, {_SOFT} AS linear, {_SOFT} * {_SOFT} * (3 - 2 * {_SOFT}) AS smoothstep FROM events""",
    "point uncertain bell bell_mean bell_std gaussian pass logistic tanh linear smoothstep",
)
def desirability_family(spark, d):
    v = F.col("value")
    mean, std = labels.bell_uncertain(v, 50.0, 20.0, 4.0, 5.0)
    made = {
        "point": labels.desirability(v, 50.0, 20.0),
        "uncertain": labels.label_by_method("uncertain", v, 50.0, 20.0, 5.0),
        "bell": labels.bell(v, 50.0, 20.0, 4.0),
        "bell_mean": mean,
        "bell_std": std,
        "gaussian": labels.gaussian(v, 50.0, 10.0),
        "pass": labels.interval_pass(v, 40.0, 60.0, 5.0),
        **{r: labels.soft_membership(v, 50.0, 20.0, 8.0, r) for r in ("logistic", "tanh", "linear", "smoothstep")},
    }
    return read(spark, d, "events").select("event_id", *[c.alias(n) for n, c in made.items()])


def _above(c):
    return f"least(greatest((value - {c}) / 10 + 0.5, 0), 1)"


_MASS = "[" + ", ".join([f"1 - {_above(20)}", f"{_above(20)} - {_above(40)}", f"{_above(40)} - {_above(60)}", f"{_above(60)} - {_above(90)}", _above(90)]) + "]"


@query(f"WITH m AS (SELECT event_id, unnest(range(0, 5))::int AS bin, unnest({_MASS}) AS mass FROM events) SELECT * FROM m WHERE mass > 0", "mass")
def soft_bins_exploded(spark, d):
    rows = read(spark, d, "events").select("event_id", F.posexplode(labels.soft_bins(F.col("value"), CUTS, 5.0)).alias("bin", "mass"))
    return rows.where("mass > 0")


@query(
    """SELECT event_id, CASE WHEN least(abs(value - 20), abs(value - 60)) <= 2 THEN 3.0 ELSE 1.0 END * CASE WHEN value > 90 THEN 2.0 ELSE 1.0 END AS boundary_w, 1 + 1.5 * greatest(0, least(1, 1 - least(abs(value - 20), abs(value - 60)) / 8)) AS close_w,
 greatest(0.1, exp(-pow((user_id % 5) / 4, 2))) AS repeat_w FROM events""",
    "boundary_w close_w repeat_w",
)
def sample_weights(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select(
        "event_id",
        labels.boundary_weight(v, (20.0, 60.0), 2.0, 3.0, v > 90, 2.0).alias("boundary_w"),
        labels.closeness_weight(v, (20.0, 60.0), 8.0, 1.5).alias("close_w"),
        labels.repeat_weight((F.col("user_id") % 5).cast("double"), 4.0, 0.1).alias("repeat_w"),
    )


#: Pseudo scores out of the ids: four cumulative probabilities that are not monotone.
P_SQL = "SELECT event_id, value, ((event_id * 37) % 101) / 250.0::double AS c0, ((event_id * 53) % 103) / 150.0::double AS c1, ((event_id * 71) % 107) / 120.0::double AS c2, ((event_id * 91) % 109) / 110.0::double AS c3 FROM events"
BINS_SQL = f"""WITH p AS ({P_SQL}), m AS (SELECT event_id, value, least(c0, 1) AS m0, least(greatest(c0, c1), 1) AS m1, least(greatest(c0, c1, c2), 1) AS m2, least(greatest(c0, c1, c2, c3), 1) AS m3 FROM p),
b AS (SELECT event_id, value, m0, m1, m2, m3, [m0, m1 - m0, m2 - m1, m3 - m2, 1 - m3] AS p FROM m)"""


def scores(spark, d):
    i = F.col("event_id")
    parts = {f"c{k}": (i * a % b) / F.lit(float(s)) for k, (a, b, s) in enumerate(((37, 101, 250), (53, 103, 150), (71, 107, 120), (91, 109, 110)))}
    return read(spark, d, "events").select("event_id", "value", *[c.alias(n) for n, c in parts.items()])


def bins(spark, d):
    m = decide.monotone([F.col(f"c{k}") for k in range(4)])
    df = scores(spark, d).select("event_id", "value", *[c.alias(f"m{k}") for k, c in enumerate(m)])
    return df.withColumn("p", decide.interval_probabilities([F.col(f"m{k}") for k in range(4)]))


_ARGMAX = "['b1', 'b2', 'b3', 'b4', 'b5'][list_position(p, list_max(p))]"


@query(
    f"{BINS_SQL} SELECT event_id, m0, m1, m2, m3, p[1] AS p1, p[5] AS p5, p[1] + p[2] + p[3] AS acceptable, p[4] AS warning, p[5] AS unacceptable, {_ARGMAX} AS best FROM b",
    "m0 m1 m2 m3 p1 p5 acceptable warning unacceptable",
)
def interval_probabilities(spark, d):
    df = bins(spark, d)
    a, w, u = decide.merged_classes(F.col("p"), [(0, 1, 2), (3,), (4,)])
    return df.select("event_id", "m0", "m1", "m2", "m3", F.get("p", F.lit(0)).alias("p1"), F.get("p", F.lit(4)).alias("p5"), a.alias("acceptable"), w.alias("warning"), u.alias("unacceptable"), decide.first_max(F.col("p"), NAMES).alias("best"))


_ENT = "-list_sum(list_transform(p, lambda x: greatest(least(x, 1), 1e-12) * ln(greatest(least(x, 1), 1e-12)))) / ln(5)"


@query(
    f"""{BINS_SQL} SELECT event_id, {_ENT} AS entropy, CASE WHEN list_max(p) < 0.4 OR {_ENT} > 0.9 THEN 'retest' ELSE {_ARGMAX} END AS rejecting,
 CASE WHEN p[4] >= 0.2 AND greatest(p[1], p[4], p[5]) - p[4] <= 0.1 THEN 'warning' ELSE ['acceptable', 'warning', 'unacceptable'][list_position([p[1], p[4], p[5]], greatest(p[1], p[4], p[5]))] END AS flipped FROM b WHERE abs({_ENT} - 0.9) > 1e-9 AND abs(greatest(p[1], p[4], p[5]) - p[4] - 0.1) > 1e-9 AND abs(p[4] - 0.2) > 1e-9""",
    "entropy",
)
def reject_and_boundary(spark, d):
    p = F.col("p")
    three = [F.get(p, F.lit(i)) for i in (0, 3, 4)]
    out = bins(spark, d).select(
        "event_id",
        decide.normalised_entropy(p).alias("entropy"),
        decide.reject_rule(p, NAMES, 0.4, 0.9).alias("rejecting"),
        decide.boundary_policy(three, ("acceptable", "warning", "unacceptable"), 1, 0.2, 0.1).alias("flipped"),
        (F.greatest(*three) - three[1]).alias("_gap"),
        three[1].alias("_w"),
    )
    return out.where((F.abs(F.col("entropy") - 0.9) > 1e-9) & (F.abs(F.col("_gap") - 0.1) > 1e-9) & (F.abs(F.col("_w") - 0.2) > 1e-9)).drop("_gap", "_w")


@query(
    f"""WITH p AS ({P_SQL}), g AS (SELECT *, CASE WHEN c0 < 0.2 AND (c1 > 0.5 OR c2 > 0.6) THEN 0.2 ELSE c0 END AS guarded FROM p)
SELECT event_id, CASE WHEN c0 >= 0.3 THEN 'low_risk' WHEN c3 >= 0.8 THEN 'high_risk' WHEN c1 >= 0.4 THEN 'premium' ELSE 'acceptable' END AS decision, guarded, CASE WHEN guarded >= 0.2 AND guarded < 0.35 THEN 0.2 + (0.35 - 0.2 - 1e-6) * c1 ELSE guarded END AS ranked FROM g""",
    "guarded ranked",
)
def decision_cascade(spark, d):
    c = [F.col(f"c{k}") for k in range(4)]
    rule = decide.cascade([(c[0] >= 0.3, "low_risk"), (c[3] >= 0.8, "high_risk"), (c[1] >= 0.4, "premium")], "acceptable")
    g = scores(spark, d).withColumn("guarded", decide.low_risk_guardrail(c[0], c[1], c[2], 0.2, 0.5, 0.6))
    return g.select("event_id", rule.alias("decision"), "guarded", decide.mid_rank(F.col("guarded"), c[1], 0.2, 0.35).alias("ranked"))


@query(
    f"""WITH p AS ({P_SQL}), r AS (SELECT *, CASE WHEN event_id % 11 = 0 OR c1 > 0.6 THEN 'static' WHEN c2 >= 0.6 THEN 'local' WHEN c2 >= 0.3 THEN 'blend' ELSE 'static' END AS route FROM p)
SELECT event_id, route, CASE route WHEN 'local' THEN 1 WHEN 'blend' THEN least(greatest((c2 - 0.3) / 0.3, 0), 1) ELSE 0 END AS weight, CASE WHEN value > 200 THEN 'quality_anomaly' WHEN c3 >= 0.9 THEN 'high' WHEN c3 >= 0.7 THEN 'medium' ELSE 'low' END AS drift FROM r""",
    "weight",
)
def dynamic_route(spark, d):
    df = scores(spark, d)
    route, weight = decide.dynamic_route(F.col("c2"), F.col("c1"), F.col("event_id") % 11 == 0, 0.6, 0.3, 0.6)
    return df.select("event_id", route.alias("route"), weight.alias("weight"), decide.drift_label(F.col("c3"), F.lit(0.7), F.lit(0.9), F.col("value") > 200).alias("drift"))


_SORTED = "list_sort(list_transform(range(1, 6), lambda i: {'m': -p[i], 'i': i - 1}))"


@query(
    f"""{BINS_SQL}, o AS (SELECT event_id, event_id % 5 AS y, {_SORTED} AS o FROM b), k AS (SELECT *, list_position(list_transform(o, lambda x: x.i), y) AS k FROM o)
SELECT event_id, -list_sum(list_transform(o[1:k], lambda x: x.m)) AS score, array_to_string(list_transform(list_filter(list_transform(range(1, 6), lambda j: {{'i': o[j].i, 'b': coalesce(-list_sum(list_transform(o[1:j - 1], lambda x: x.m)), 0)}}), lambda x: x.b < 0.7), lambda x: x.i), '|') AS members FROM k""",
    "score",
)
def aps_sets(spark, d):
    p = F.col("p")
    return bins(spark, d).select("event_id", decide.aps_score(p, (F.col("event_id") % 5).cast("int")).alias("score"), F.array_join(decide.aps_set(p, F.lit(0.7)).cast("array<string>"), "|").alias("members"))


def _grown(before: str) -> str:
    """One step of growth of the interval a..b (from 0) with the mass m."""
    low, high = "CASE WHEN a > 0 THEN p[a] ELSE -1 END", "CASE WHEN b < 4 THEN p[b + 2] ELSE -1 END"
    step = f"SELECT *, {low} AS low, {high} AS high FROM ({before})"
    step = f"SELECT *, m < 0.7 AND (low >= 0 OR high >= 0) AS more FROM ({step})"
    return f"SELECT event_id, p, a - (more AND low >= high)::int AS a, b + (more AND low < high)::int AS b, CASE WHEN more THEN m + greatest(low, high) ELSE m END AS m FROM ({step})"


_MODE = "SELECT event_id, p, list_position(p, list_max(p)) - 1 AS a, list_position(p, list_max(p)) - 1 AS b, list_max(p) AS m FROM b"


@query(f"{BINS_SQL} SELECT event_id, array_to_string(range(a, b + 1), '|') AS members FROM ({_grown(_grown(_grown(_grown(_MODE))))})")
def ordered_interval_sets(spark, d):
    got = decide.ordered_interval([F.get("p", F.lit(i)) for i in range(5)], F.lit(0.7))
    return bins(spark, d).select("event_id", F.array_join(got.cast("array<string>"), "|").alias("members"))


@query(
    f"""{BINS_SQL}, t AS (SELECT event_id, p, list_filter([0, 1, 2, 3, 4], lambda i: 1 - p[i + 1] <= [0.6, 0.7, 0.75, 0.8, 0.85][i + 1]) AS own FROM b), q AS (SELECT event_id, CASE WHEN len(own) > 0 THEN own ELSE [list_position(p, list_max(p)) - 1] END AS own FROM t),
z AS (SELECT event_id, own, list_distinct(list_transform(own, lambda i: ['acceptable', 'acceptable', 'acceptable', 'warning', 'unacceptable'][i + 1])) AS names FROM q)
SELECT event_id, array_to_string(own, '|') AS members, CASE WHEN len(names) = 1 THEN names[1] ELSE 'retest' END AS decision, CASE WHEN len(names) = 1 THEN names[1] WHEN len(names) = 2 AND list_contains(names, 'warning') THEN 'warning' ELSE 'retest' END AS guarded FROM z"""
)
def class_conditional_sets(spark, d):
    own = decide.class_set(F.col("p"), F.array(*map(F.lit, (0.6, 0.7, 0.75, 0.8, 0.85))))
    rows = bins(spark, d).select("event_id", own.alias("own")).withColumn("names", decide.business_set(F.col("own"), BUSINESS))
    return rows.select("event_id", F.array_join(F.col("own").cast("array<string>"), "|").alias("members"), decide.operational_decision(F.col("names")).alias("decision"), decide.operational_decision(F.col("names"), True).alias("guarded"))


#: A score in [0, 1] with many ties, and a label that leans on it.
SC = f"{EV}, z AS (SELECT event_id, sensor, unit, t, least(floor(value) / 100.0, 1.0)::double AS score, (value + (event_id * 7919) % 60) > 90 AS y FROM e)"


def scored(spark, d):
    v, i = F.col("value"), F.col("event_id")
    return events(spark, d).select("event_id", "sensor", "unit", "t", F.least(F.floor(v) / 100.0, F.lit(1.0)).alias("score"), (v + (i * 7919) % 60 > 90).alias("y"))


@query(f"{SC}, c AS (SELECT sensor, ceil((count(*) + 1) * 0.9)::bigint AS k, count(*) AS n FROM z GROUP BY sensor), rk AS (SELECT sensor, score, row_number() OVER (PARTITION BY sensor ORDER BY score) AS rn FROM z) SELECT sensor, score AS qhat, n FROM rk JOIN c USING (sensor) WHERE rn = least(k, n)", "qhat")
def conformal_quantile(spark, d):
    return metrics.conformal_quantile(scored(spark, d), "score", 0.1, ["sensor"])


_F1 = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"


SWEEP_SQL = f"""{SC}, g AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS threshold), c AS (SELECT threshold, count_if(y AND score >= threshold) AS tp, count_if(NOT y AND score >= threshold) AS fp, count_if(y AND score < threshold) AS fn, count_if(NOT y AND score < threshold) AS tn FROM z, g GROUP BY threshold)
SELECT threshold::double AS threshold, tp::bigint AS tp, fp::bigint AS fp, fn::bigint AS fn, tn::bigint AS tn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, {_F1} AS f1, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr, (tp + fp) / (tp + fp + tn + fn) AS alarm_rate FROM c"""


@query(SWEEP_SQL, "threshold precision recall f1 fpr alarm_rate")
def confusion_sweep(spark, d):
    return metrics.threshold_sweep(scored(spark, d), "y", "score", [0.2, 0.4, 0.6, 0.8])


CURVE = f"""{SC}, v AS (SELECT sensor, score, count_if(y) AS p, count_if(NOT y) AS n FROM z GROUP BY ALL), cv AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY sensor) AS pos, sum(n) OVER (PARTITION BY sensor) AS neg FROM v WINDOW w AS (PARTITION BY sensor ORDER BY score DESC))"""


@query(f"{CURVE} SELECT sensor, score, tp / (tp + fp) AS precision, tp / pos AS recall FROM cv", "score precision recall")
def pr_curve(spark, d):
    return metrics.pr_curve(scored(spark, d), "y", "score", ["sensor"])


_R = "(rank() OVER (PARTITION BY sensor ORDER BY score) + (count(*) OVER (PARTITION BY sensor, score) - 1) / 2.0)"


@query(
    f"""{CURVE}, k AS (SELECT sensor, y, {_R} AS r FROM z), a AS (SELECT sensor, (sum(r) FILTER (WHERE y) - count_if(y) * (count_if(y) + 1) / 2.0) / (count_if(y) * count_if(NOT y)) AS auc FROM k GROUP BY sensor),
ap AS (SELECT sensor, sum(p / pos * (tp / (tp + fp))) AS ap FROM cv GROUP BY sensor) SELECT sensor, count(*) AS rows, count_if(y)::bigint AS positives, any_value(auc) AS auc, any_value(ap) AS ap, avg(pow(score - y::int, 2)) AS brier FROM z JOIN a USING (sensor) JOIN ap USING (sensor) GROUP BY sensor""",
    "auc ap brier",
)
def ranked_metrics(spark, d):
    return metrics.ranked_metrics(scored(spark, d), "y", "score", ["sensor"])


BEST = f"{CURVE}, f AS (SELECT sensor, score, 2.0 * tp / (tp + fp + pos) AS f1, tp / pos AS recall, tp / (tp + fp) AS precision FROM cv)"


@query(f"{BEST} SELECT sensor, score AS threshold, f1, recall FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY f1 DESC, recall DESC, score) AS rn FROM f) WHERE rn = 1", "threshold f1 recall")
def best_f1_threshold(spark, d):
    return metrics.best_f1(scored(spark, d), "y", "score", ["sensor"])


@query(
    f"""{BEST}, a AS (SELECT sensor, first(score ORDER BY f1 DESC, recall DESC, score) AS best_f1, first(score ORDER BY sqrt(pow(precision - 0.8, 2) + pow(recall - 0.8, 2)), score) AS closest FROM f GROUP BY sensor),
b AS (SELECT sensor, first(score ORDER BY precision DESC, recall DESC, score) AS best_precision FROM f WHERE recall >= 0.8 GROUP BY sensor) SELECT sensor, best_f1, best_precision, closest FROM a LEFT JOIN b USING (sensor)""",
    "best_f1 best_precision closest",
)
def curve_choices(spark, d):
    return ranking.best_curve_points(metrics.pr_curve(scored(spark, d), "y", "score", ["sensor"]), ["sensor"])


_BEST_CUT = "first(cut ORDER BY 2.0 * tp / (tp + fp + pos) DESC, tp / pos DESC, cut)"
_AT_CUT = "count_if(y AND score >= cut) AS tp, count_if(NOT y AND score >= cut) AS fp, count_if(y) AS pos"


@query(
    f"""{SC}, v AS (SELECT * FROM z WHERE event_id % 2 = 0),
o AS (SELECT sensor, {_BEST_CUT} AS own FROM (SELECT sensor, cut, {_AT_CUT} FROM v JOIN (SELECT DISTINCT sensor, score AS cut FROM v) USING (sensor) GROUP BY sensor, cut)
  WHERE sensor IN (SELECT sensor FROM v GROUP BY sensor HAVING count(*) >= 100 AND count_if(y) >= 10 AND count_if(NOT y) >= 10) GROUP BY sensor),
a AS (SELECT {_BEST_CUT} AS overall FROM (SELECT cut, {_AT_CUT} FROM v, (SELECT DISTINCT score AS cut FROM v) GROUP BY cut)),
t AS (SELECT sensor, y, score, coalesce(own, overall) AS cut FROM z LEFT JOIN o USING (sensor), a WHERE event_id % 2 = 1),
c AS (SELECT sensor, max(cut) AS threshold, count_if(y AND score >= cut) AS tp, count_if(NOT y AND score >= cut) AS fp, count_if(y AND score < cut) AS fn, count_if(NOT y AND score < cut) AS tn FROM t GROUP BY sensor)
SELECT sensor, threshold, tp::bigint AS tp, fp::bigint AS fp, fn::bigint AS fn, tn::bigint AS tn, {_F1} AS f1 FROM c""",
    "threshold f1",
)
def group_thresholds(spark, d):
    rows = scored(spark, d)
    return metrics.group_thresholds(rows, "y", "score", "sensor", F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1, 100, 10)


@query(
    f"{SC}, q AS (SELECT sensor, score * 100 AS p, ((event_id * 31) % 97)::double AS v FROM z), rk AS (SELECT *, (rank() OVER (PARTITION BY sensor ORDER BY p) + (count(*) OVER (PARTITION BY sensor, p) - 1) / 2.0) AS rp, (rank() OVER (PARTITION BY sensor ORDER BY v) + (count(*) OVER (PARTITION BY sensor, v) - 1) / 2.0) AS rv FROM q) SELECT sensor, count(*) AS n, avg(abs(v - p)) AS mae, sqrt(avg(pow(v - p, 2))) AS rmse, corr(rv, rp) AS spearman FROM rk GROUP BY sensor",
    "mae rmse spearman",
)
def regression_metrics(spark, d):
    rows = scored(spark, d).select("sensor", (F.col("score") * 100).alias("p"), (F.col("event_id") * 31 % 97).cast("double").alias("v"))
    return metrics.regression_metrics(rows, "v", "p", ["sensor"])


@query(
    f"""WITH x AS (SELECT {_band('value', NAMES)} AS a, {_band('(value + (event_id * 13) % 30)', NAMES)} AS b FROM events), c AS (SELECT DISTINCT a AS c FROM x UNION SELECT DISTINCT b FROM x), m AS (SELECT c, (SELECT count(*) FROM x WHERE a = c) AS s, (SELECT count(*) FROM x WHERE b = c) AS k, (SELECT count(*) FROM x WHERE a = c AND b = c) AS h FROM c)
SELECT avg(2.0 * h / (s + k)) AS macro_f1, avg(h / s) FILTER (WHERE s > 0) AS balanced_accuracy, sum(2.0 * h / (s + k) * s) / sum(s) AS weighted_f1, sum(h) / sum(s) AS accuracy FROM m""",
    "macro_f1 balanced_accuracy weighted_f1 accuracy",
)
def multiclass_metrics(spark, d):
    v = F.col("value")
    rows = read(spark, d, "events").select(labels.band_label(v, CUTS, NAMES).alias("a"), labels.band_label(v + (F.col("event_id") * 13) % 30, CUTS, NAMES).alias("b"))
    return metrics.multiclass_metrics(rows, "a", "b")


@query(
    f"{BINS_SQL}, q AS (SELECT p, {_MASS} AS q FROM b) SELECT avg(list_sum(list_transform(range(1, 6), lambda i: pow(p[i] - q[i], 2)))) AS brier, avg(list_sum(list_transform(range(1, 6), lambda i: -q[i] * ln(greatest(1e-15, least(p[i], 1 - 1e-15)))))) AS entropy FROM q",
    "brier entropy",
)
def soft_target_scores(spark, d):
    brier, entropy = metrics.soft_scores(F.col("p"), labels.soft_bins(F.col("value"), CUTS, 5.0))
    return bins(spark, d).agg(F.avg(brier).alias("brier"), F.avg(entropy).alias("entropy"))


@query(f"{SC}, b AS (SELECT least(floor(score * 10), 9)::int AS bin, score, y FROM z) SELECT bin, count(*) AS n, avg(y::int) AS observed, avg(score) AS predicted FROM b GROUP BY bin", "observed predicted")
def reliability_bins(spark, d):
    return metrics.calibration_bins(scored(spark, d), "y", "score")


@query(f"{SC}, b AS (SELECT least(floor(score * 10), 9)::int AS bin, count(*) AS n, avg(y::int) AS o, avg(score) AS p FROM z GROUP BY ALL) SELECT sum(n * abs(o - p)) / sum(n) AS ece FROM b", "ece")
def ece_equal_width(spark, d):
    return metrics.calibration_error(scored(spark, d), "y", "score")


@query(
    f"{SC}, k AS (SELECT sensor, score, y, row_number() OVER (PARTITION BY sensor ORDER BY score, event_id) AS rn, count(*) OVER (PARTITION BY sensor) AS n FROM z), b AS (SELECT *, greatest(0, ceil((rn - 1) * 5 / (n - 1)) - 1)::int AS bin FROM k) SELECT sensor, bin, count(*) AS n, avg(y::int) AS observed, avg(score) AS predicted FROM b GROUP BY sensor, bin",
    "observed predicted",
)
def reliability_qcut(spark, d):
    return metrics.calibration_quantiles(scored(spark, d), "y", "score", "event_id", 5, ["sensor"])


@query(f"{SC} SELECT avg((score < 0.3)::int) AS low_rate, avg((score >= 0.7)::int) AS high_rate, avg((score >= 0.3 AND score < 0.7)::int) AS retest_rate, count_if(y AND score < 0.3) / count_if(y) AS false_clear FROM z", "low_rate high_rate retest_rate false_clear")
def risk_rates(spark, d):
    return metrics.risk_metrics(scored(spark, d), "y", "score", 0.3, 0.7)


@query(
    f"""{BINS_SQL}, t AS (SELECT event_id % 5 AS y, list_filter([0, 1, 2, 3, 4], lambda i: 1 - p[i + 1] <= 0.8) AS s FROM b) SELECT avg(list_contains(s, y)::int) AS coverage, avg(len(s)) AS mean_size, quantile_cont(len(s), 0.9) AS p90_size, avg((len(s) = 1)::int) AS single_rate, avg((len(s) <> 1)::int) AS retest_rate FROM t""",
    "coverage mean_size p90_size single_rate retest_rate",
)
def prediction_set_metrics(spark, d):
    own = F.filter(F.transform("p", lambda v, i: F.when(1 - v <= 0.8, i)), lambda i: i.isNotNull())
    return metrics.set_metrics(bins(spark, d).select(own.alias("s"), (F.col("event_id") % 5).cast("int").alias("y")), "s", "y")


@query(f"WITH p AS ({P_SQL}) SELECT avg((c0 > c1)::int) AS c0_over_c1, avg((c1 > c2)::int) AS c1_over_c2, avg((c2 > c3)::int) AS c2_over_c3 FROM p", "c0_over_c1 c1_over_c2 c2_over_c3")
def monotonicity_violations(spark, d):
    return metrics.monotonicity(scores(spark, d), ["c0", "c1", "c2", "c3"])


PAIRS = f"""{SC}, g AS (SELECT a.x AS low, b.x AS high FROM (SELECT unnest([0.2, 0.4, 0.6, 0.8])::double AS x) a, (SELECT unnest([0.2, 0.4, 0.6, 0.8])::double AS x) b WHERE a.x < b.x),
w AS (SELECT low, high, coalesce(count_if(y AND score < low) / nullif(count_if(score < low), 0), 0) AS clear_bad, count_if(y AND score >= high) / count_if(y) AS alert_recall, coalesce(count_if(y AND score >= high) / nullif(count_if(score >= high), 0), 0) AS alert_precision,
 count_if(score >= low AND score < high) / count(*) AS retest_rate, count_if(y) / count(*) AS base FROM z, g GROUP BY low, high)"""


@query(f"{PAIRS} SELECT *, CASE WHEN clear_bad <= 0.3 THEN 100 * (0.35 * (1 - clear_bad) + 0.30 * alert_recall + 0.15 * least(1, alert_precision / base / 4) + 0.20 * (1 - retest_rate)) ELSE 0 END AS gated FROM w", "low high clear_bad alert_recall alert_precision retest_rate base gated")
def gated_index_pair(spark, d):
    sweep = metrics.pair_sweep(scored(spark, d), "y", "score", [0.2, 0.4, 0.6, 0.8])
    parts = {"clear": (0.35, 1 - F.col("clear_bad")), "recall": (0.30, F.col("alert_recall")), "lift": (0.15, F.col("alert_precision") / F.col("base") / 4), "retest": (0.20, 1 - F.col("retest_rate"))}
    return metrics.gated_index(sweep, F.col("clear_bad") <= 0.3, parts, "gated")


@query(
    f"""SELECT *, CASE WHEN recall >= 0.3 THEN 100 * (0.40 * precision + 0.25 * recall + 0.20 * (1 - fpr) + 0.15 * alarm_rate) ELSE 0 END AS gated FROM ({SWEEP_SQL})""",
    "threshold precision recall f1 fpr alarm_rate gated",
)
def gated_index_single(spark, d):
    sweep = metrics.threshold_sweep(scored(spark, d), "y", "score", [0.2, 0.4, 0.6, 0.8])
    parts = {"center": (0.40, F.col("precision")), "lift": (0.25, F.col("recall")), "safety": (0.20, 1 - F.col("fpr")), "coverage": (0.15, F.col("alarm_rate"))}
    return metrics.gated_index(sweep, F.col("recall") >= 0.3, parts, "gated")


@query(
    f"""{EV}, f AS (SELECT sensor, unit % 5 AS fold, avg(value) + 20 AS score, max(value) > 250 AS gate FROM e GROUP BY ALL), g AS (SELECT sensor, avg(gate::int) AS gate_rate, avg(score) AS mean, quantile_cont(score, 0.1) AS p10 FROM f GROUP BY sensor)
SELECT *, CASE WHEN gate_rate < 0.8 OR mean < 60 THEN 'FAIL' WHEN mean >= 80 AND p10 >= 70 THEN 'READY' ELSE 'CANARY' END AS verdict FROM g""",
    "gate_rate mean p10",
)
def deployability(spark, d):
    f = events(spark, d).groupBy("sensor", (F.col("unit") % 5).alias("fold")).agg((F.avg("value") + 20).alias("score"), (F.max("value") > 250).alias("gate"))
    return metrics.deployability(f, "sensor", "score", "gate")


@query(
    f"""{CURVE}, k AS (SELECT sensor, y, score, {_R} AS r FROM z), a AS (SELECT sensor, count(score) / count(*) AS valid_ratio, corr(score, y::int) AS corr,
  (sum(r) FILTER (WHERE y) - count_if(y) * (count_if(y) + 1) / 2.0) / (count_if(y) * count_if(NOT y)) AS auc FROM k GROUP BY sensor)
SELECT sensor AS feature, valid_ratio, corr, auc, valid_ratio * (0.7 * (2 * greatest(auc, 1 - auc) - 1) + 0.3 * abs(corr)) AS score FROM a""",
    "valid_ratio corr auc score",
)
def feature_screen(spark, d):
    long = scored(spark, d).select(F.col("sensor").alias("feature"), F.col("score").alias("value"), "y")
    return metrics.feature_scores(long, "y").select("feature", "valid_ratio", "corr", "auc", "score")


@query(
    "WITH s AS (SELECT avg(l_quantity) AS mae, max(l_discount) AS worst FROM lineitem) SELECT 'mae' AS metric, mae AS value, 30.0::double AS bound, mae <= 30 AS ok FROM s UNION ALL SELECT 'worst', worst, 0.5, worst >= 0.5 FROM s",
    "value bound",
)
def acceptance_checks(spark, d):
    summary = read(spark, d, "lineitem").agg(F.avg("l_quantity").alias("mae"), F.max("l_discount").alias("worst"))
    return metrics.acceptance(summary, {"mae": ("<=", 30.0), "worst": (">=", 0.5)})


@query(
    """SELECT event_id, greatest(0, least(1, 1 - abs(value - 50) / 20)) AS point, greatest(0, least(1, 1 - abs(value - 3 - 50) / 20)) AS point_low, greatest(0, least(1, 1 - abs(value + 3 - 50) / 20)) AS point_high,
 greatest(0, least(value + 3, 70) - greatest(value - 3, 30)) / 6 AS pass_score, least(abs(value - 30), abs(value - 70)) AS distance, least(abs(value - 30), abs(value - 70)) <= 2 AS is_boundary, value < 30 OR value > 70 AS is_out,
 greatest(0.1, least(5, exp(-pow((user_id % 5) / 20.0, 2)) * CASE WHEN least(abs(value - 30), abs(value - 70)) <= 2 THEN 2.0 ELSE 1.0 END * CASE WHEN value < 30 OR value > 70 THEN 1.5 ELSE 1.0 END)) AS weight FROM events""",
    "point point_low point_high pass_score distance weight",
)
def labels_noise_aware(spark, d):
    made = labels.noise_aware(F.col("value"), (F.col("user_id") % 5).cast("double"), 50.0, 20.0, 3.0, 2.0, 2.0, 1.5)
    return read(spark, d, "events").select("event_id", *[c.alias(n) for n, c in made.items() if n != "uncertain"])


@query(
    f"""{SC}, l AS (SELECT 'y' AS target, y, score AS p FROM z UNION ALL SELECT 'even', event_id % 2 = 0, ((event_id * 37) % 101) / 100.0::double FROM z), k AS (SELECT *, (rank() OVER (PARTITION BY target ORDER BY p) + (count(*) OVER (PARTITION BY target, p) - 1) / 2.0) AS r FROM l),
a AS (SELECT target, (sum(r) FILTER (WHERE y) - count_if(y) * (count_if(y) + 1) / 2.0) / (count_if(y) * count_if(NOT y)) AS auc, avg(pow(p - y::int, 2)) AS brier FROM k GROUP BY target),
b AS (SELECT target, least(floor(p * 10), 9) AS b, count(*) AS n, abs(avg(y::int) - avg(p)) AS gap FROM l GROUP BY ALL) SELECT target, any_value(auc) AS auc, any_value(brier) AS brier, sum(n * gap) / sum(n) AS ece FROM a JOIN b USING (target) GROUP BY target""",
    "auc brier ece",
)
def threshold_metric_table(spark, d):
    rows = scored(spark, d).select("y", "score", (F.col("event_id") % 2 == 0).alias("even"), (F.col("event_id") * 37 % 101 / F.lit(100.0)).alias("q"))
    return metrics.threshold_table(rows, [("y", "score"), ("even", "q")]).select("target", "auc", "brier", "ece")


@query(
    f"""WITH p AS ({P_SQL}), r AS (SELECT value, c3, CASE WHEN c0 >= 0.3 THEN 'low_risk' WHEN c3 >= 0.8 THEN 'warning' ELSE 'acceptable' END AS decision FROM p)
SELECT decision, count(*) AS n, avg((value > 60)::int) AS out_rate, avg(c3) AS quality, count(*) / sum(count(*)) OVER () AS share FROM r GROUP BY decision""",
    "out_rate quality share",
)
def decision_summary(spark, d):
    rule = decide.cascade([(F.col("c0") >= 0.3, "low_risk"), (F.col("c3") >= 0.8, "warning")], "acceptable")
    return metrics.decision_summary(scores(spark, d).select(rule.alias("decision"), (F.col("value") > 60).alias("out"), "c3"), "decision", "out", "c3")


@query(
    f"""WITH p AS ({P_SQL}), r AS (SELECT least(abs(value - 20), abs(value - 60)) <= 3 AS b, c3, CASE WHEN c3 >= 0.95 THEN 'warning' ELSE 'acceptable' END AS decision FROM p)
SELECT count_if(b)::bigint AS rows, count_if(b AND c3 >= 0.8 AND decision <> 'warning') / count_if(b) AS overconfident FROM r""",
    "overconfident",
)
def boundary_overconfidence(spark, d):
    rows = scores(spark, d).select(labels.boundary_flag(F.col("value"), (20.0, 60.0), 3.0).alias("b"), "c3", F.when(F.col("c3") >= 0.95, "warning").otherwise("acceptable").alias("decision"))
    return metrics.boundary_overconfidence(rows, "b", "c3", "decision")
