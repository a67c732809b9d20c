"""Queries over splits, choices, retrieval, models, sources and streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tidegauge.functions.timeline import DAY
from tidegauge import facade
from tidegauge.operators import asof, gram, grids, metrics, models, online, ranking, retrieval, selection, slices, splits, sweep
from tidegauge.plans.decisions import SC, scored
from tidegauge.plans.registry import EVENTS_SQL as EV
from tidegauge.plans.registry import events, query, read, samples, stream
from tidegauge.sources.scratch import stored
from tidegauge.streaming import alarms, timed

POS = f"{EV}, p AS (SELECT sample_id, unit, t, value, row_number() OVER (ORDER BY t, sample_id) - 1 AS pos, count(*) OVER () AS n FROM s)"


@query(
    f"""{POS}, c AS (SELECT max(CASE WHEN pos = floor(n * 0.6::double) THEN t END) AS a, max(CASE WHEN pos = floor(n * 0.8::double) THEN t END) AS b FROM p)
SELECT sample_id, CASE WHEN t < a - {DAY} THEN 'train' WHEN t >= a + {DAY} AND t < b - {DAY} THEN 'valid' WHEN t >= b + {DAY} THEN 'test' ELSE 'purged' END AS split FROM p, c"""
)
def purged_split(spark, d):
    return splits.purged_split(samples(spark, d), 0.6, 0.2, DAY).select("sample_id", "split")


@query(f"{POS} SELECT sample_id, CASE WHEN pos < floor(n * 0.7::double) THEN 'train' WHEN pos < floor(n * 0.85::double) THEN 'valid' ELSE 'test' END AS split FROM p")
def ratio_split(spark, d):
    return splits.ratio_split(samples(spark, d), 0.7, 0.15).select("sample_id", "split")


@query(f"{POS} SELECT sample_id, CASE WHEN pos < n - (n // 6) * 5 THEN 0 ELSE (pos - (n - (n // 6) * 5)) // (n // 6) + 1 END::int AS fold FROM p")
def expanding_folds(spark, d):
    return splits.expanding_folds(samples(spark, d), 5).select("sample_id", "fold")


@query(f"{POS} SELECT sample_id, CASE WHEN pos >= n - least(greatest(floor(n * 0.2::double), 20), n // 2) THEN 'calibration' ELSE 'proper' END AS part FROM p")
def calibration_tail(spark, d):
    return splits.calibration_tail(samples(spark, d)).select("sample_id", "part")


@query(
    f"""{POS}, x AS (SELECT *, CASE WHEN pos < floor(n * 0.7::double) THEN 'train' WHEN pos < floor(n * 0.85::double) THEN 'valid' ELSE 'test' END AS split FROM p), k AS (SELECT unit, count(DISTINCT split) AS c FROM x GROUP BY unit)
SELECT (SELECT count_if(c > 1)::bigint FROM k) AS crossing, (min(t) FILTER (WHERE split = 'valid') - max(t) FILTER (WHERE split = 'train')) / 6e7 AS train_valid_gap, (min(t) FILTER (WHERE split = 'test') - max(t) FILTER (WHERE split = 'valid')) / 6e7 AS valid_test_gap FROM x""",
    "train_valid_gap valid_test_gap",
)
def leakage_audit(spark, d):
    return splits.leakage_audit(splits.ratio_split(samples(spark, d), 0.7, 0.15), "unit")


@query(f"{EV} SELECT sensor, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY value DESC, event_id) AS rank FROM e) WHERE rank <= 3")
def topk_per_group(spark, d):
    return ranking.top_k(events(spark, d), ["sensor"], [F.col("value").desc(), F.col("event_id")], 3).select("sensor", "event_id", "rank")


SWEEP = f"""{SC}, g AS (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8])::double AS threshold), c AS (SELECT threshold, coalesce(count_if(y AND score >= threshold) / nullif(count_if(score >= threshold), 0), 0) AS precision, count_if(y AND score >= threshold) / count_if(y) AS recall, avg((score >= threshold)::int) AS alarm_rate FROM z, g GROUP BY threshold)"""
GRID = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


@query(
    f"""{SWEEP}, a AS (SELECT * FROM c WHERE recall >= 0.5 ORDER BY precision DESC, threshold LIMIT 1), b AS (SELECT * FROM c WHERE recall >= 2 ORDER BY precision DESC LIMIT 1), f AS (SELECT * FROM c ORDER BY recall DESC, precision DESC LIMIT 1)
SELECT 'feasible' AS choice, threshold FROM a UNION ALL SELECT 'relaxed', threshold FROM f""",
    "threshold",
)
def choose_threshold(spark, d):
    sweep = metrics.threshold_sweep(scored(spark, d), "y", "score", GRID)
    a = ranking.choose(sweep, F.col("recall") >= 0.5, [F.col("precision").desc(), F.col("threshold")])
    b = ranking.choose(sweep, F.col("recall") >= 2, [F.col("precision").desc()], [F.col("recall").desc(), F.col("precision").desc()])
    return a.select(F.lit("feasible").alias("choice"), "threshold").unionByName(b.select(F.lit("relaxed").alias("choice"), "threshold"))


@query(f"{SWEEP}, b AS (SELECT precision AS p0, recall AS r0 FROM c WHERE threshold = 0.5) SELECT threshold, precision - p0 AS delta_precision, recall - r0 AS delta_recall FROM c, b", "threshold delta_precision delta_recall")
def selection_deltas(spark, d):
    sweep = metrics.threshold_sweep(scored(spark, d), "y", "score", GRID)
    return ranking.default_deltas(sweep, F.col("threshold") == 0.5, ["precision", "recall"]).select("threshold", "delta_precision", "delta_recall")


@query(
    f"""{EV}, x AS (SELECT sensor, count(*) AS samples, avg(abs(value - 50)) / 1000 AS mae_a, stddev_pop(value) / 1000 AS mae_b, avg((value < 60)::int) AS cov_a, avg((value > 20)::int) AS cov_b, avg((value > 5)::int) AS success FROM e GROUP BY sensor)
SELECT sensor, 0.35 / (1 + mae_a / 0.05) + 0.15 / (1 + mae_b / 0.025) + 0.20 * cov_a + 0.10 * cov_b + 0.10 * success + 0.10 * samples / max(samples) OVER () AS composite, cov_a - 0.5 >= 0.1 AND samples <= 2000 AS enabled FROM x""",
    "composite",
)
def composite_scores(spark, d):
    v = F.col("value")
    x = events(spark, d).groupBy("sensor").agg(
        F.count(F.lit(1)).alias("samples"), (F.avg(F.abs(v - 50)) / 1000).alias("mae_a"), (F.stddev_pop(v) / 1000).alias("mae_b"),
        F.avg((v < 60).cast("int")).alias("cov_a"), F.avg((v > 20).cast("int")).alias("cov_b"), F.avg((v > 5).cast("int")).alias("success"),
    )
    made = x.withColumns({"composite": ranking.composite_score(x), "gain": F.col("cov_a") - 0.5, "lag": F.col("samples")})
    return ranking.enable_policy(made, 0.1, 2000).select("sensor", "composite", "enabled")


#: Controls between their least and greatest values in the table; the anchor is where they are on average.
GRID_SQL = """WITH c AS (SELECT l_quantity AS a, 100 * l_discount AS b FROM lineitem), r AS (SELECT min(a) AS a0, max(a) AS a1, avg(a) AS ma, min(b) AS b0, max(b) AS b1, avg(b) AS mb FROM c),
g AS (SELECT a0 + i.i * (a1 - a0) / 30 AS a, b0 + j.i * (b1 - b0) / 30 AS b, ma, mb FROM r, range(31) i(i), range(31) j(i)),
p AS (SELECT a, b, 1 / (1 + exp(-(0.16 * a - 0.55 * b - 1))) AS p, sqrt(pow(a - ma, 2) + pow(b - mb, 2)) AS d FROM g)"""


def _controls(spark, d):
    c = read(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), (100 * F.col("l_discount")).alias("b"))
    r = c.agg(*[f(x).alias(f"{n}_{x}") for x in "ab" for n, f in (("low", F.min), ("high", F.max), ("mean", F.avg))]).first()
    grid = retrieval.control_grid(spark, (r["low_a"], r["low_b"]), (r["high_a"], r["high_b"]), 31)
    return grid, 1 / (1 + F.exp(-(0.16 * F.col("a") - 0.55 * F.col("b") - 1))), (r["mean_a"], r["mean_b"])


@query(
    f"{GRID_SQL}, f AS (SELECT * FROM p WHERE p >= 0.9), x AS (SELECT a, b, p FROM f ORDER BY d, p DESC LIMIT 1) SELECT x.a, x.b, x.p, min(f.a) AS a_min, max(f.a) AS a_max, min(f.b) AS b_min, max(f.b) AS b_max, count(*)::bigint AS feasible FROM f, x GROUP BY ALL",
    "a b p a_min a_max b_min b_max",
)
def grid_feasible_best(spark, d):
    grid, probability, anchor = _controls(spark, d)
    return retrieval.grid_recommendation(grid, probability, anchor, 0.9)


@query(f"{GRID_SQL}, t AS (SELECT * FROM p ORDER BY p DESC, a, b LIMIT 25) SELECT a, b, p FROM t ORDER BY d, p DESC LIMIT 1", "a b p")
def grid_fallback(spark, d):
    grid, probability, (a, b) = _controls(spark, d)
    distance = F.sqrt(F.pow(F.col("a") - a, F.lit(2.0)) + F.pow(F.col("b") - b, F.lit(2.0)))
    return ranking.feasible_or_top(grid.withColumn("p", probability), "p", 2.0, distance)


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("z"))


_DIST = "list_sum(list_transform(range(1, len(a.z) + 1), lambda i: pow(a.z[i] - b.z[i], 2)))"


@query(
    f"""WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::double) AS z FROM embeddings), k AS (SELECT a.id AS query_id, b.id AS case_id, sqrt({_DIST}) AS distance FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id)
SELECT query_id, case_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, case_id) AS rank FROM k) WHERE rank <= 5""",
    "distance",
)
def knn_context(spark, d):
    v = vectors(spark, d)
    return retrieval.neighbours(v.where("id % 100 = 0"), v, 5)


@query(
    f"""WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::double) AS z FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS z FROM (SELECT label, i, avg(z[i]) AS m FROM v, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
k AS (SELECT a.id, b.label AS stage, sqrt({_DIST}) AS distance FROM v a, c b) SELECT id, stage::varchar AS stage, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, stage) AS rn FROM k) WHERE rn = 1""",
    "distance",
)
def nearest_centroid(spark, d):
    v = vectors(spark, d)
    parts = v.select("label", F.posexplode("z").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centroids = parts.groupBy(F.col("label").cast("string").alias("stage")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return retrieval.nearest_centroid(v.select("id", "z"), centroids).select("id", "stage", "distance")


@query(
    f"""WITH v AS (SELECT vec_id AS id, embedding[1]::double AS f1, embedding[2]::double AS f2, label, list_transform(embedding, lambda x: x::double) AS z FROM embeddings), k AS (SELECT a.id AS query_id, b.id AS case_id, a.f1, a.f2, b.f1 AS g1, b.f2 AS g2, sqrt({_DIST}) AS dd FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dd, case_id) AS rn FROM k) WHERE rn <= 5), s AS (SELECT query_id, unnest(['f1', 'f2']) AS feature, unnest([quantile_cont(g1, 0.5) - any_value(f1), quantile_cont(g2, 0.5) - any_value(f2)]) AS shift FROM n GROUP BY query_id)
SELECT query_id, feature, shift FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY abs(shift) DESC, feature) AS rn FROM s) WHERE rn = 1""",
    "shift",
)
def matched_median_shift(spark, d):
    v = vectors(spark, d).withColumns({"f1": F.get("z", F.lit(0)), "f2": F.get("z", F.lit(1))})
    return retrieval.matched_shift(v.where("id % 100 = 0"), v, ["f1", "f2"], 5, 1).select("query_id", "feature", "shift")


@query(f"{EV} SELECT q.sample_id AS query_id, count(r.event_id) AS library FROM s q LEFT JOIN r ON r.t <= q.t - {DAY} AND floor(r.t / {7 * DAY})::bigint % 3 <> 0 GROUP BY ALL")
def delayed_library_size(spark, d):
    week = (F.floor(F.col("t") / (7 * DAY)) % 3).cast("string")
    lib = stream(spark, d).withColumn("month", week)
    return retrieval.delayed_library(samples(spark, d).withColumnRenamed("sample_id", "id"), lib, DAY, ["0"])


@query(
    f"""WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::double) AS z FROM embeddings), k AS (SELECT a.id AS query_id, b.id AS case_id, b.label AS y, abs(a.id - b.id)::double AS age, sqrt({_DIST}) AS distance FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, case_id) AS rn FROM k) WHERE rn <= 10), w AS (SELECT query_id, y, exp(-distance / (quantile_cont(distance, 0.5) OVER (PARTITION BY query_id))) * exp(-age / 200) AS w FROM n)
SELECT query_id, sum(w * y) / sum(w) AS estimate, pow(sum(w), 2) / sum(w * w) AS effective_n FROM w GROUP BY query_id""",
    "estimate effective_n",
)
def kernel_weighted_mean(spark, d):
    v = vectors(spark, d)
    near = retrieval.neighbours(v.where("id % 100 = 0"), v, 10).join(v.select(F.col("id").alias("case_id"), F.col("label").cast("double").alias("y")), "case_id")
    return retrieval.kernel_blend(near.select("query_id", "distance", F.abs(F.col("query_id") - F.col("case_id")).cast("double").alias("age_days"), F.lit(1.0).alias("weight"), "y"), 200.0)


@query("SELECT 'l_quantity' AS control, quantile_cont(l_quantity, 0.1)::double AS low, quantile_cont(l_quantity, 0.5)::double AS best, quantile_cont(l_quantity, 0.9)::double AS high FROM lineitem UNION ALL SELECT 'l_discount', quantile_cont(l_discount, 0.1), quantile_cont(l_discount, 0.5), quantile_cont(l_discount, 0.9) FROM lineitem", "low best high")
def empirical_ranges(spark, d):
    return retrieval.empirical_ranges(read(spark, d, "lineitem"), ["l_quantity", "l_discount"])


@query(f"{SC}, u AS (SELECT sensor, max(event_id) AS last FROM z GROUP BY sensor) SELECT * FROM u")
def latest_per_sensor(spark, d):
    return ranking.top_k(scored(spark, d), ["sensor"], [F.col("event_id").desc()], 1).select("sensor", F.col("event_id").alias("last"))


def _features(spark, d):
    """Slice features of purchases with an out-of-band label."""
    asked = samples(spark, d).withColumns({"y": (F.col("value") > 60).cast("int"), "sample_t": F.col("t")})
    return sweep.encode(asked, stream(spark, d), 2 * 3_600_000_000, ["sample_id", "sample_t", "y"], ["mean", "max", "count"])


def _cases(spark, d):
    """The features with a fold."""
    return splits.expanding_folds(_features(spark, d), 5, "sample_t")


def _library(spark, d):
    """The features as a case base, stored: its readers scan it many times."""
    rows = _features(spark, d).select(F.col("sample_id").alias("id"), F.col("sample_t").alias("t"), F.col("y").cast("double").alias("y"), "mean", "max", F.col("count").cast("double").alias("count"))
    return stored(rows, "cases")


@query()
def model_out_of_fold(spark, d):
    return models.out_of_fold(_cases(spark, d).cache(), ["mean", "max", "count"], "y").select("sample_id", "fold", "score")


@query()
def model_calibrated(spark, d):
    rows = scored(spark, d).select("event_id", "score", F.col("y").cast("int").alias("y")).cache()
    fit = models.isotonic(rows.where("event_id % 2 = 0"), "score", "y")
    return fit(rows).select("event_id", "calibrated")


@query()
def model_regimes(spark, d):
    rows = _cases(spark, d).cache()
    return models.cluster_regimes(rows, ["mean", "max", "count"], 3)(rows).select("sample_id", "regime")


@query()
def model_search(spark, d):
    rows = read(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linenumber").cache()
    found = models.model_search(rows.where("l_linenumber <= 4"), rows.where("l_linenumber > 4"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", ["mean", "ridge", "boosting"])
    return spark.createDataFrame(found, "rmse double, mae double, name string")


@query()
def isolation_scores(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice")
    return models.isolation_scores(rows, rows, ["l_quantity", "l_extendedprice"], "id")


@query(
    f"""{SC}, q AS (SELECT sensor, quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM z GROUP BY sensor),
b AS (SELECT sensor, y, len(list_filter(edges, lambda e: e < score)) AS bin FROM z JOIN q USING (sensor)), c AS (SELECT sensor, bin, y, count(*) AS n FROM b GROUP BY ALL),
p AS (SELECT sensor, n / sum(n) OVER s AS p, sum(n) OVER (PARTITION BY sensor, bin) / sum(n) OVER s AS px, sum(n) OVER (PARTITION BY sensor, y) / sum(n) OVER s AS py FROM c WINDOW s AS (PARTITION BY sensor))
SELECT sensor AS feature, sum(p * ln(p / (px * py))) AS mi FROM p GROUP BY sensor""",
    "mi",
)
def information_ranking(spark, d):
    rows = scored(spark, d).select(F.col("sensor").alias("feature"), F.col("score").alias("value"), "y")
    return slices.binned_information(rows, "feature", "value", "y")


@query(
    f"""{EV}, q AS (SELECT sensor, quantile_cont(value, 0.5) AS low, quantile_cont(value, 0.75) AS mid, quantile_cont(value, 0.9) AS high FROM e GROUP BY sensor)
SELECT sensor, name, kind, CASE level WHEN 0 THEN low WHEN 1 THEN mid ELSE high END AS "on", k, n FROM q, (VALUES ('point_low', 'point', 0, 1::bigint, 1::bigint), ('point_mid', 'point', 1, 1, 1), ('point_high', 'point', 2, 1, 1),
 ('run2_low', 'consecutive', 0, 2, 1), ('run2_mid', 'consecutive', 1, 2, 1), ('run3_low', 'consecutive', 0, 3, 1), ('run3_mid', 'consecutive', 1, 3, 1),
 ('2of3_mid', 'k_of_n', 1, 2, 3), ('3of5_mid', 'k_of_n', 1, 3, 5), ('ema_0.3', 'ema', 1, 1, 1), ('ema_0.5', 'ema', 1, 1, 1)) v(name, kind, level, k, n)""",
    '"on"',
)
def alarm_policy_grid(spark, d):
    """Eleven policies a sensor, by its own quantiles."""
    cuts = selection.exact_quantiles(events(spark, d), ["sensor"], "value", [0.5, 0.75, 0.9], ["low", "mid", "high"])
    rows = [(p.name, p.kind, int(p.on), p.k, p.n) for p in grids.alarm_policies(0, 1, 2)]
    policies = spark.createDataFrame(rows, "name string, kind string, level int, k long, n long")
    level = F.get(F.array("low", "mid", "high"), F.col("level")).alias("on")
    return cuts.crossJoin(F.broadcast(policies)).select("sensor", "name", "kind", level, "k", "n")  # eleven rows


#: Bytes of files in a micro-batch.
STREAM_BATCH = 32 << 20
#: Rows of a scattered file at most, about.
FILE_ROWS = 1_500_000


def shared_folder(spark):
    """``spark.checkpoint.dir``; a temporary folder where it is unset and all tasks run in the driver's process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith(("local[", "local")) or not named and "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "file://" + tempfile.mkdtemp()


def _streamed(spark, d, make, key, ahead="INTERVAL 1 DAY", scattered=False, unit=False):
    """A bounded file stream of the events through ``make`` into a table, by one ``availableNow`` run.

    The files are ingested in order of time, so that no row is late; with ``scattered`` rows are dealt to files by a hash, and come
    in no order. ``unit`` adds the unit's column. A last file holds one row without a key, ``ahead`` of the newest event: it takes the watermark past the end of
    every open window, and its own window stays open.
    """
    base = f"{shared_folder(spark)}/{key}-{abs(hash((d, key))) % 10**9}-{spark.sparkContext.startTime}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    source = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("sensor"), "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), *[F.col("user_id").alias("unit")] * unit)
    dealt = source.repartition(max(4, -(-source.count() // FILE_ROWS)), F.xxhash64("event_id")) if scattered else source.repartitionByRange("time", "event_id").sortWithinPartitions("time", "event_id")
    dealt.write.parquet(f"{base}/in")
    end = source.agg(F.max("time").alias("time")).where("time IS NOT NULL").select(F.lit(None).cast("long").alias("event_id"), (F.col("time") + F.expr(ahead)).alias("time"))
    end.select("event_id", "time", *[F.lit(None).cast(source.schema[c].dataType).alias(c) for c in source.columns[2:]]).coalesce(1).write.parquet(f"{base}/end")
    files = alarms.in_order(spark, f"{base}/in", f"{base}/end", STREAM_BATCH)
    flow = make(alarms.file_stream(spark, f"{base}/in", source.schema.simpleString()[7:-1].replace(":", " "), files))
    with timed.rocksdb(spark):
        done = flow.writeStream.format("parquet").option("checkpointLocation", f"{base}/ck").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
        done.awaitTermination()
    return spark.read.parquet(f"{base}/out")


_STATES = f"""{EV}, o AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY t, event_id) AS rn FROM e),
h AS (SELECT * FROM (WITH RECURSIVE x(sensor, rn, event_id, state) AS (
  SELECT sensor, rn, event_id, CASE WHEN value >= 120 THEN 2 WHEN value >= 60 THEN 1 ELSE 0 END FROM o WHERE rn = 1
  UNION ALL SELECT o.sensor, o.rn, o.event_id, CASE WHEN x.state = 0 THEN CASE WHEN value >= 120 THEN 2 WHEN value >= 60 THEN 1 ELSE 0 END
    WHEN x.state = 1 THEN CASE WHEN value >= 120 THEN 2 WHEN value < 48 THEN 0 ELSE 1 END
    ELSE CASE WHEN value >= 102 THEN 2 WHEN value >= 60 THEN 1 WHEN value < 48 THEN 0 ELSE 2 END END
  FROM x JOIN o ON o.sensor = x.sensor AND o.rn = x.rn + 1) SELECT * FROM x))"""


@query(f"{_STATES} SELECT sensor, event_id, state::int AS state FROM h")
def stream_hysteresis(spark, d):
    return _streamed(spark, d, lambda s: alarms.hysteresis_stream(s.where("event_id IS NOT NULL").withColumn("score", F.col("value")), "sensor", 60.0, 120.0), "hysteresis")


@query(f"{EV} SELECT sensor, floor(t / 21600000000)::bigint * 21600000000 AS start, arg_max(value, (t, event_id)) AS value FROM e GROUP BY ALL")
def stream_tumbling_last(spark, d):
    return _streamed(spark, d, lambda s: alarms.tumbling_last(s, "6 hours", ["sensor"]), "tumbling").select("sensor", F.unix_micros("start").alias("start"), "value")


@query(
    f"""{EV}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY sensor ORDER BY t) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM e),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY sensor ORDER BY t, event_id) AS session FROM g)
SELECT sensor, min(t) AS start, max(t) + 1800000000 AS "end", count(*) AS "rows" FROM n GROUP BY sensor, session"""
)
def stream_sessions(spark, d):
    return _streamed(spark, d, lambda s: alarms.sessions(s, "30 minutes", ["sensor"]), "sessions").select("sensor", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "rows")


def _lagged(m):
    return f"(SELECT sample_id, value, CASE WHEN a.at - r.t <= 600000000 THEN r.v END AS v FROM (SELECT sample_id, value, t - {m} * 60000000::bigint AS at FROM s) a ASOF LEFT JOIN (SELECT t, value AS v FROM r) r ON a.at >= r.t)"


@query(f"{EV} " + " UNION ALL ".join(f"SELECT {m} AS lag, corr(v, value) AS corr, count(v) AS n FROM {_lagged(m)}" for m in (0, 30, 60)), "corr")
def lag_correlations(spark, d):
    r = stream(spark, d).select("t", F.col("value").alias("v"), "event_id")
    return online.lag_correlations(asof.lagged_snapshots(samples(spark, d), r, ["v"], [0, 30, 60], 10, order=["event_id"]), "value", [0, 30, 60], "v")


@query(
    f"""WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::double) AS z FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS z FROM (SELECT label, i, avg(z[i]) AS m FROM v, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
k AS (SELECT a.id, b.label, sqrt({_DIST}) AS dd FROM v a, c b), w AS (SELECT id, list(dd ORDER BY label) AS l, list_sort(list(dd)) AS o FROM k GROUP BY id)
SELECT id, l[1] AS d0, (1 / (l[1] + 1e-9)) / list_sum(list_transform(l, lambda x: 1 / (x + 1e-9))) AS m0, o[2] - o[1] AS margin FROM w""",
    "d0 m0 margin",
)
def cluster_membership(spark, d):
    v = vectors(spark, d)
    parts = v.select("label", F.posexplode("z").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centroids = parts.groupBy(F.col("label").cast("string").alias("stage")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return online.cluster_membership(v.select("id", "z"), centroids).select("id", F.get("distances", F.lit(0)).alias("d0"), F.get("membership", F.lit(0)).alias("m0"), "margin")


@query(f"{EV} SELECT sensor, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM e GROUP BY sensor", "share")
def label_summary(spark, d):
    return online.label_summary(events(spark, d), "sensor")


FUSE = f"{SC}, f AS (SELECT y, score AS a, ((event_id * 37) % 101) / 100.0::double AS b FROM z)"


def fused(spark, d):
    return scored(spark, d).select("y", F.col("score").alias("a"), (F.col("event_id") * 37 % 101 / F.lit(100.0)).alias("b"))


@query(f"{FUSE} SELECT w::double AS weight, avg(pow(w * a + (1 - w) * b - y::int, 2)) AS brier FROM f, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double AS w) GROUP BY w", "weight brier")
def fusion_weights(spark, d):
    return online.fusion_weights(fused(spark, d), "a", "b", "y", [0.0, 0.25, 0.5, 0.75, 1.0])


@query(
    f"""{FUSE}, g AS (SELECT x, z FROM (SELECT unnest([0.3, 0.6])::double AS x), (SELECT unnest([0.4, 0.8])::double AS z)), l AS (SELECT x, z, y, CASE WHEN (a + b) / 2 < 0.4 AND (a > x OR b > z) THEN 0.4 ELSE (a + b) / 2 END AS r FROM f, g),
c AS (SELECT x AS a_ceiling, z AS b_ceiling, avg((r < 0.4)::int) AS low_rate, count_if(y AND r < 0.4) / count_if(y) AS false_clear, avg(pow(r - y::int, 2)) AS brier FROM l GROUP BY x, z)
SELECT a_ceiling, b_ceiling, low_rate, false_clear, brier, true AS feasible FROM c WHERE false_clear <= 0.5 ORDER BY low_rate DESC, brier, a_ceiling, b_ceiling LIMIT 1""",
    "a_ceiling b_ceiling low_rate false_clear brier",
)
def guardrail_choice(spark, d):
    rows = fused(spark, d).withColumn("r", (F.col("a") + F.col("b")) / 2)
    return online.best_guardrail(online.guardrail_grid(rows, "y", "r", "a", "b", 0.4, [0.3, 0.6], [0.4, 0.8]), 0.5)


@query(
    f"""{EV}, f AS (SELECT sensor AS candidate, unit % 5 AS fold, avg(value) / 100 AS macro_f1, quantile_cont(value, 0.5) / 100 AS balanced, max(value) AS risk FROM e GROUP BY ALL), m AS (SELECT candidate, avg(macro_f1) AS macro_f1, avg(balanced) AS balanced, avg(risk) AS risk FROM f GROUP BY candidate),
b AS (SELECT macro_f1 AS f0, balanced AS b0 FROM m WHERE candidate = 'click') SELECT candidate, macro_f1, balanced, risk, true AS feasible FROM m, b WHERE macro_f1 >= f0 - 0.02 AND balanced >= b0 - 0.02 ORDER BY risk, macro_f1 DESC, candidate LIMIT 1""",
    "macro_f1 balanced risk",
)
def inner_fold_choice(spark, d):
    v = F.col("value")
    f = events(spark, d).groupBy(F.col("sensor").alias("candidate"), (F.col("unit") % 5).alias("fold")).agg(
        (F.avg(v) / 100).alias("macro_f1"), (F.percentile(v, F.lit(0.5)) / 100).alias("balanced"), F.max(v).alias("risk")
    )
    return online.inner_candidates(f, F.col("candidate") == "click", 0.02)


@query(
    f"""{EV}, f AS (SELECT sensor, CASE WHEN unit % 2 = 0 THEN 'train' ELSE 'test' END AS split, stddev_pop(value) AS rmse, corr(value, unit) * 10 AS spearman FROM e GROUP BY ALL),
t AS (SELECT sensor, max(rmse) FILTER (WHERE split = 'train') AS train_rmse, max(rmse) FILTER (WHERE split = 'test') AS test_rmse, max(spearman) FILTER (WHERE split = 'train') AS train_spearman, max(spearman) FILTER (WHERE split = 'test') AS test_spearman FROM f GROUP BY sensor)
SELECT *, test_rmse >= 1.75 * train_rmse OR (train_spearman >= 0.8 AND test_spearman <= 0.35) OR train_spearman - test_spearman >= 0.55 AS severe FROM t""",
    "train_rmse test_rmse train_spearman test_spearman",
)
def overfit_flags(spark, d):
    f = events(spark, d).groupBy("sensor", F.when(F.col("unit") % 2 == 0, "train").otherwise("test").alias("split")).agg(F.stddev_pop("value").alias("rmse"), (F.corr("value", "unit") * 10).alias("spearman"))
    return metrics.overfit(f, "sensor")


CASES = f"""{EV}, c AS (SELECT s.sample_id AS id, s.t, (s.value > 60)::int::double AS y, avg(r.value) AS mean, max(r.value) AS max, count(r.value)::double AS count
FROM s JOIN r ON r.t BETWEEN s.t - {2 * 3_600_000_000} AND s.t GROUP BY ALL)"""
DELAYED = f"""{CASES}, l AS (UNPIVOT c ON mean, max, count INTO NAME f VALUE v), m AS (SELECT f, quantile_cont(v, 0.5) AS med, stddev_pop(v) AS sd FROM l GROUP BY f),
a AS (SELECT f, any_value(med) AS med, any_value(sd) AS sd, quantile_cont(abs(v - med), 0.5) AS mad FROM l JOIN m USING (f) GROUP BY f),
z AS (SELECT id, t, y, list((v - med) / CASE WHEN mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd ELSE 1 END ORDER BY f) AS z FROM l JOIN a USING (f) GROUP BY id, t, y),
p AS (SELECT q.id AS query_id, k.id AS case_id, k.y, (q.t - k.t) / {float(DAY)} AS age, list_median(list_transform(range(1, 4), lambda i: abs(k.z[i] - q.z[i]))) AS d
      FROM z q JOIN z k ON k.t <= q.t - {DAY} AND k.id <> q.id WHERE q.id % 100 = 0),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, case_id) AS rank FROM p) WHERE rank <= 25),
w AS (SELECT *, exp(-d / greatest(quantile_cont(d, 0.5) OVER (PARTITION BY query_id), 1e-6)) * exp(-greatest(age, 0) / 10.0) AS w FROM n),
b AS (SELECT query_id, sum(w * y) / sum(w) AS e, pow(sum(w), 2) / sum(w * w) AS effective_n, count(*) AS neighbours FROM w GROUP BY query_id)"""


@query(
    f"""{DELAYED} SELECT c.id, CASE WHEN coalesce(neighbours, 0) >= 5 THEN e ELSE 0.25 END AS estimate, effective_n, coalesce(neighbours, 0) AS neighbours,
  CASE WHEN coalesce(neighbours, 0) >= 5 THEN 'local' ELSE 'static' END AS route FROM c LEFT JOIN b ON c.id = b.query_id WHERE c.id % 100 = 0""",
    "estimate effective_n",
)
def delayed_neighbour_estimates(spark, d):
    cases = _library(spark, d)
    return online.delayed_neighbours(cases.where("id % 100 = 0"), cases, ["mean", "max", "count"], 25, DAY, 10.0, 5, F.lit(0.25))


@query(
    f"""{CASES}, m AS (SELECT quantile_cont(mean, 0.5) AS m1, quantile_cont(max, 0.5) AS m2 FROM c), x AS (SELECT id, y, count, coalesce(mean, m1) AS x1, coalesce(max, m2) AS x2 FROM c, m),
f AS (SELECT avg(x1) AS a1, stddev_pop(x1) AS s1, avg(x2) AS a2, stddev_pop(x2) AS s2 FROM x),
z AS (SELECT id, y, count, (x1 - a1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END AS z1, (x2 - a2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END AS z2 FROM x, f),
p AS (SELECT q.id AS query_id, q.count AS actual, k.count AS control, row_number() OVER (PARTITION BY q.id ORDER BY sqrt(pow(k.z1 - q.z1, 2) + pow(k.z2 - q.z2, 2)), k.id) AS rank
      FROM z q JOIN z k ON k.id <> q.id WHERE q.id % 100 = 0 AND k.y = 0),
g AS (SELECT query_id, any_value(actual) AS actual, quantile_cont(control, 0.1) AS low, quantile_cont(control, 0.5) AS best, quantile_cont(control, 0.9) AS high FROM p WHERE rank <= 25 GROUP BY query_id)
SELECT query_id, low, best, high, actual, abs(best - actual) AS error, actual BETWEEN low AND high AS covered FROM g""",
    "low best high actual error",
)
def recommendation_replay(spark, d):
    cases = _library(spark, d).select("id", "mean", "max", F.col("count").alias("control"), (1 - F.col("y")).alias("is_in_spec"), (F.col("id") % 100 == 0).alias("replay"))
    return facade.evaluate_recommendations(cases, ["mean", "max"], "control")


@query()
def delayed_local_models(spark, d):
    """Boosted local models of the neighbours of every case, their means and blends; tests hold the trees against a plain version."""
    cases = _library(spark, d)
    found = online.delayed_neighbours(cases, cases, ["mean", "max", "count"], 25, DAY, 10.0, 5, F.lit(0.25), model_weight=0.7)
    return found.select("id", "local_model", "local_mean", "local_blend")


LAG_ROWS = f"""{EV}, d AS ({" UNION ALL ".join(f"SELECT {m} AS lag, sample_id, t, value AS y, v AS x1, (t % {DAY}) / {float(DAY)} AS x2 FROM (SELECT a.sample_id, a.value, a.t, CASE WHEN a.at - r.t <= 600000000 THEN r.v END AS v FROM (SELECT sample_id, value, t, t - {m} * 60000000::bigint AS at FROM s) a ASOF LEFT JOIN (SELECT t, value AS v FROM r) r ON a.at >= r.t)" for m in (0, 30, 60))}),
p AS (SELECT *, row_number() OVER (PARTITION BY lag ORDER BY t, sample_id) - 1 AS pos, count(*) OVER (PARTITION BY lag) AS n FROM d WHERE x1 IS NOT NULL),
o AS (SELECT DISTINCT lag, i AS outer_fold, 0 AS inner_fold, n - (5 - i + 1) * (n // 6) AS first, n - (5 - i) * (n // 6) AS last FROM p, range(1, 6) x(i))"""
#: Two standardised features: the normal equations are two by two.
_FITTED = """c AS (SELECT f.lag, outer_fold, inner_fold, first, last, count(*) AS m, avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2,
  corr(x1, x2) AS r, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM f JOIN p ON p.lag = f.lag AND p.pos < f.first GROUP BY ALL),
w AS (SELECT *, m * ((m + 1) * c1 / s1 - m * r * c2 / s2) / ((m + 1) * (m + 1) - m * r * m * r) / s1 AS w1, m * ((m + 1) * c2 / s2 - m * r * c1 / s1) / ((m + 1) * (m + 1) - m * r * m * r) / s2 AS w2 FROM c),
g AS (SELECT p.lag, sample_id, outer_fold, inner_fold, y, ay + w1 * (x1 - a1) + w2 * (x2 - a2) AS score FROM p JOIN w ON p.lag = w.lag AND pos >= first AND pos < last)"""


def _lag_rows(spark, d):
    own, at = samples(spark, d), stream(spark, d).select("t", F.col("value").alias("v"), "event_id")
    rows = [asof.asof_join(own, at, ["v"], 10 * 60_000_000, lag=m * 60_000_000, order=["event_id"]).withColumn("lag", F.lit(m)) for m in (0, 30, 60)]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return both.select("lag", "sample_id", "t", F.col("value").alias("y"), F.col("v").alias("x1"), ((F.col("t") % DAY) / float(DAY)).alias("x2"))


@query(
    f"""{LAG_ROWS}, f AS (SELECT * FROM o), {_FITTED}, h AS (SELECT lag, outer_fold, 1 - sum(pow(y - score, 2)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - score)) AS mae FROM g GROUP BY ALL)
SELECT lag, any_value(n) AS n, avg(r2) AS r2, avg(mae) AS mae FROM h JOIN (SELECT DISTINCT lag, n FROM p) USING (lag) GROUP BY lag""",
    "r2 mae",
)
def lag_ridge_scores(spark, d):
    return gram.ridge_cv(_lag_rows(spark, d), "lag", ["x1", "x2"], "y", "sample_id", 5)


@query(
    f"""{LAG_ROWS}, f AS (SELECT * FROM o UNION ALL SELECT lag, outer_fold, j, first - (3 - j + 1) * (first // 4), first - (3 - j) * (first // 4) FROM o, range(1, 4) x(j)), {_FITTED}
SELECT lag::bigint AS lag, sample_id, outer_fold::int AS "outer", inner_fold::int AS "inner", score, y AS target FROM g""",
    "score target",
)
def nested_fold_scores(spark, d):
    return gram.ridge_folds(_lag_rows(spark, d), "lag", ["x1", "x2"], "y", "sample_id", 5, 3)


#: All events lie within this of each other, so that files in no order lose no row.
WHOLE = "400 days"
AHEAD = "INTERVAL 460 DAYS"
def _rows(stream, kind):
    return stream.select("sensor", "time", "t", "event_id", "value", kind.cast("int").alias("kind"))


@query(f"{_STATES} SELECT sensor, event_id, state::int AS state FROM h")
def stream_ordered_hysteresis(spark, d):
    make = lambda s: timed.ordered_hysteresis(_rows(s, F.lit(0)), "sensor", 60.0, 120.0, DAY, WHOLE)
    return _streamed(spark, d, make, "ordered", AHEAD, scattered=True)


@query(
    f"""{EV}, w AS (SELECT sensor, floor(t / 600000000)::bigint * 600000000 AS start, arg_max(value, (t, event_id)) AS value FROM e WHERE value IS NOT NULL GROUP BY ALL),
n AS (SELECT *, lead(start) OVER (PARTITION BY sensor ORDER BY start) AS next FROM w)
SELECT sensor, start + k * 600000000 AS start, value, k > 0 AS filled FROM n, range(0, 4) x(k) WHERE k = 0 OR next IS NULL OR start + k * 600000000 < next"""
)
def stream_filled_steps(spark, d):
    make = lambda s: timed.filled_steps(_rows(s, F.lit(0)), "sensor", 600_000_000, WHOLE, 3)
    return _streamed(spark, d, make, "filled", AHEAD, scattered=True)


@query(
    f"""{EV}, k AS (SELECT *, CASE WHEN unit % 2 = 0 THEN 'even' ELSE 'odd' END AS side FROM e), q AS (SELECT * FROM k WHERE sensor = 'purchase'), l AS (SELECT * FROM k WHERE sensor = 'view' AND floor(t / {7 * DAY})::bigint % 3 <> 0)
SELECT q.event_id, count(l.value) AS library, avg(l.value) AS mean FROM q LEFT JOIN l ON l.side = q.side AND l.t <= q.t - {DAY} AND l.t > q.t - {4 * DAY} GROUP BY q.event_id""",
    "mean",
)
def stream_released_labels(spark, d):
    side = F.when(F.col("event_id").isNotNull(), F.when(F.col("unit") % 2 == 0, "even").otherwise("odd"))  # the last file's row has none
    blocked = F.floor(F.col("t") / (7 * DAY)) % 3 == 0
    kind = F.when(F.col("sensor") == "purchase", timed.QUERY).when((F.col("sensor") == "view") & ~blocked, timed.LABEL).otherwise(timed.BLOCKED)

    def make(s):
        rows = s.withColumns({"kind": kind, "side": side}).select("side", "time", "t", "event_id", "value", "kind")
        return timed.released_labels(rows, "side", DAY, 3 * DAY, DAY, WHOLE)

    return _streamed(spark, d, make, "released", AHEAD, scattered=True, unit=True).select("event_id", "library", "mean")
