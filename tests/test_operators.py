"""Properties that SQL comparisons do not show: ties, nulls, empty inputs, folds, models, streams, files."""

import json
import math
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import decide, labels, text
from tidegauge.operators import asof, columns, grids, metrics, models, ranking, retrieval, runs, series, slices, splits
from tidegauge.plans import registry
from tidegauge.sources import tables

SF = "/root/testdata/sf0.001"
M = 60_000_000


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, 100 * M), (2, 200 * M), (3, None)], "sample_id int, t long")
    right = spark.createDataFrame([(90 * M, 1.0), (110 * M, 2.0), (189 * M, 3.0), (None, 9.0)], "t long, v double")
    near = {r["sample_id"]: (r["v"], r["gap"]) for r in asof.asof_join(left, right, ["v"], 10 * M, direction="nearest").collect()}
    assert near == {1: (1.0, -10 * M), 2: (None, None), 3: (None, None)}  # the earlier row on a tie, one minute too far
    back = {r["sample_id"]: r["v"] for r in asof.asof_join(left, right, ["v"], 11 * M).collect()}
    assert back == {1: 1.0, 2: 3.0, 3: None}
    assert asof.asof_join(left, right.limit(0), ["v"], M).where("v is not null").count() == 0


def test_slices_are_closed_on_both_ends(spark):
    s = spark.createDataFrame([(1, 100 * M)], "sample_id int, t long")
    r = spark.createDataFrame([(1, 40 * M, 1.0), (2, 100 * M, None), (3, 40 * M - 1, 9.0), (4, 100 * M + 1, 9.0)], "event_id int, t long, value double")
    got = slices.encode_slices(slices.slice_join(s, r, 60 * M), ["sample_id"]).first()
    assert (got["last"], got["valid_ratio"], got["std"], got["slope"]) == (1.0, 0.5, 0.0, None)


def test_rolling_equals_pandas(spark):
    rows = registry.stream(spark, SF)
    got = slices.rolling_grid(rows, ["sensor"], 120 * M).toPandas().set_index("event_id").sort_index()
    pdf = rows.toPandas()
    pdf["ts"] = pd.to_datetime(pdf["t"], unit="us")
    want = pdf.sort_values("ts").set_index("ts").groupby("sensor")["value"].rolling("120min", closed="right").mean().to_numpy()
    order = pdf.sort_values(["sensor", "ts"])["event_id"]
    assert (got.loc[order, "mean"].to_numpy() - want).__abs__().max() < 1e-9


def test_merge_segments_is_ordered(spark):
    seg = spark.createDataFrame([("a", 1, 5, 5), ("a", 7, 12, 6), ("a", 14, 14, 1), ("a", 30, 40, 11)], "k string, first_row int, last_row int, points long")
    got = [tuple(r)[1:] for r in series.merge_segments(seg, ["k"], 2, 3).orderBy("first_row").collect()]
    assert got == [(1, 12, 12), (14, 14, 1), (30, 40, 11)]


def test_segment_ewma_restarts(spark):
    rows = spark.createDataFrame([("a", i, i, v) for i, v in enumerate([1.0, 3.0, None, 8.0, 10.0])], "k string, event_id int, t long, value double")
    got = [r["ewma"] for r in series.segment_ewma(rows, ["k"], 0.5).orderBy("t").collect()]
    assert got == [1.0, 2.0, 8.0, 9.0]


def test_hysteresis_holds_and_releases():
    states, s = [], 0
    for p in (0.1, 0.6, 0.5, 0.47, 0.9, 0.8, 0.75, 0.3, float("nan")):
        s = runs.next_state(s, p, 0.6, 0.9)
        states.append(s)
    assert states == [0, 1, 1, 0, 2, 2, 1, 0, 0]


def test_ordered_interval_grows_to_the_larger_neighbour(spark):
    df = spark.createDataFrame([(0.1, 0.4, 0.3, 0.15, 0.05), (0.3, 0.3, 0.4, 0.0, 0.0)], "a double, b double, c double, d double, e double")
    got = [r[0] for r in df.select(decide.ordered_interval([F.col(c) for c in "abcde"], F.lit(0.75))).collect()]
    assert got == [[1, 2, 3], [0, 1, 2]]


def test_calibration_metrics_match_a_plain_count(spark):
    rows = registry.samples(spark, SF).select((F.col("value") > 50).alias("y"), (F.col("sample_id") % 10 / 10).alias("score")).toPandas()
    df = spark.createDataFrame(rows)
    got = metrics.ranked_metrics(df, "y", "score").first()
    pos, neg = rows[rows.y].score, rows[~rows.y].score
    auc = sum((p > neg).sum() + (p == neg).sum() / 2 for p in pos) / (len(pos) * len(neg))
    assert got["auc"] == pytest.approx(auc) and got["rows"] == len(rows)
    one = metrics.ranked_metrics(df.where("y"), "y", "score").first()
    assert one["auc"] is None and one["ap"] is None


def test_folds_never_train_on_the_future(spark):
    folded = splits.expanding_folds(registry.samples(spark, SF), 5)
    edges = folded.groupBy("fold").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("fold").collect()
    assert [r["fold"] for r in edges] == list(range(6)) and all(x["b"] <= y["a"] for x, y in zip(edges, edges[1:], strict=False))
    scenarios = splits.month_scenarios([("01", 50), ("02", 40), ("03", 30), ("04", 60)], 40, 20, frozenset({"02"}))
    assert scenarios == [{"train": ["01"], "valid": "03", "test": "04"}]


def test_greedy_prune_and_grids(spark):
    kept = ranking.greedy_prune([("a", 0.9), ("b", -0.8), ("c", 0.5)], {("a", "b"): 0.99, ("a", "c"): 0.1, ("b", "c"): 0.2}, 0.9, 5)
    assert kept == ["a", "c"]
    df = spark.range(200).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.rand(1).alias("c"), F.col("id").cast("double").alias("y"))
    assert ranking.select_reduced(df, ["a", "b", "c"], "y", 0.9, 2) == ["a", "c"]
    rows = grids.candidates({"x": [1, 2], "y": [1, 2]}, lambda c: c["x"] <= c["y"], {"x": 1, "y": 2})
    assert rows == [{"x": 1, "y": 2}, {"x": 1, "y": 1}, {"x": 2, "y": 2}]
    assert len(grids.alarm_policies(0.3, 0.5, 0.7)) == 11
    assert grids.feature_pairs(["a__mean", "b__mean", "a__std"]) == [("a__mean", "b__mean")]
    assert grids.lag_policy(spark, ["FI101", "XX1"], {"feed": [10, 20]}, 5).count() == 3


def test_columns(spark):
    df = spark.createDataFrame([(1, 1.0, None, "1,2 3"), (2, 2.0, None, "<4"), (3, None, None, "x")], "id int, a double, b double, c string")
    assert columns.prune_empty(df, ["id"]).columns == ["id", "a", "c"]
    assert [r["c"] for r in columns.coerce_columns(df, ["c"]).collect()] == [123.0, 4.0, None]
    assert columns.select_or_all(df, F.col("id") == 9).count() == 3 and columns.select_or_all(df, F.col("id") == 1).count() == 1
    assert text.match_headers(["Sample Time", "Q.A value"], {"sample_time": ["time"], "target": ["qa"]}) == {"sample_time": "Sample Time", "target": "Q.A value"}
    assert text.feature_parts("w15_lag30__TI101__mean") == {"window": "15", "lag": "30", "sensor": "TI101", "stat": "mean"}
    assert json.dumps(text.json_ready({"a": float("nan"), "b": [pd.Timestamp("2024-01-01")]})) == '{"a": null, "b": ["2024-01-01T00:00:00"]}'
    assert labels.target_range(None, None, (8.2, 0.5)) == (7.699999999999999, 8.7) and labels.target_range((8, 1), None, (0, 0)) == (7, 9)


@pytest.fixture(scope="module")
def cases(spark):
    rows = spark.range(400).select("id", (F.col("id") % 20 / 20).alias("a"), F.rand(3).alias("b"), (F.floor(F.col("id") / 80) + 0).cast("int").alias("fold"), (F.col("id") % 4).cast("int").alias("g"))
    return rows.withColumn("y", ((F.col("a") + 0.2 * F.col("b")) > 0.6).cast("int")).withColumn("soft", F.col("a")).cache()


def test_models_learn(cases):
    oof = models.out_of_fold(cases, ["a", "b"], "y", k=4)
    assert oof.count() == 320 and metrics.ranked_metrics(oof.withColumn("l", F.col("y") == 1), "l", "score").first()["auc"] > 0.95
    assert models.fit_binary(cases.where("y = 1"), ["a"], "y").transform(cases).first()["score"] == 1.0
    soft = models.fit_soft_binary(cases, ["a"], "soft").transform(cases)
    assert soft.stat.corr("score", "soft") > 0.95
    ridge = models.clipped(models.fit_ridge(cases, ["a", "b"], "soft").transform(cases))
    assert ridge.agg(F.avg(F.abs(F.col("score") - F.col("soft")))).first()[0] < 0.05
    dist = models.fit_distribution(cases.withColumn("m", F.array(1 - F.col("soft"), F.col("soft"), F.lit(0.0))), ["a"], "m", 3).transform(cases)
    p = dist.orderBy(F.col("a").desc()).first()["score"]
    assert len(p) == 3 and p[1] > 0.5 and abs(sum(p) - 1) < 1e-6
    grouped = models.per_group_scores(cases, cases, ["a", "b"], "y", "g", 50)
    assert grouped.count() == 400
    fall = models.cumulative_models(cases, cases, ["a"], "soft", (0.3, 0.6))
    assert fall.where("p0 > p1").count() == 0
    assert models.importance(cases, ["a", "b"], "y", 1)[0][0] == "a"
    iso = models.isotonic(cases, "a", "y")(cases)
    assert iso.agg(F.min("calibrated"), F.max("calibrated")).first() == (0.0, 1.0)
    assert models.platt(cases, "a", "y")(cases).stat.corr("calibrated", "a") > 0.8
    assert models.ensemble_score(cases, cases, ["a", "b"], "y", "id").count() == 400


def test_files(spark, tmp_path):
    base = f"{tmp_path}"
    (tmp_path / "s.csv").write_text("time,TI1,FI2\n2024-01-01 00:00:00,1.5,x\nbad,2,3\n2024-01-01 00:01:00,<2,4\n")
    got = tables.read_stream_csv(spark, f"{base}/s.csv").orderBy("time").collect()
    assert [(r["TI1"], r["FI2"]) for r in got] == [(1.5, None), (2.0, 4.0)]
    mapped = tables.read_mapped_stream(spark, f"{base}/s.csv", ["FI2", "none"])
    assert mapped.columns == ["time", "FI2", "none"] and mapped.count() == 2
    tables.write_table(mapped, f"{base}/o.parquet")
    assert tables.read_table(spark, f"{base}/o.parquet").count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{base}/o.xlsx")
    (tmp_path / "lab.csv").write_text("Sample Time,Result\n2024-01-01 01:00:00,8.1\n2024-01-01 02:00:00,\n")
    lab = tables.read_samples(spark, {"one": f"{base}/lab.csv", "two": f"{base}/lab.csv"})
    assert lab.count() == 4 and {r["source_sheet"] for r in lab.collect()} == {"one", "two"}
    (tmp_path / "case.csv").write_text("target,x__mean\n8.1,1\n9.5,2\n,3\n")
    case = tables.load_casebase(spark, f"{base}/case.csv", 7.5, 8.5).orderBy("target").collect()
    assert [r["is_in_spec"] for r in case] == [1, 0]
    chan = spark.createDataFrame([("a", f"2024-01-01 00:{i:02d}:00", str(i)) for i in range(9)], "n string, c1 string, c2 string")
    assert tables.infer_channel(chan).count() == 9
    (tmp_path / "c.yaml").write_text("a: 1\n")
    assert tables.load_config(f"{base}/c.yaml", ["a"]) == {"a": 1}
    with pytest.raises(ValueError):
        tables.load_config(f"{base}/c.yaml", ["b"])
    made = tables.synthetic_window(spark, {"s": {"last": 10.0, "slope": 0.5}}, 4, "2024-01-01 00:10:00").orderBy("time").collect()
    assert [r["s"] for r in made] == [8.0, 8.5, 9.0, 9.5, 10.0]
    doc = tables.to_json_rows(spark.createDataFrame([(float("nan"), "x")], "a double, b string")).first()["document"]
    assert json.loads(doc) == {"a": None, "b": "x"}
    assert tables.audit_layout([f"c{i}" for i in range(10)]) == ("c0", ["c7", "c8"], "c9")


def test_streams_equal_batch(spark):
    got = {r["event_id"]: r["state"] for r in registry.QUERIES["stream_hysteresis"](spark, SF).collect()}
    want = {r["event_id"]: r["state"] for r in registry.QUERIES["alarm_hysteresis"](spark, SF).collect()}
    assert got == want
    assert registry.QUERIES["stream_tumbling_last"](spark, SF).count() > 0
    assert registry.QUERIES["stream_sessions"](spark, SF).count() > 0


def test_recommendation(spark):
    from tidegauge.facade import recommend_controls

    rows = spark.range(600).select("id", (F.col("id") % 7 * 1.0).alias("x"), (F.col("id") % 31 / 3.0).alias("a"), (F.col("id") % 17 / 3.0).alias("b"))
    cases = rows.withColumn("is_in_spec", (F.col("a") - F.col("b") + 0.3 * F.sin("id") > 2).cast("int"))
    got = recommend_controls(cases, {"x": 3.0}, ("a", "b"), (1.0, 4.0), neighbours=80)
    best = got.ranges.first()
    assert best["p"] >= 0.7 and best["feasible"] > 0 and got.warnings == [] and got.neighbours.count() == 80
    same = recommend_controls(cases.where("is_in_spec = 1"), {"x": 3.0}, ("a", "b"), (1.0, 4.0), neighbours=80)
    assert same.warnings and {r["control"] for r in same.ranges.collect()} == {"a", "b"}
    stages = spark.createDataFrame([("s1", [0.0]), ("s2", [9.0])], "stage string, c array<double>")
    assert recommend_controls(cases, {"x": 3.0}, ("a", "b"), (1.0, 4.0), stages=stages, neighbours=80).stage == "s1"
    late = recommend_controls(cases.where("x < 4"), {"x": 300.0}, ("a", "b"), (1.0, 4.0), stages=stages, neighbours=40)
    assert late.stage == "s2" and late.warnings


def test_pchip_keeps_shape_and_hits_known_values(spark):
    v = [0.0, 1.0, None, 3.0, 4.0, None, None, 4.0, 2.0, None, None, None, 0.0]
    rows = spark.createDataFrame([("a", i, i * 1_000_000, x) for i, x in enumerate(v)], "k string, event_id int, t long, value double")
    got = [r["value"] for r in series.fill_pchip(rows, ["k"], 2).orderBy("t").collect()]
    assert got[2] == pytest.approx(2.0) and got[5] == got[6] == pytest.approx(4.0)  # linear stays linear, flat stays flat
    assert [x is None or x != x for x in got[9:12]] == [True] * 3


def test_column_groups(spark):
    assert columns.keep_representatives([("abc", "ab"), ("ab", "zz")], ["abc", "ab", "zz", "q"]) == ["ab", "q"]
    df = spark.range(300).select("id", (F.col("id") % 50 * 1.0).alias("a"), (F.col("id") % 50 * 1.0).alias("b"), F.lit(None).cast("double").alias("c"), (F.col("id") % 3 * 1.0).alias("d"))
    got = {r["feature"]: r["reason"] for r in columns.unsupervised_reasons(df, ["id"], ["a", "b", "c", "d"], "id").collect()}
    assert got == {"a": None, "b": "same_head", "c": "all_missing", "d": "constant"}


def test_fusion_refits_and_regimes(spark, cases):
    from tidegauge.operators import online

    fused = online.logistic_fusion(cases, cases, "a", "b", "y")
    assert fused.stat.corr("fused", "a") > 0.8
    assert online.expanding_refits(cases, ["a", "b"], "y", "fold", 1, 4).count() == 320
    counted = online.stage_counts(cases, ["a"], [2, 3], 10)
    assert sum(r["chosen"] for r in counted) == 1
    assert online.pick_sample(cases, "id").first()["id"] == 399
    with pytest.raises(ValueError):
        online.pick_sample(cases, "id", 10_000)
    assert online.best_fusion_weight(cases.withColumn("l", F.col("y") == 1), "a", "b", "l", [0.0, 0.5, 1.0]) in (0.5, 1.0)


def test_stream_joins_and_library(spark, tmp_path):
    from tidegauge.streaming import alarms

    base = f"{tmp_path}"
    rows = [("k", 1, datetime(2024, 1, 1), 1.0), ("k", 2, datetime(2024, 1, 1, 1), 0.0), ("k", 3, datetime(2024, 1, 1, 3), 1.0)]
    for row in rows:  # one file a row, in order of time: the source takes files by age, and files of one job have no fixed order
        spark.createDataFrame([row], "key string, outcome_id long, outcome_time timestamp, y double").coalesce(1).write.mode("append").parquet(f"{base}/o")
    spark.createDataFrame([("k", 9, datetime(2024, 1, 1, 3, 30))], "key string, query_id long, query_time timestamp").write.parquet(f"{base}/q")
    o = alarms.file_stream(spark, f"{base}/o", "key string, outcome_id long, outcome_time timestamp, y double")
    q = alarms.file_stream(spark, f"{base}/q", "key string, query_id long, query_time timestamp")
    run = alarms.delayed_outcomes(q, o, "1 hours", "2 hours").writeStream.format("memory").queryName("known").option("checkpointLocation", f"{base}/c1").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r["query_id"], r["outcome_id"]) for r in spark.table("known").collect()] == [(9, 2)]
    alarms.append_library(o, f"{base}/lib", f"{base}/c2").start().awaitTermination()
    assert spark.read.parquet(f"{base}/lib").count() == 3
    wide = alarms.sliding_stats(o.withColumnsRenamed({"outcome_time": "time", "y": "value"}), "2 hours", "1 hour", ["key"])
    run = wide.writeStream.format("memory").queryName("slid").option("checkpointLocation", f"{base}/c3").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("slid").count() >= 2


def test_example_request(spark):
    from tidegauge.facade import example_request, recommend_controls

    cases, context, anchor = example_request(spark)
    assert recommend_controls(cases, context, ("control_a", "control_b"), anchor, neighbours=80).ranges.count() >= 1


@pytest.mark.parametrize("width", [1, 7, 50, 10**9])
def test_folds_carry_their_state_over_pieces(spark, width):
    """One key split over many tasks gives what one fold over all its rows gives."""
    from tidegauge.operators import runs, series

    values = [None, None, 10.0, 90.0, 70.0, None, 66.0, 40.0, 130.0, 103.0, 101.0, 47.0, None, 61.0] * 8
    rows = [(k, i, i, v) for k in ("a", None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "sensor string, event_id long, t long, value double")
    level, state, alarm, want = None, 0, False, {}
    for i, v in enumerate(values):
        if v is not None:
            level = v if level is None else 0.25 * v + 0.75 * level
        state = runs.next_state(state, v, 60.0, 120.0)
        alarm = alarm if level is None else level >= 80 or (alarm and level >= 50)
        want[i] = (level, state, alarm)
    e = series.ewma(df, ["sensor"], 0.25, width).collect()
    h = runs.hysteresis(df, ["sensor"], "value", 60.0, 120.0, width=width).collect()
    m = runs.ema_hysteresis(df, ["sensor"], "value", 0.25, 80.0, 50.0, width).collect()
    assert len(e) == len(h) == len(m) == len(rows)
    assert all((r["ewma"] is None and want[r["t"]][0] is None) or abs(r["ewma"] - want[r["t"]][0]) < 1e-9 for r in e)
    assert all(r["state"] == want[r["t"]][1] for r in h) and all(r["alarm"] == want[r["t"]][2] for r in m)
    assert series.ewma(df.limit(0), ["sensor"], 0.25).collect() == []


def test_score_curve_over_ranges(spark):
    rows = [(g, (i * 37 % 211) / 211.0, (i * 7919) % 10 > 6) for g in (None, "a", "b") for i in range(300)] + [("c", 0.5, True), ("c", None, False), ("c", float("nan"), False)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    key = lambda s: math.inf if math.isnan(s) else s
    for part in ([], ["g"]):
        got = metrics.score_curve(df, "y", "s", part).collect()
        assert len(got) == len({((g if part else 0), repr(s)) for g, s, _ in rows if s is not None})
        for r in got:
            own = [(s, y) for g, s, y in rows if s is not None and (not part or g == r["g"])]
            reached = [y for s, y in own if key(s) >= key(r["s"])]
            assert (r["tp"], r["fp"]) == (sum(reached), len(reached) - sum(reached))
            assert (r["pos"], r["neg"]) == (sum(y for _, y in own), sum(not y for _, y in own))
    assert metrics.score_curve(df.limit(0), "y", "s").collect() == []
