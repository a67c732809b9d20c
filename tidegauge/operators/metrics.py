"""Metrics as aggregates. Score curves count each distinct score first, so ties and class sizes never meet in a list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.operators.aggregates import average_rank
from tidegauge.operators.selection import ranked_values, running_totals


def safe(a: Column, b: Column) -> Column:
    """a / b, 0 for an empty denominator."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion(actual: Column, flagged: Column) -> dict[str, Column]:
    tp, fp = F.count_if(actual & flagged), F.count_if(~actual & flagged)
    fn, tn = F.count_if(actual & ~flagged), F.count_if(~actual & ~flagged)
    return {
        "tp": tp,
        "fp": fp,
        "fn": fn,
        "tn": tn,
        "precision": safe(tp, tp + fp),
        "recall": safe(tp, tp + fn),
        "specificity": safe(tn, tn + fp),
        "f1": safe(2 * tp, 2 * tp + fp + fn),
        "fpr": safe(fp, fp + tn),
        "fnr": safe(fn, fn + tp),
        "alarm_rate": safe(tp + fp, tp + fp + tn + fn),
    }


def threshold_sweep(df: DataFrame, actual: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion metrics per threshold. The grid is a literal list: each row is counted into the bin between two thresholds,
    and the cumulative sums run over the bins, so a long grid multiplies no rows."""
    grid = sorted(thresholds)
    slot = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col(score)))  # thresholds reached
    counts = df.where(F.col(score).isNotNull()).groupBy(slot.alias("slot")).agg(F.count_if(actual).alias("p"), F.count_if(~F.col(actual)).alias("n"))
    spark = df.sparkSession
    cells = spark.createDataFrame([(i, float(grid[i - 1]) if i else None) for i in range(len(grid) + 1)], "slot int, threshold double")
    full = F.broadcast(cells).join(counts, "slot", "left").na.fill(0, ["p", "n"])
    up = Window.orderBy(F.col("slot").desc())
    tot = Window.partitionBy()
    rows = full.withColumns({"tp": F.sum("p").over(up), "fp": F.sum("n").over(up), "pos": F.sum("p").over(tot), "neg": F.sum("n").over(tot)}).where("slot > 0")
    tp, fp, pos, neg = map(F.col, ("tp", "fp", "pos", "neg"))
    return rows.select(
        "threshold", "tp", "fp", (pos - tp).alias("fn"), (neg - fp).alias("tn"),
        safe(tp, tp + fp).alias("precision"), safe(tp, pos).alias("recall"), safe(2 * tp, tp + fp + pos).alias("f1"),
        safe(fp, neg).alias("fpr"), safe(tp + fp, pos + neg).alias("alarm_rate"),
    )


def score_curve(df: DataFrame, actual: str, score: str, part: list[str] | None = None) -> DataFrame:
    """Cumulative true and false positives at every distinct score, highest first; distinct scores are summed in ranges
    (``selection.running_totals``), so no task orders all of them."""
    part = part or []
    counted = df.where(F.col(score).isNotNull()).groupBy(*part, score).agg(F.count_if(actual).alias("_p"), F.count_if(~F.col(actual)).alias("_n"))
    placed = running_totals(counted, part, score, ["_p", "_n"], descending=True)
    return placed.select(
        *part, score, "_p", "_n", (F.col("_p_before") + F.col("_p")).alias("tp"), (F.col("_n_before") + F.col("_n")).alias("fp"), F.col("_p_all").alias("pos"), F.col("_n_all").alias("neg")
    )


def pr_curve(df: DataFrame, actual: str, score: str, part: list[str] | None = None) -> DataFrame:
    curve = score_curve(df, actual, score, part)
    return curve.select(*(part or []), score, safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), safe(F.col("tp"), F.col("pos")).alias("recall"))


def ranked_metrics(df: DataFrame, actual: str, score: str, part: list[str] | None = None) -> DataFrame:
    """Per part: rows, positives, ROC AUC by ranks, average precision, both NULL for a single class, and the Brier score."""
    part = part or []
    curve = score_curve(df, actual, score, part)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    below = F.col("neg") - F.col("fp")  # negatives with a lower score
    both = (F.max("pos") > 0) & (F.max("neg") > 0)
    brier = F.sum(F.col("_p") * F.pow(F.col(score) - 1, F.lit(2.0)) + F.col("_n") * F.pow(F.col(score), F.lit(2.0))) / F.sum(F.col("_p") + F.col("_n"))
    return curve.groupBy(*part).agg(
        F.sum(F.col("_p") + F.col("_n")).alias("rows"),
        F.sum("_p").alias("positives"),
        F.when(both, F.sum(F.col("_p") * (below + F.col("_n") / 2)) / (F.max("pos") * F.max("neg"))).alias("auc"),
        F.when(both, F.sum(F.try_divide("_p", "pos") * precision)).alias("ap"),
        brier.alias("brier"),
    )


def best_f1(df: DataFrame, actual: str, score: str, part: list[str] | None = None) -> DataFrame:
    """Threshold with the best F1 per part; higher recall, then the lower threshold on ties."""
    part = part or []
    c = score_curve(df, actual, score, part).withColumns(
        {"f1": safe(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")), "recall": safe(F.col("tp"), F.col("pos"))}
    )
    pick = F.max(F.struct("f1", "recall", (-F.col(score)).alias("m")))
    return c.groupBy(*part).agg(pick.alias("x")).select(*part, (-F.col("x.m")).alias("threshold"), F.col("x.f1").alias("f1"), F.col("x.recall").alias("recall"))


def group_thresholds(scored: DataFrame, actual: str, score: str, group: str, is_valid: Column, is_test: Column, min_rows: int, min_each: int) -> DataFrame:
    """Best-F1 threshold per group learnt on the valid part, the global one where a group has too few rows or classes; confusion
    per group on the test part."""
    valid = scored.where(is_valid)
    enough = valid.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(actual).alias("p")).where(
        (F.col("n") >= min_rows) & (F.col("p") >= min_each) & (F.col("n") - F.col("p") >= min_each)
    )
    own = best_f1(valid.join(enough.select(group), group), actual, score, [group]).select(group, F.col("threshold").alias("own"))
    overall = best_f1(valid, actual, score).select(F.col("threshold").alias("overall"))
    test = scored.where(is_test).join(own, group, "left").crossJoin(F.broadcast(overall))
    cut = F.coalesce("own", "overall")
    stats = confusion(F.col(actual), F.col(score) >= cut)
    return test.groupBy(group).agg(F.max(cut).alias("threshold"), *[stats[k].alias(k) for k in ("tp", "fp", "fn", "tn", "f1")])


def regression_metrics(df: DataFrame, y: str, p: str, part: list[str] | None = None) -> DataFrame:
    part = part or []
    both = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    ranked = average_rank(average_rank(both, part, y, "_ry"), part, p, "_rp")
    ok = (F.count(F.lit(1)) >= 3) & (F.min(y) < F.max(y)) & (F.min(p) < F.max(p))
    e = F.col(y) - F.col(p)
    return ranked.groupBy(*part).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(ok, F.corr("_ry", "_rp")).alias("spearman")
    )


def multiclass_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Macro F1, balanced accuracy, weighted F1 and accuracy from the confusion counts."""
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("b")).count()
    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.lit("a").alias("k")), F.struct(F.col("b").alias("c"), F.lit("b").alias("k")))).alias("x"), "a", "b", "count")
    by = each.groupBy("x.c").agg(
        F.sum(F.when(F.col("x.k") == "a", F.col("count")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("x.k") == "b", F.col("count")).otherwise(0)).alias("called"),
        F.sum(F.when((F.col("x.k") == "a") & (F.col("a") == F.col("b")), F.col("count")).otherwise(0)).alias("hit"),
    )
    f1 = safe(2 * F.col("hit"), F.col("support") + F.col("called"))
    return by.agg(
        F.avg(f1).alias("macro_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("hit") / F.col("support"))).alias("balanced_accuracy"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
    )


def soft_scores(p: Column, q: Column, eps: float = 1e-15) -> tuple[Column, Column]:
    """Brier score and cross-entropy of class probabilities ``p`` against soft targets ``q`` (arrays)."""
    brier = F.aggregate(F.zip_with(p, q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    entropy = F.aggregate(
        F.zip_with(p, q, lambda a, b: -b * F.log(F.greatest(F.lit(eps), F.least(a, F.lit(1 - eps))))), F.lit(0.0), lambda s, x: s + x
    )
    return brier, entropy


def calibration_bins(df: DataFrame, actual: str, p: str, bins: int = 10) -> DataFrame:
    """Equal-width reliability table; the last bin is closed on the right."""
    slot = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(p).isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(actual).cast("int")).alias("observed"), F.avg(p).alias("predicted"))


def calibration_error(df: DataFrame, actual: str, p: str, bins: int = 10) -> DataFrame:
    t = calibration_bins(df, actual, p, bins)
    return t.agg((F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted"))) / F.sum("n")).alias("ece"))


def quantile_bin(rank: Column, n: Column, bins: int) -> Column:
    """Bin of a rank (from 1) in equal-count cuts with right-closed edges by linear interpolation; this is not ``ntile``."""
    return F.greatest(F.lit(0), F.ceil((rank - 1) * bins / F.greatest(n - 1, F.lit(1))) - 1).cast("int")


def calibration_quantiles(df: DataFrame, actual: str, p: str, order: str, bins: int, part: list[str]) -> DataFrame:
    """Reliability table of equal-count bins per part; ties by ``order``."""
    full = Window.partitionBy(*part)
    slot = quantile_bin(F.row_number().over(full.orderBy(p, order)), F.count(F.lit(1)).over(full), bins)
    return df.withColumn("bin", slot).groupBy(*part, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(actual).cast("int")).alias("observed"), F.avg(p).alias("predicted"))


def risk_metrics(df: DataFrame, out: str, risk: str, low: float, high: float, over_all_rows: bool = False) -> DataFrame:
    """Low, high and retest rates, and the false-clear rate over the true positives or over all rows."""
    clear = F.col(risk) < low
    return df.agg(
        F.avg(clear.cast("int")).alias("low_rate"),
        F.avg((F.col(risk) >= high).cast("int")).alias("high_rate"),
        F.avg(((F.col(risk) >= low) & (F.col(risk) < high)).cast("int")).alias("retest_rate"),
        safe(F.count_if(F.col(out) & clear), F.count(F.lit(1)) if over_all_rows else F.count_if(F.col(out))).alias("false_clear"),
    )


def set_metrics(df: DataFrame, members: str, truth: str) -> DataFrame:
    """Coverage, mean and p90 size, single and retest rates of prediction sets."""
    n = F.size(members)
    return df.agg(
        F.avg(F.array_contains(F.col(members), F.col(truth)).cast("int")).alias("coverage"),
        F.avg(n).alias("mean_size"),
        F.percentile(n, F.lit(0.9)).alias("p90_size"),
        F.avg((n == 1).cast("int")).alias("single_rate"),
        F.avg((n != 1).cast("int")).alias("retest_rate"),
    )


def monotonicity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows where a cumulative probability falls, per adjacent pair."""
    pairs = list(zip(columns, columns[1:], strict=False))
    return df.agg(*[F.avg((F.col(a) > F.col(b)).cast("int")).alias(f"{a}_over_{b}") for a, b in pairs])


def gated_index(sweep: DataFrame, gate: Column, parts: dict[str, tuple[float, Column]], name: str) -> DataFrame:
    """100 x gate x weighted sum of components clipped to [0, 1]."""
    total = sum((w * F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) for w, c in parts.values()), F.lit(0.0))
    return sweep.withColumn(name, 100 * gate.cast("int") * total)


def pair_sweep(df: DataFrame, out: str, risk: str, grid: Sequence[float]) -> DataFrame:
    """Two-threshold sweep over all pairs low < high: rows are counted into the grid's bins once, the pairs meet over the bins."""
    slot = F.size(F.filter(F.array(*map(F.lit, sorted(grid))), lambda t: t <= F.col(risk)))
    counts = df.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.count_if(out).alias("p"))
    spark = df.sparkSession
    pairs = [(a, b, i + 1, j + 1) for i, a in enumerate(sorted(grid)) for j, b in enumerate(sorted(grid)) if i < j]
    table = spark.createDataFrame(pairs, "low double, high double, i int, j int")
    low, high = F.col("slot") < F.col("i"), F.col("slot") >= F.col("j")
    part = lambda c, w: F.sum(F.when(w, F.col(c)).otherwise(0))
    joined = counts.crossJoin(F.broadcast(table)).groupBy("low", "high")
    return joined.agg(
        safe(part("p", low), part("n", low)).alias("clear_bad"),
        safe(part("p", high), F.sum("p")).alias("alert_recall"),
        safe(part("p", high), part("n", high)).alias("alert_precision"),
        safe(part("n", ~low & ~high), F.sum("n")).alias("retest_rate"),
        safe(F.sum("p"), F.sum("n")).alias("base"),
    )


def deployability(folds: DataFrame, group: str, score: str, gate: str) -> DataFrame:
    """FAIL below a gate rate of .80 or a mean of 60, READY from a mean of 80 with p10 of 70, else CANARY."""
    out = folds.groupBy(group).agg(F.avg(F.col(gate).cast("int")).alias("gate_rate"), F.avg(score).alias("mean"), F.percentile(score, F.lit(0.1)).alias("p10"))
    verdict = F.when((F.col("gate_rate") < 0.8) | (F.col("mean") < 60), "FAIL").when((F.col("mean") >= 80) & (F.col("p10") >= 70), "READY").otherwise("CANARY")
    return out.withColumn("verdict", verdict)


def feature_scores(long: DataFrame, label: str, name: str = "feature", value: str = "value") -> DataFrame:
    """valid_ratio x (.7 (2 max(AUC, 1 - AUC) - 1) + .3 |corr|) per feature, in one job over the long form."""
    auc = ranked_metrics(long, label, value, [name]).select(name, "auc")
    stats = long.groupBy(name).agg((F.count(value) / F.count(F.lit(1))).alias("valid_ratio"), F.corr(value, F.col(label).cast("int")).alias("corr"))
    lift = 2 * F.greatest(F.col("auc"), 1 - F.col("auc")) - 1
    score = F.col("valid_ratio") * (0.7 * F.coalesce(lift, F.lit(0.0)) + 0.3 * F.coalesce(F.abs("corr"), F.lit(0.0)))
    return stats.join(auc, name, "left").withColumn("score", score)


def overfit(metrics: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Severe where test / train RMSE >= 1.75, or train Spearman >= .80 with test <= .35, or a drop of .55."""
    v = lambda m, s: F.max(F.when(F.col(split) == s, F.col(m)))
    t = metrics.groupBy(key).agg(*[v(m, s).alias(f"{s}_{m}") for m in ("rmse", "spearman") for s in ("train", "test")])
    drop = F.col("train_spearman") - F.col("test_spearman")
    severe = (F.col("test_rmse") >= 1.75 * F.col("train_rmse")) | ((F.col("train_spearman") >= 0.8) & (F.col("test_spearman") <= 0.35)) | (drop >= 0.55)
    return t.withColumn("severe", F.coalesce(severe, F.lit(False)))


def acceptance(summary: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """A row per check: metric, value, limit and whether it holds; ``limits`` maps a column to (">=" or "<=", bound)."""
    rows = [
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(b)).alias("bound"), (F.col(m) >= b if op == ">=" else F.col(m) <= b).alias("ok"))
        for m, (op, b) in limits.items()
    ]
    return summary.select(F.inline(F.array(*rows)))


def conformal_quantile(scores: DataFrame, score: str, alpha: float, part: list[str] | None = None, min_rows: int = 1) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score per part (the largest where that passes n), by exact selection."""
    last = lambda n: F.array(F.least(F.ceil((n + 1) * (1 - alpha)), n) - 1)
    found = ranked_values(scores, part or [], score, last)
    return found.where(F.col("n") >= min_rows).select(*(part or []), F.col("value").alias("qhat"), "n")


def threshold_table(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """AP, AUC, Brier score and calibration error of several (label, score) column pairs, from one long form."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(a).alias("target"), F.col(a).cast("boolean").alias("y"), F.col(p).cast("double").alias("p")) for a, p in pairs])))
    ranked = ranked_metrics(long, "y", "p", ["target"])
    slot = F.least(F.floor(F.col("p") * 10), F.lit(9))
    bins = long.groupBy("target", slot.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(F.col("y").cast("int")) - F.avg("p")).alias("gap"))
    return ranked.join(bins.groupBy("target").agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece")), "target")


def boundary_overconfidence(df: DataFrame, boundary: str, top: str, decided: str, limit: float = 0.8) -> DataFrame:
    """Inside the boundary band: rows, share of confident decisions (top probability over the limit) that are not a warning."""
    inside = F.col(boundary)
    sure = inside & (F.col(top) >= limit) & (F.col(decided) != "warning")
    return df.agg(F.count_if(inside).alias("rows"), safe(F.count_if(sure), F.count_if(inside)).alias("overconfident"))


def decision_summary(df: DataFrame, decision: str, out: str, quality: str) -> DataFrame:
    """Per decision: rows, share, out-of-band share and mean quality."""
    rows = df.groupBy(decision).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(out).cast("int")).alias("out_rate"), F.avg(quality).alias("quality"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def entropy_summary(df: DataFrame, entropy: str, correct: str) -> DataFrame:
    """Mean entropy overall, of right and of wrong decisions."""
    return df.agg(F.avg(entropy).alias("mean"), F.avg(F.when(F.col(correct), F.col(entropy))).alias("right"), F.avg(F.when(~F.col(correct), F.col(entropy))).alias("wrong"))
