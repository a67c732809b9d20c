"""Group summaries: partial aggregation on the map side everywhere, no collected groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.operators.selection import exact_quantiles, running_totals
from tidegauge.sources.scratch import stored


def first_non_null(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """Per key and column the first value that is not null, by ``order``."""
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in columns]
    return df.groupBy(*keys).agg(*firsts)


def repeat_stats(df: DataFrame, key: str, target: str, tag: str, context: list[str]) -> DataFrame:
    """Repeats of a measurement: mean, count, population std, sorted distinct tags joined by a bar, rows, context means and counts;
    keys without a target go."""
    return (
        df.groupBy(key)
        .agg(
            F.avg(target).alias("mean"),
            F.count(target).alias("n"),
            F.stddev_pop(target).alias("std"),
            F.array_join(F.array_sort(F.collect_set(tag)), "|").alias("tags"),
            F.count(F.lit(1)).alias("rows"),
            *[x for c in context for x in (F.avg(c).alias(f"{c}_mean"), F.count(c).alias(f"{c}_n"))],
        )
        .where("n > 0")
    )


def range_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Five quantiles, least and greatest value per group."""
    names = ("p10", "p25", "median", "p75", "p90")
    ends = df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    return joined_quantiles(ends, df, by, value, (0.1, 0.25, 0.5, 0.75, 0.9), names)


def joined_quantiles(table: DataFrame, df: DataFrame, by: list[str], value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """``table`` (a row for each group) with exact quantiles of ``df``'s values; NULL for a group without any."""
    found = exact_quantiles(df, by, value, probs, names).withColumnsRenamed({c: f"_q_{c}" for c in by})
    if not by:
        return table.crossJoin(F.broadcast(found))  # a row each
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return table.join(found, on, "left").drop(*[f"_q_{c}" for c in by])


def row_stats(columns: list[str]) -> dict[str, Column]:
    """Mean, sample std, min and max across columns of a row, nulls left out."""
    v = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    n = F.size(v)
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x))
    mean = F.when(n > 0, total(lambda x: x) / n)
    return {
        "mean": mean,
        "std": F.when(n > 1, F.sqrt(total(lambda x: (x - mean) * (x - mean)) / (n - 1))),
        "min": F.array_min(v),
        "max": F.array_max(v),
    }


def feature_audit(long: DataFrame, target: str, name: str = "feature", value: str = "value") -> DataFrame:
    """Mergeable audit per feature: valid and missing counts, mean, population std, min, max and correlation with the target."""
    v = F.col(value)
    return long.groupBy(name).agg(
        F.count(v).alias("valid"),
        (1 - F.count(v) / F.count(F.lit(1))).alias("missing_rate"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.corr(v, F.col(target)).alias("corr"),
    )


def group_shifts(long: DataFrame, group: str, k: int, name: str = "feature", value: str = "value") -> DataFrame:
    """Top ``k`` features per group by |group mean - overall mean|."""
    sums = long.groupBy(group, name).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    overall = sums.groupBy(name).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("overall"))
    shifts = sums.join(overall, name).withColumn("shift", F.try_divide("s", "n") - F.col("overall"))
    w = Window.partitionBy(group).orderBy(F.abs("shift").desc(), name)
    return shifts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(group, name, "shift", "rank")


def roll_up_scores(scores: DataFrame, part: str, score: str = "score", name: str = "feature") -> DataFrame:
    """Feature scores rolled up to sensors or statistics: count, best feature, max, mean, median."""
    table = scores.groupBy(part).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct(F.col(score), F.col(name)))[name].alias("best"),
        F.max(score).alias("max_score"),
        F.avg(score).alias("mean_score"),
    )
    return joined_quantiles(table, scores, [part], score, [0.5], ["median_score"])


def average_rank(df: DataFrame, part: list[str], value: str, out: str) -> DataFrame:
    """Average rank of ``value`` within ``part`` (ties share it). Values are counted first, so ties never meet in a list, and summed
    in ranges, so no task orders all of them."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counted, part, value, ["_n"]).withColumn("_r", F.col("_n_before") + (F.col("_n") + 1) / 2)
    ranks = placed.select(*[F.col(p).alias(f"_k{i}") for i, p in enumerate(part)], F.col(value).alias("_v"), "_r")
    match = F.col(value) == F.col("_v")
    for i, p in enumerate(part):
        match = match & F.col(p).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ranks, match).drop(*[f"_k{i}" for i in range(len(part))], "_v").withColumnRenamed("_r", out)


def spearman(df: DataFrame, part: list[str], x: str, y: str, min_rows: int = 3) -> DataFrame:
    """Rank correlation per part over rows with both values; NULL below ``min_rows`` rows or two distinct values."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*part, x, y)
    ranked = average_rank(average_rank(both, part, x, "_rx"), part, y, "_ry")
    ok = (F.count(F.lit(1)) >= min_rows) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return ranked.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.when(ok, F.corr("_rx", "_ry")).alias("spearman"))


def stability(splits: DataFrame, feature: str = "feature", split: str = "split", score: str = "spearman", max_range: float = 0.4) -> DataFrame:
    """Sign flips and range of a score over splits, with the reasons joined."""
    out = splits.groupBy(feature).agg(
        F.min(score).alias("low"), F.max(score).alias("high"), (F.min(F.signum(score)) < 0).alias("_neg"), (F.max(F.signum(score)) > 0).alias("_pos")
    )
    flip, wide = F.col("_neg") & F.col("_pos"), F.col("high") - F.col("low") > max_range
    return out.withColumn("reasons", F.concat_ws(";", F.when(flip, "sign_flip"), F.when(wide, "wide_range"))).drop("_neg", "_pos")


def interarrival(df: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """Median, p10 and p90 of the gaps (minutes) between a key's rows."""
    gap = (F.col(t) - F.lag(t).over(Window.partitionBy(*by).orderBy(t))) / F.lit(60e6)
    return exact_quantiles(df.select(*by, gap.alias("gap")), by, "gap", [0.1, 0.5, 0.9], ["p10", "median", "p90"])


def weighted_shares(df: DataFrame, keys: list[str], period: str, weight: str, n: int, order: list[str] | None = None) -> DataFrame:
    """Weights summed by period, the top ``n`` normalised, as one map per key (bounded by ``n``); the earlier period comes first on ties.

    The last bit of a float sum depends on the order of the rows. With ``order`` a period's weights are added one by one in that
    order and the sums are ranked as they are. Without it sums that are equal to six digits tie."""
    if order:
        running = F.sum(weight).over(Window.partitionBy(*keys, period).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = df.withColumn("_w", running).groupBy(*keys, period).agg(F.max_by("_w", F.struct(*order)).alias("w"))
    else:
        sums = df.groupBy(*keys, period).agg(F.sum(weight).alias("w"))
    by = F.col("w") if order else F.round("w", 6)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(by.desc(), period))
    top = sums.withColumn("rn", rank).where(F.col("rn") <= n)
    share = F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy(*keys)))
    return top.withColumn("share", share).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(period, "share")))).alias("shares"))


def period_shares(shares: Column, now: Column, before: Column) -> dict[str, Column]:
    """Current, previous and older shares of a period map."""
    current, previous = F.coalesce(F.try_element_at(shares, now), F.lit(0.0)), F.coalesce(F.try_element_at(shares, before), F.lit(0.0))
    total = F.aggregate(F.map_values(shares), F.lit(0.0), lambda a, v: a + v)
    return {"share_now": current, "share_before": previous, "share_older": total - current - previous}


def robust_reference(long: DataFrame, name: str = "feature", value: str = "value") -> DataFrame:
    """Median and MAD per feature, with the std and then 1 as fallback scales."""
    med = joined_quantiles(long.groupBy(name).agg(F.stddev_pop(value).alias("std")), long, [name], value, [0.5], ["median"])
    med = stored(med, "medians")
    off = long.join(med.select(name, "median"), name).select(name, F.abs(F.col(value) - F.col("median")).alias("off"))
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("std") > 0, F.col("std")).otherwise(1.0)
    return joined_quantiles(med, off, [name], "off", [0.5], ["mad"]).select(name, "median", "mad", scale.alias("scale"))


def shift_scores(long: DataFrame, reference: DataFrame, key: str, name: str = "feature", value: str = "value", cap: float = 20.0) -> DataFrame:
    """Per row the median of |robust z| over its features, capped; the reference has a row per feature."""
    z = F.least(F.abs(F.col(value) - F.col("median")) / F.col("scale"), F.lit(cap)).alias("shift")
    return exact_quantiles(long.join(reference, name).select(key, z), [key], "shift", [0.5], ["shift"])


def drift_flags(scored: DataFrame, calibration: Column, period: str, score: str = "shift") -> DataFrame:
    """Rows with the calibration part's p90 and p95, the period's median score, and ``confidence``. Where no calibration row has a
    score the two are null and every row is of high confidence."""
    cuts = exact_quantiles(scored.where(calibration), [], score, [0.9, 0.95], ["p90", "p95"])
    cuts = cuts.agg(F.max("p90").alias("p90"), F.max("p95").alias("p95"))  # one row, whatever there is
    by = exact_quantiles(scored, [period], score, [0.5], ["period_median"])
    level = F.when(F.col(score) >= F.col("p95"), "low").when(F.col(score) >= F.col("p90"), "medium").otherwise("high")
    return scored.join(by, period).crossJoin(F.broadcast(cuts)).withColumn("confidence", level)


def accuracy_summary(df: DataFrame, group: list[str], error: str, covered: str) -> DataFrame:
    table = df.groupBy(*group).agg(
        F.count(error).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.max(F.abs(error)).alias("max_error"),
        F.avg(F.col(covered).cast("int")).alias("coverage"),
    )
    sizes = df.select(*group, F.abs(error).alias("_e"))
    return joined_quantiles(table, sizes, group, "_e", [0.5, 0.9], ["median_error", "p90_error"]).select(
        *group, "n", "mae", "median_error", "p90_error", "max_error", "coverage"
    )


def pivot_mean(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, columns).agg(F.avg(value))
