"""Time-ordered splits. Row positions come from a count per time bucket plus a rank inside it, never one global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.timeline import DAY, bucket


def positions(df: DataFrame, t: str = "t", order: str = "sample_id", width: int = DAY) -> DataFrame:
    """``pos`` (from 0) and ``total`` in time order: buckets are counted (a small relation), rows are ranked in their bucket."""
    rows = df.withColumn("_b", bucket(F.col(t), width))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_b", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_s"), F.sum("_c").over(Window.partitionBy()).alias("total"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(t, order)) - 1
    return rows.withColumn("_l", local).join(F.broadcast(shift), "_b").withColumn("pos", F.col("_l") + F.col("_s")).drop("_b", "_l", "_s")


def purged_split(samples: DataFrame, train: float, valid: float, purge: int, t: str = "t") -> DataFrame:
    """train / valid / test by the samples at int(n x ratio), with ``purge`` micros on both sides of a cut marked ``purged``."""
    placed = positions(samples, t)
    at = lambda r: F.max(F.when(F.col("pos") == F.floor(F.col("total") * F.lit(r)), F.col(t)))
    cuts = placed.agg(at(train).alias("_a"), at(train + valid).alias("_b"))
    split = (
        F.when(F.col(t) < F.col("_a") - purge, "train")
        .when((F.col(t) >= F.col("_a") + purge) & (F.col(t) < F.col("_b") - purge), "valid")
        .when(F.col(t) >= F.col("_b") + purge, "test")
        .otherwise("purged")
    )
    return placed.crossJoin(F.broadcast(cuts)).withColumn("split", split).drop("_a", "_b", "pos", "total")


def ratio_split(samples: DataFrame, train: float, valid: float, t: str = "t") -> DataFrame:
    placed = positions(samples, t)
    a, b = F.floor(F.col("total") * F.lit(train)), F.floor(F.col("total") * F.lit(train + valid))
    return placed.withColumn("split", F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "valid").otherwise("test")).drop("pos", "total")


def expanding_folds(samples: DataFrame, k: int, t: str = "t") -> DataFrame:
    """``fold`` of the test part a row belongs to (1..k), 0 for rows that only ever train: test size = n div (k + 1), and the
    training rows of a fold are all rows before it."""
    placed = positions(samples, t)
    size = F.floor(F.col("total") / (k + 1))
    start = F.col("total") - size * k
    fold = F.when(F.col("pos") < start, 0).otherwise(F.coalesce(F.floor(F.try_divide(F.col("pos") - start, size)), F.lit(-1)) + 1)
    return placed.withColumn("fold", fold.cast("int")).drop("pos", "total")


def leakage_audit(split: DataFrame, key: str, t: str = "t") -> DataFrame:
    """Keys in more than one split, and the gaps (minutes) between the splits' time ranges."""
    crossing = split.where("split <> 'purged'").groupBy(key).agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("crossing"))
    edge = lambda s, f: f(F.when(F.col("split") == s, F.col(t)))
    gaps = split.agg(
        ((edge("valid", F.min) - edge("train", F.max)) / F.lit(60e6)).alias("train_valid_gap"),
        ((edge("test", F.min) - edge("valid", F.max)) / F.lit(60e6)).alias("valid_test_gap"),
    )
    return crossing.crossJoin(F.broadcast(gaps))


#: Guards of the calibration tails: share of the training rows, least and most rows.
TAIL_POLICIES = {"fifth": (0.2, 20, None), "quarter": (0.25, 50, None), "small": (0.15, 30, 200), "third": (0.33, 10, None)}


def calibration_tail(samples: DataFrame, policy: str = "fifth", t: str = "t") -> DataFrame:
    """``part``: the last rows by time calibrate, the others train; four guard policies."""
    share, least, most = TAIL_POLICIES[policy]
    placed = positions(samples, t)
    size = F.greatest(F.floor(F.col("total") * F.lit(share)), F.lit(least))
    size = F.least(size, F.lit(most)) if most else size
    size = F.least(size, F.floor(F.col("total") / 2))
    return placed.withColumn("part", F.when(F.col("pos") >= F.col("total") - size, "calibration").otherwise("proper")).drop("pos", "total")


def month_scenarios(months: list[tuple[str, int]], min_train: int, min_valid: int, anomalies: frozenset[str] = frozenset()) -> list[dict]:
    """Rolling (train months, valid month, test month) with size guards; an anomalous month is never trained on or validated on."""
    out = []
    for i in range(2, len(months)):
        train = [m for m, _ in months[: i - 1] if m not in anomalies]
        rows = sum(n for m, n in months[: i - 1] if m not in anomalies)
        valid, test = months[i - 1], months[i]
        if rows >= min_train and valid[1] >= min_valid and valid[0] not in anomalies:
            out.append({"train": train, "valid": valid[0], "test": test[0]})
    return out


def fold_frames(df: DataFrame, fold: Column, k: int) -> list[tuple[DataFrame, DataFrame]]:
    """(training rows, test rows) of each expanding fold."""
    return [(df.where(fold < i), df.where(fold == i)) for i in range(1, k + 1)]
