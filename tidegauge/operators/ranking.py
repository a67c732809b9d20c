"""Lexicographic choices, top-k per group, and the greedy pick over a small correlation matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, part: list[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def choose(df: DataFrame, feasible: Column, order: Sequence[Column], relaxed: Sequence[Column] | None = None) -> DataFrame:
    """The first row by ``order`` among the feasible ones; without any, the first by ``relaxed``. Adds ``feasible``. The limit
    is a top-1 of every task, no full sort."""
    marked = df.withColumn("feasible", F.coalesce(feasible, F.lit(False)))
    if relaxed is None:
        return marked.orderBy(F.col("feasible").desc(), *order).limit(1)
    good = marked.where("feasible").orderBy(*order).limit(1).withColumn("_p", F.lit(0))
    rest = marked.orderBy(*relaxed).limit(1).withColumn("_p", F.lit(1))
    return good.unionByName(rest).orderBy("_p").limit(1).drop("_p")


def best_curve_points(curve: DataFrame, part: list[str], target_precision: float = 0.8, target_recall: float = 0.8) -> DataFrame:
    """Per part: best F1, best precision at the wanted recall, and the point closest to both wanted values."""
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    gap = F.sqrt(F.pow(F.col("precision") - target_precision, F.lit(2.0)) + F.pow(F.col("recall") - target_recall, F.lit(2.0)))
    rows = curve.withColumns({"f1": f1, "gap": gap})
    key = lambda *c: F.struct(*c)
    m = -F.col("score")
    return rows.groupBy(*part).agg(
        (-F.max(key(F.col("f1"), F.col("recall"), m.alias("m")))["m"]).alias("best_f1"),
        (-F.max(F.when(F.col("recall") >= target_recall, key(F.col("precision"), F.col("recall"), m.alias("m"))))["m"]).alias("best_precision"),
        (-F.max(key((-F.col("gap")).alias("g"), m.alias("m")))["m"]).alias("closest"),
    )


def feasible_or_top(grid: DataFrame, probability: str, threshold: float, distance: Column, fallback: int = 25) -> DataFrame:
    """The point nearest to the anchor among those over the threshold, or among the ``fallback`` most probable if none is."""
    ranked = grid.withColumns({"_d": distance, "_ok": F.col(probability) >= threshold})
    state = ranked.agg(F.max("_ok").alias("_any"))
    short = ranked.orderBy(F.col(probability).desc(), *[c for c in grid.columns if c != probability]).limit(fallback).withColumn("_top", F.lit(True))
    pool = ranked.where("_ok").withColumn("_top", F.lit(False)).unionByName(short).crossJoin(F.broadcast(state)).where(F.col("_top") != F.col("_any"))
    return pool.orderBy("_d", F.col(probability).desc()).limit(1).drop("_d", "_ok", "_top", "_any")


def greedy_prune(ranking: list[tuple[str, float]], corr: dict[tuple[str, str], float], limit: float, k: int, inclusive: bool = True) -> list[str]:
    """Features by falling score, taken while |correlation| with all taken ones is at most (or below) ``limit``; missing
    correlations count as 0. The matrix of one column list is small and sits on the driver."""
    kept: list[str] = []
    for name, _ in sorted(ranking, key=lambda r: (-abs(r[1]), r[0])):
        pairs = [abs(corr.get((name, o), corr.get((o, name), 0.0)) or 0.0) for o in kept]
        if all(p <= limit if inclusive else p < limit for p in pairs):
            kept.append(name)
        if len(kept) == k:
            break
    return kept


def select_reduced(df: DataFrame, features: list[str], target: str, limit: float, k: int) -> list[str]:
    """``greedy_prune`` over correlations computed in one aggregate job."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = df.agg(*[F.corr(f, target).alias(f"t{i}") for i, f in enumerate(features)], *[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    ranking = [(f, row[f"t{i}"] or 0.0) for i, f in enumerate(features)]
    return greedy_prune(ranking, {p: row[f"p{i}"] for i, p in enumerate(pairs)}, limit, k)


def default_deltas(df: DataFrame, is_default: Column, metrics: list[str]) -> DataFrame:
    """Metric differences to the default candidate (one row)."""
    base = df.where(is_default).select(*[F.col(m).alias(f"_{m}") for m in metrics]).limit(1)
    return df.crossJoin(F.broadcast(base)).withColumns({f"delta_{m}": F.col(m) - F.col(f"_{m}") for m in metrics}).drop(*[f"_{m}" for m in metrics])


def composite_score(df: DataFrame) -> Column:
    """Fixed weights over errors, coverages, success and the sample ratio (relative to the largest)."""
    ratio = F.col("samples") / F.max("samples").over(Window.partitionBy())
    return (
        0.35 / (1 + F.col("mae_a") / 0.05)
        + 0.15 / (1 + F.col("mae_b") / 0.025)
        + 0.20 * F.col("cov_a")
        + 0.10 * F.col("cov_b")
        + 0.10 * F.col("success")
        + 0.10 * ratio
    )


def enable_policy(best: DataFrame, min_gain: float, max_lag: float) -> DataFrame:
    return best.withColumn("enabled", (F.col("gain") >= min_gain) & (F.col("lag") <= max_lag))
