"""Delayed-label learning, score fusion and guarded choices: compositions of the retrieval, model and metric operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.timeline import DAY
from tidegauge.operators import planes
from tidegauge.operators.aggregates import robust_reference
from tidegauge.operators.cells import build_index, nearest
from tidegauge.operators.columns import to_long
from tidegauge.operators.huber import local_boosting_many
from tidegauge.operators.metrics import ranked_metrics, safe
from tidegauge.operators.ranking import choose
from tidegauge.sources.scratch import stored


def robust_vectors(df: DataFrame, reference: DataFrame, key: list[str], features: Sequence[str]) -> DataFrame:
    """``z``: robust z-scores of the features in name order, 0 for a missing value."""
    long = to_long(df, key, list(features)).join(F.broadcast(reference), "feature")
    z = F.coalesce((F.col("value") - F.col("median")) / F.col("scale"), F.lit(0.0))
    listed = long.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("feature", z.alias("z")))).alias("_l"))
    return listed.select(*key, F.transform("_l", lambda x: x["z"]).alias("z"))


def delayed_neighbours(
    queries: DataFrame, library: DataFrame, features: Sequence[str], k: int, delay: int, half_life_days: float, min_rows: int, fallback: Column,
    model_weight: float | None = None, trees: int = 60, blocked: Sequence[str] = (),
) -> DataFrame:
    """``id, estimate, effective_n, neighbours, route`` per query (``id, t``, features): the weighted outcome ``y`` of the ``k`` nearest
    library rows whose outcome is known ``delay`` before the query. Distance is the median of |z-differences|; weights are
    exp(-d / median d) x exp(-age / half life). With fewer than ``min_rows`` known rows the fallback score answers. Library rows
    whose ``month`` is ``blocked`` are never known.

    With ``model_weight`` three columns follow: ``local_model`` (boosted trees with a Huber loss on the neighbours, cut to 0..1),
    ``local_mean`` (the estimate, cut alike) and ``local_blend`` (their mean by that weight).

    The library is indexed: in planes (``planes``) where there are three features, else by cells and time (``cells``). A query visits
    only pieces that begin ``delay`` before it and whose bound does not exceed its k-th distance. Both tables are read several times:
    store them where they are costly.
    """
    known = library.where(~F.col("month").isin(list(blocked))) if blocked else library
    ref = robust_reference(to_long(known, ["id"], list(features)))
    ref = stored(ref, "reference")
    q = stored(robust_vectors(queries, ref, ["id", "t"], features), "queries")
    vectors = robust_vectors(known, ref, ["id", "t", "y"], features)
    if len(features) == 3:
        near = planes.nearest(q, vectors, k, delay, with_z=model_weight is not None)
    else:
        near = nearest(q, build_index(vectors, "median"), k, delay, with_z=model_weight is not None)
    day = F.lit(float(DAY))
    near = near.join(q.select(F.col("id").alias("query_id"), F.col("t").alias("query_t"), F.col("z").alias("query_z")), "query_id")
    med = F.percentile("distance", F.lit(0.5)).over(Window.partitionBy("query_id"))
    age = F.greatest((F.col("query_t") - F.col("t")) / day, F.lit(0.0))
    w = F.exp(-F.col("distance") / F.greatest(F.col("m"), F.lit(1e-6))) * F.exp(-age / max(half_life_days, 1.0))
    weighed = near.withColumn("m", med).withColumn("w", w)
    rows = [F.sort_array(F.collect_list(F.struct("rank", "y", "w", "z"))).alias("_rows"), F.first("query_z").alias("_z")]  # ``k`` at most
    blended = weighed.groupBy("query_id").agg(
        F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum("w")).alias("_e"),
        F.try_divide(F.pow(F.sum("w"), F.lit(2.0)), F.sum(F.col("w") * F.col("w"))).alias("effective_n"),
        F.count(F.lit(1)).alias("neighbours"),
        *(rows if model_weight is not None else []),
    )
    enough = F.coalesce(F.col("neighbours"), F.lit(0)) >= min_rows
    cut = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    local = []
    if model_weight is not None:
        blended = _boosted(blended, trees, min_rows)
        model, mean = cut(F.col("_b")), cut(F.col("_e"))
        local = [
            F.when(enough, model).otherwise(fallback).alias("local_model"),
            F.when(enough, mean).otherwise(fallback).alias("local_mean"),
            F.when(enough, cut(model_weight * model + (1 - model_weight) * mean)).otherwise(fallback).alias("local_blend"),
        ]
    out = queries.join(blended, queries["id"] == blended["query_id"], "left")
    return out.select(
        "id",
        F.when(enough, F.col("_e")).otherwise(fallback).alias("estimate"),
        "effective_n",
        F.coalesce("neighbours", F.lit(0)).alias("neighbours"),
        F.when(enough, "local").otherwise("static").alias("route"),
        *local,
    )


#: Queries whose local models are fitted side by side.
MODELS = 512


def _boosted(blended: DataFrame, trees: int, min_rows: int) -> DataFrame:
    """``blended`` with ``_b``, the local model at each query with ``min_rows`` neighbours, in place of the neighbours' ``_rows``."""
    keep = ["query_id", "_e", "effective_n", "neighbours"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, MODELS):
                some = batch.slice(lo, MODELS)
                n = some.column("_rows").value_lengths().to_numpy()
                rows, at = some.column("_rows").flatten(), np.arange(n.max()) < n[:, None]
                z = np.zeros((*at.shape, len(some.column("_z")[0])))
                y, w = np.zeros(at.shape), np.zeros(at.shape)
                z[at] = rows.field("z").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                y[at], w[at] = rows.field("y").to_numpy(zero_copy_only=False), rows.field("w").to_numpy(zero_copy_only=False)
                own = some.column("_z").flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)
                value, enough = np.zeros(len(n)), n >= min_rows
                if enough.any():
                    value[enough] = local_boosting_many(z[enough], y[enough], w[enough], n[enough], own[enough], trees)
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in keep], pa.array(value, mask=~enough)], [*keep, "_b"])

    return blended.mapInArrow(fit, "query_id long, _e double, effective_n double, neighbours long, _b double")


def fusion_weights(df: DataFrame, a: str, b: str, actual: str, weights: Sequence[float]) -> DataFrame:
    """Brier score of ``w a + (1 - w) b`` per fixed weight, best first column-wise: one aggregate over the rows, no copies of them."""
    y = F.col(actual).cast("double")
    rows = [F.struct(F.lit(float(w)).alias("weight"), F.avg(F.pow(w * F.col(a) + (1 - w) * F.col(b) - y, F.lit(2.0))).alias("brier")) for w in weights]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def best_fusion_weight(df: DataFrame, a: str, b: str, actual: str, weights: Sequence[float]) -> float:
    """The weight with the lowest Brier score (1e-12 ties by average precision, then the smaller weight)."""
    scored = sorted((r["brier"], r["weight"]) for r in fusion_weights(df, a, b, actual, weights).collect())
    tied = [w for s, w in scored if s - scored[0][0] <= 1e-12]
    if len(tied) == 1:
        return tied[0]
    fused = lambda w: df.withColumn("_s", w * F.col(a) + (1 - w) * F.col(b))
    return max(tied, key=lambda w: (ranked_metrics(fused(w), actual, "_s").first()["ap"] or 0.0, -w))


def guardrail_grid(df: DataFrame, out: str, fused: str, a: str, b: str, tau_low: float, a_ceilings: Sequence[float], b_ceilings: Sequence[float]) -> DataFrame:
    """Low-risk rate, false-clear rate and Brier score for every pair of ceilings, in one aggregate over the rows."""
    actual, y = F.col(out), F.col(out).cast("double")
    rows = []
    for x in a_ceilings:
        for z in b_ceilings:
            lifted = F.when((F.col(fused) < tau_low) & ((F.col(a) > x) | (F.col(b) > z)), F.lit(tau_low)).otherwise(F.col(fused))
            clear = lifted < tau_low
            rows.append(
                F.struct(
                    F.lit(float(x)).alias("a_ceiling"),
                    F.lit(float(z)).alias("b_ceiling"),
                    F.avg(clear.cast("int")).alias("low_rate"),
                    safe(F.count_if(actual & clear), F.count_if(actual)).alias("false_clear"),
                    F.avg(F.pow(lifted - y, F.lit(2.0))).alias("brier"),
                )
            )
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def best_guardrail(grid: DataFrame, max_false_clear: float) -> DataFrame:
    """The pair with the highest low-risk rate whose false-clear rate is in the limit, then the lowest Brier score; without one the
    smallest ceilings (``feasible`` false)."""
    order = [F.col("low_rate").desc(), F.col("brier"), F.col("a_ceiling"), F.col("b_ceiling")]
    return choose(grid, F.col("false_clear") <= max_false_clear, order, [F.col("a_ceiling"), F.col("b_ceiling")])


def lag_correlations(snapshots: DataFrame, target: str, lags: Sequence[int], value: str) -> DataFrame:
    """Correlation of each lagged column ``{value}__lag{m}`` with the target and its number of pairs, one row per lag."""
    rows = [F.struct(F.lit(m).alias("lag"), F.corr(f"{value}__lag{m}", target).alias("corr"), F.count(f"{value}__lag{m}").alias("n")) for m in lags]
    return snapshots.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def cluster_membership(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """Distances to a few centroids (``stage, c``), the margin between the nearest two, and inverse-distance soft membership."""
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("stage", "c"))).alias("_c"))
    dist = F.transform("_c", lambda x: F.sqrt(F.aggregate(F.zip_with("z", x["c"], lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)))
    rows = df.crossJoin(F.broadcast(packed)).withColumn("distances", dist)
    inverse = F.transform("distances", lambda d: 1 / (d + F.lit(1e-9)))
    total = F.aggregate("_i", F.lit(0.0), lambda s, v: s + v)
    ordered = F.array_sort("distances")
    return rows.withColumn("_i", inverse).withColumns(
        {"membership": F.transform("_i", lambda v: v / total), "margin": F.get(ordered, F.lit(1)) - F.get(ordered, F.lit(0))}
    ).drop("_c", "_i")


def label_summary(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def inner_candidates(folds: DataFrame, default: Column, tolerance: float) -> DataFrame:
    """Candidate choice on inner folds (``candidate, macro_f1, balanced, risk`` per fold): means over folds; eligible are those within
    the tolerance of the default in both quality metrics; of them the lowest mean risk, then the best F1, then the name."""
    mean = folds.groupBy("candidate").agg(*[F.avg(c).alias(c) for c in ("macro_f1", "balanced", "risk")])
    base = mean.where(default).select(F.col("macro_f1").alias("_f"), F.col("balanced").alias("_b"))
    marked = mean.crossJoin(F.broadcast(base)).withColumn("_ok", (F.col("macro_f1") >= F.col("_f") - tolerance) & (F.col("balanced") >= F.col("_b") - tolerance))
    return choose(marked, F.col("_ok"), [F.col("risk"), F.col("macro_f1").desc(), F.col("candidate")]).drop("_f", "_b", "_ok")


def logistic_fusion(calibration: DataFrame, df: DataFrame, a: str, b: str, actual: str) -> DataFrame:
    """Fused score by a logistic model of both scores and their absolute difference, fitted on the calibration rows."""
    from tidegauge.operators.models import fit_binary

    made = lambda d: d.withColumn("_gap", F.abs(F.col(a) - F.col(b)))
    fit = fit_binary(made(calibration).withColumn("_y", F.col(actual).cast("int")).withColumnRenamed("_y", "_label"), [a, b, "_gap"], "_label", balanced=False)
    return fit.transform(made(df)).drop("_gap").withColumnRenamed("score", "fused")


def expanding_refits(df: DataFrame, features: Sequence[str], label: str, batch: str, first: int, last: int) -> DataFrame:
    """Scores of each release batch by a model of all batches before it; a batch without a fit is skipped."""
    from tidegauge.operators.models import Constant, fit_binary

    out = None
    for i in range(first, last + 1):
        model = fit_binary(df.where(F.col(batch) < i), features, label)
        if isinstance(model, Constant):
            continue
        part = model.transform(df.where(F.col(batch) == i))
        out = part if out is None else out.unionByName(part)
    return out


def stage_counts(df: DataFrame, features: Sequence[str], counts: Sequence[int], min_rows: int) -> list[dict]:
    """Silhouette (squared Euclidean) and smallest cluster per number of regimes; ``chosen`` has the best silhouette among those with
    large enough clusters, the smaller number on ties."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df.na.drop(subset=list(features))).select("_x").cache()
    out = []
    for k in counts:
        placed = KMeans(featuresCol="_x", predictionCol="regime", k=k, seed=42).fit(rows).transform(rows)
        smallest = placed.groupBy("regime").count().agg(F.min("count")).first()[0]
        out.append({"k": k, "silhouette": ClusteringEvaluator(featuresCol="_x", predictionCol="regime").evaluate(placed), "smallest": smallest})
    good = [r for r in out if r["smallest"] >= min_rows]
    best = max(good, key=lambda r: (r["silhouette"], -r["k"])) if good else None
    return [{**r, "chosen": r is best} for r in out]


def pick_sample(df: DataFrame, t: str, at: int | None = None, bad: str | None = None) -> DataFrame:
    """The sample at exactly ``at`` (an error without one), else the latest, or the latest where ``bad`` holds."""
    if at is not None:
        hit = df.where(F.col(t) == at).limit(1)
        if hit.isEmpty():
            raise ValueError(f"no sample at {at}")
        return hit
    return (df.where(F.col(bad)) if bad else df).orderBy(F.col(t).desc()).limit(1)
