"""The public call: a request in, a recommendation out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import models, retrieval


@dataclass
class Recommendation:
    """``ranges``: best point and feasible range of both controls; ``neighbours``: the cases it rests on; ``warnings``: fallbacks taken."""

    stage: str | None
    ranges: DataFrame
    neighbours: DataFrame
    warnings: list[str] = field(default_factory=list)


def recommend_controls(
    cases: DataFrame,
    context: dict[str, float],
    controls: tuple[str, str],
    anchor: tuple[float, float],
    good: str = "is_in_spec",
    stages: DataFrame | None = None,
    neighbours: int = 150,
    threshold: float = 0.7,
    grid_points: int = 31,
) -> Recommendation:
    """Controls for the current ``context`` (feature -> value) out of a case base ``id``, features, both controls, ``good``.

    The nearest cases by standardised context are taken (of the context's stage, where ``stages(stage, c)`` centroids over the
    scaled context are given and the stage has cases), a local logistic model of ``good`` on both controls is fitted, a grid over
    the cases' control ranges is scored, and the feasible point nearest to ``anchor`` is the recommendation. With a single class
    among the neighbours the good cases' empirical ranges answer instead. ``anchor`` holds the reference controls.
    """
    spark, features, warnings = cases.sparkSession, sorted(context), []
    query = spark.createDataFrame([(-1, *[float(context[f]) for f in features])], "id long, " + ", ".join(f"{f} double" for f in features))
    both = retrieval.scaled_features(cases.select("id", *features).unionByName(query), features)
    scaled, asked = both.where("id >= 0"), both.where("id = -1")
    stage = None
    if stages is not None:
        stage = retrieval.nearest_centroid(asked, stages).first()["stage"]
        in_stage = retrieval.nearest_centroid(scaled, stages).where(F.col("stage") == stage)
        if in_stage.isEmpty():
            warnings.append(f"no case of stage {stage}: all cases are used")
        else:
            scaled = in_stage
    near = retrieval.neighbours(asked.select("id", "z"), scaled.select("id", "z"), neighbours, exclude_self=False)
    local = near.join(cases.withColumnRenamed("id", "case_id"), "case_id").cache()
    model = models.fit_binary(local, list(controls), good)
    if isinstance(model, models.Constant):
        warnings.append("the neighbours are of one class: empirical ranges")
        pool = local.where(F.col(good).cast("int") == 1) if model.p > 0 else local
        return Recommendation(stage, retrieval.empirical_ranges(pool, list(controls)), near, warnings)
    span = local.agg(*[f(c) for c in controls for f in (F.min, F.max)]).first()
    grid = retrieval.control_grid(spark, (float(span[0]), float(span[2])), (float(span[1]), float(span[3])), grid_points)
    scored = model.transform(grid.withColumnsRenamed({"a": controls[0], "b": controls[1]})).withColumnsRenamed({controls[0]: "a", controls[1]: "b"})
    best = retrieval.grid_recommendation(scored, F.col("score"), anchor, threshold)
    return Recommendation(stage, best, near, warnings)


def evaluate_recommendations(cases: DataFrame, features: list[str], control: str, good: str = "is_in_spec", k: int = 25) -> DataFrame:
    """Leave-one-out replay: for each case the median and p10-p90 range of the control among its ``k`` nearest good other cases,
    the absolute error and whether the range covers the case's own control. The replayed cases are a stated set (``replay``)."""
    scaled = retrieval.scaled_features(cases, features)
    asked = scaled.where("replay").select("id", "z")
    near = retrieval.neighbours(asked, scaled.where(F.col(good).cast("int") == 1).select("id", "z"), k)
    got = near.join(cases.select(F.col("id").alias("case_id"), F.col(control).alias("_c")), "case_id")
    q = F.percentile("_c", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    ranges = got.groupBy("query_id").agg(q.alias("_q")).select("query_id", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("low", "best", "high"))])
    own = cases.select(F.col("id").alias("query_id"), F.col(control).alias("actual"))
    return ranges.join(own, "query_id").withColumns({"error": F.abs(F.col("best") - F.col("actual")), "covered": F.col("actual").between(F.col("low"), F.col("high"))})


def example_request(spark, rows: int = 400) -> tuple[DataFrame, dict[str, float], tuple[float, float]]:
    """A runnable request without data files: a synthetic case base, a context and reference controls."""
    base = spark.range(rows).select("id", (F.col("id") % 7 * 1.0).alias("load__mean"), (F.col("id") % 31 / 3.0).alias("control_a"), (F.col("id") % 17 / 3.0).alias("control_b"))
    good = (F.col("control_a") - F.col("control_b") + 0.3 * F.sin("id") > 2).cast("int")
    return base.withColumn("is_in_spec", good), {"load__mean": 3.0}, (1.0, 4.0)
