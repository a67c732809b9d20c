"""Neighbours, matched comparisons and recommendations over a case base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.operators.cells import SLICE_ROWS, build_index, nearest
from tidegauge.operators.selection import exact_quantiles


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def scaled_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median-imputed, standardised (population std, 1 where zero) columns as one array ``z``; the fitted values are one row. Medians
    are selected, no task holds a column's values; ``df`` is read several times."""
    filled = df
    for c in columns:
        name = f"_m_{c}"
        filled = filled.crossJoin(F.broadcast(exact_quantiles(df.select(c), [], c, [0.5], [name]).agg(F.max(name).alias(name))))
    filled = filled.withColumns({f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns})
    moments = filled.agg(*[x for c in columns for x in (F.avg(f"_x_{c}").alias(f"_a_{c}"), F.stddev_pop(f"_x_{c}").alias(f"_s_{c}"))])
    z = F.array(*[(F.col(f"_x_{c}") - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns])
    return filled.crossJoin(F.broadcast(moments)).select(*df.columns, z.alias("z"))


def neighbours(queries: DataFrame, cases: DataFrame, k: int, exclude_self: bool = True, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``query_id, case_id, distance, rank``: the ``k`` cases nearest to each of a stated set of queries, by an exact index over
    the cases; both sides have ``id, z``."""
    index = build_index(cases.select("id", "z"), "euclidean", slice_rows)
    return nearest(queries.select("id", "z"), index, k, exclude_self=exclude_self).select("query_id", "case_id", "distance", "rank")


def nearest_centroid(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """The nearest of a few centroids (``stage, c``) for each row's ``z``, in one projection over a one-row array of centroids;
    distance ties go to the first stage name."""
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("stage", "c"))).alias("_c"))
    best = F.array_min(F.transform("_c", lambda x: F.struct(squared_distance(F.col("z"), x["c"]).alias("d"), x["stage"].alias("stage"))))
    return df.crossJoin(F.broadcast(packed)).withColumn("_b", best).withColumns({"stage": F.col("_b.stage"), "distance": F.sqrt("_b.d")}).drop("_b", "_c")


def stage_rows(cases: DataFrame, stage: str) -> DataFrame:
    """Cases of a stage, all of them if the stage has none."""
    n = cases.agg(F.count_if(F.col("stage") == stage).alias("_n"))
    return cases.crossJoin(F.broadcast(n)).where((F.col("stage") == stage) | (F.col("_n") == 0)).drop("_n")


def matched_shift(bad: DataFrame, good: DataFrame, features: Sequence[str], k: int, top: int) -> DataFrame:
    """Per bad row: median of the ``k`` nearest good rows minus the bad value, the ``top`` largest by size."""
    near = neighbours(bad.select("id", "z"), good.select("id", "z"), k)
    pairs = near.join(good.select(F.col("id").alias("case_id"), *[F.col(f).alias(f"_g_{f}") for f in features]), "case_id")
    medians = pairs.groupBy("query_id").agg(*[F.percentile(f"_g_{f}", F.lit(0.5)).alias(f"_g_{f}") for f in features])
    both = medians.join(bad.withColumnRenamed("id", "query_id"), "query_id")
    long = both.select("query_id", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"_g_{f}") - F.col(f)).alias("shift")) for f in features])))
    w = Window.partitionBy("query_id").orderBy(F.abs("shift").desc(), "feature")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def control_grid(spark, low: tuple[float, float], high: tuple[float, float], n: int) -> DataFrame:
    """n x n grid over two controls: ``a, b``."""
    step = [(h - l) / (n - 1) for l, h in zip(low, high, strict=True)]
    i, j = F.floor(F.col("id") / n), F.pmod("id", F.lit(n))
    return spark.range(n * n).select((F.lit(low[0]) + i * F.lit(step[0])).alias("a"), (F.lit(low[1]) + j * F.lit(step[1])).alias("b"))


def grid_recommendation(grid: DataFrame, probability: Column, anchor: tuple[float, float], threshold: float, fallback: int = 25) -> DataFrame:
    """Best point of a grid and the feasible ranges: points over the threshold, or the ``fallback`` most probable where none is;
    the point nearest to the anchor, the more probable on ties."""
    scored = grid.withColumns({"p": probability, "d": F.sqrt(F.pow(F.col("a") - anchor[0], F.lit(2.0)) + F.pow(F.col("b") - anchor[1], F.lit(2.0)))})
    n = scored.agg(F.count_if(F.col("p") >= threshold).alias("feasible"))
    top = scored.orderBy(F.col("p").desc(), "a", "b").limit(fallback)
    pool = scored.where(F.col("p") >= threshold).withColumn("k", F.lit(1)).unionByName(top.withColumn("k", F.lit(0))).crossJoin(F.broadcast(n))
    pool = pool.where(F.when(F.col("feasible") > 0, F.col("k") == 1).otherwise(F.col("k") == 0))
    best = F.min(F.struct("d", (-F.col("p")).alias("m"), "a", "b"))
    return pool.agg(
        best.alias("x"), F.min("a").alias("a_min"), F.max("a").alias("a_max"), F.min("b").alias("b_min"), F.max("b").alias("b_max"), F.max("feasible").alias("feasible")
    ).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), (-F.col("x.m")).alias("p"), "a_min", "a_max", "b_min", "b_max", "feasible")


def empirical_ranges(cases: DataFrame, controls: Sequence[str]) -> DataFrame:
    """p10 to p90 and the median per control, for where no local model can be fitted."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return cases.select(F.inline(F.array(*[F.struct(F.lit(c).alias("control"), F.col(c).cast("double").alias("v")) for c in controls]))).groupBy("control").agg(
        F.get(q("v"), F.lit(0)).alias("low"), F.get(q("v"), F.lit(1)).alias("best"), F.get(q("v"), F.lit(2)).alias("high")
    )


def delayed_library(queries: DataFrame, library: DataFrame, delay: int, blocked: Sequence[str] = ()) -> DataFrame:
    """Size of each query's label library: outcomes known ``delay`` before the query, months that are blocked left out. A union
    and one ordered sum per day bucket, with the buckets' totals carried over, instead of an inequality join."""
    day = lambda c: F.floor(c / F.lit(86_400_000_000)).cast("long")
    lib = library.where(~F.col("month").isin(list(blocked))) if blocked else library
    events = lib.select((F.col("t") + delay).alias("at"), F.lit(1).alias("n"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("query_id"))
    asks = queries.select(F.col("t").alias("at"), F.lit(0).alias("n"), F.lit(1).alias("side"), F.col("id").cast("long").alias("query_id"))
    both = events.unionByName(asks).withColumn("d", day(F.col("at")))
    totals = both.groupBy("d").agg(F.sum("n").alias("s"))
    carried = totals.select("d", F.coalesce(F.sum("s").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("d").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("local", F.sum("n").over(w)).join(F.broadcast(carried), "d").where("side = 1").select("query_id", (F.col("local") + F.col("before")).alias("library"))


def kernel_blend(near: DataFrame, half_life_days: float) -> DataFrame:
    """Weighted mean outcome per query over its neighbours (``query_id, distance, age_days, weight, y``): kernel
    exp(-d / median d) x recency exp(-age / h) x weight, and Kish's effective count."""
    med = F.percentile("distance", F.lit(0.5)).over(Window.partitionBy("query_id"))
    w = F.exp(-F.col("distance") / F.greatest(F.col("med"), F.lit(1e-9))) * F.exp(-F.col("age_days") / half_life_days) * F.col("weight")
    return near.withColumn("med", med).withColumn("w", w).groupBy("query_id").agg(
        (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("estimate"), (F.pow(F.sum("w"), F.lit(2.0)) / F.sum(F.col("w") * F.col("w"))).alias("effective_n")
    )


def range_bounds(payload: Column) -> tuple[Column, Column]:
    """(min, max) out of the three encodings of a range in a JSON payload: min/max, low/high, or an array of two."""
    get = lambda *p: F.coalesce(*[F.get_json_object(payload, x) for x in p]).cast("double")
    return get("$.min", "$.low", "$[0]"), get("$.max", "$.high", "$[1]")
