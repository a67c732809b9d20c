"""Window slices: all stream rows in ``[t - lag - W, t - lag]`` of a sample, and the statistics over them.

The interval join is an equi-join on time buckets of width W (a sample asks its own bucket and the one before) with the
exact inclusive bounds as residual, so no nested loop appears whatever the sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.timeline import MINUTE, bucket, halo
from tidegauge.operators.selection import exact_quantiles


def slice_join(samples: DataFrame, stream: DataFrame, width: int, lag: int | Column = 0, by: list[str] | None = None) -> DataFrame:
    """``sample_id, sample_t, t, value`` and the stream's other columns, for every stream row inside a sample's slice."""
    by = by or []
    lag = lag if isinstance(lag, Column) else F.lit(lag)
    keys = [c for c in samples.columns if c not in ("t", "value")]
    ask = samples.select(*keys, (F.col("t") - lag).alias("sample_t"))
    ask = ask.withColumn("_b", F.explode(F.array(bucket(F.col("sample_t"), width), bucket(F.col("sample_t"), width) - 1)))
    rows = stream.withColumn("_b", bucket(F.col("t"), width)).drop(*[c for c in keys if c not in by and c in stream.columns])
    inside = (F.col("t") <= F.col("sample_t")) & (F.col("t") >= F.col("sample_t") - F.lit(width))
    return ask.join(rows, ["_b", *by]).where(inside).drop("_b")


def minutes() -> Column:
    """Minutes from the sample (negative): small numbers keep the regression well conditioned."""
    return (F.col("t") - F.col("sample_t")) / F.lit(float(MINUTE))



def stat(name: str) -> Column:
    v, t = F.col("value"), F.struct("t", "value")
    ok = F.when(v.isNotNull(), t)
    return {
        "count": F.count(v),
        "rows": F.count(F.lit(1)),
        "last": F.max(ok)["value"],
        "first": F.min(ok)["value"],
        "mean": F.avg(v),
        "median": F.percentile(v, F.lit(0.5)),
        "std": F.stddev_pop(v),
        "min": F.min(v),
        "max": F.max(v),
        "range": F.max(v) - F.min(v),
        "delta": F.max(ok)["value"] - F.min(ok)["value"],
        "valid_ratio": F.count(v) / F.count(F.lit(1)),
        "slope": F.regr_slope(v, minutes()),
    }[name]


CORE_STATS = ["last", "mean", "std", "min", "max", "delta", "valid_ratio", "slope"]


def encode_slices(joined: DataFrame, keys: list[str], stats: list[str] | None = None, min_rows: int = 1, zero_undefined: bool = False) -> DataFrame:
    """One row per key with ``stats``; slices with fewer than ``min_rows`` valid values are dropped. ``zero_undefined`` gives 0
    for a slope without spread instead of NULL."""
    aggs = [stat(s).alias(s) for s in (stats or CORE_STATS)]
    out = joined.groupBy(*keys).agg(F.count("value").alias("_n"), *aggs).where(F.col("_n") >= min_rows).drop("_n")
    if zero_undefined:
        out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("slope", "delta") if c in out.columns})
    return out


def multi_window(samples: DataFrame, stream: DataFrame, widths: list[int], stats: list[str], by: list[str] | None = None) -> DataFrame:
    """Several windows (minutes) per sample, columns ``w{W}__{stat}``, from one join of the widest window."""
    joined = slice_join(samples, stream, max(widths) * MINUTE, by=by)
    wide = []
    for w in widths:
        inside = F.col("t") >= F.col("sample_t") - F.lit(w * MINUTE)
        value = F.when(inside, F.col("value"))
        for s in stats:
            agg = {"mean": F.avg(value), "count": F.count(value), "min": F.min(value), "max": F.max(value), "std": F.stddev_pop(value)}[s]
            wide.append(agg.alias(f"w{w}__{s}"))
    return joined.groupBy("sample_id").agg(*wide)


def sensor_lag_slices(samples: DataFrame, stream: DataFrame, lags: DataFrame, width: int) -> DataFrame:
    """Slices shifted by each sensor's own lag: ``lags(sensor, lag)`` is a small table, the samples are asked once per sensor."""
    asked = samples.crossJoin(F.broadcast(lags))
    return slice_join(asked, stream, width, F.col("lag"), by=["sensor"])


def dynamics(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Differences inside a slice: mean, population std, largest jump, sign changes of the non-zero differences, up and down
    ratios, lag-1 autocorrelation, difference std over level std."""
    w = Window.partitionBy(*keys).orderBy("t", "event_id")
    steps = joined.where("value is not null").withColumn("prev", F.lag("value").over(w)).withColumn("d", F.col("value") - F.col("prev"))
    signed = steps.withColumn("s", F.when(F.col("d") != 0, F.signum("d"))).withColumn(
        "before", F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    )
    return signed.groupBy(*keys).agg(
        F.avg("d").alias("diff_mean"),
        F.stddev_pop("d").alias("diff_std"),
        F.max(F.abs("d")).alias("diff_max_abs"),
        F.count_if(F.col("s") != F.col("before")).alias("sign_changes"),
        F.try_divide(F.count_if(F.col("d") > 0), F.count("d")).alias("up_ratio"),
        F.try_divide(F.count_if(F.col("d") < 0), F.count("d")).alias("down_ratio"),
        F.corr("value", "prev").alias("autocorr"),
        (F.stddev_pop("d") / F.nullif(F.stddev_pop("value"), F.lit(0.0))).alias("std_ratio"),
    )


def data_quality(joined: DataFrame, keys: list[str], jump: float) -> DataFrame:
    """Missing ratio, valid count, longest frozen run, freeze ratio, largest jump, minutes since the last jump over ``jump``, and
    the population std of the update gaps (minutes)."""
    w = Window.partitionBy(*keys).orderBy("t", "event_id")
    rows = joined.withColumn("prev", F.lag("value").over(w)).withColumn("gap", (F.col("t") - F.lag("t").over(w)) / F.lit(float(MINUTE)))
    rows = rows.withColumn("same", F.coalesce(F.col("value") == F.col("prev"), F.lit(False)))
    rows = rows.withColumn("run", F.sum((~F.col("same")).cast("int")).over(w))
    rows = rows.withColumn("length", F.count(F.lit(1)).over(Window.partitionBy(*keys, "run")))
    step = F.abs(F.col("value") - F.col("prev"))
    return rows.groupBy(*keys).agg(
        (1 - F.count("value") / F.count(F.lit(1))).alias("missing_ratio"),
        F.count("value").alias("valid"),
        F.max("length").alias("longest_run"),
        (F.max("length") / F.count(F.lit(1))).alias("freeze_ratio"),
        F.max(step).alias("max_jump"),
        ((F.max("sample_t") - F.max(F.when(step > jump, F.col("t")))) / F.lit(float(MINUTE))).alias("minutes_since_jump"),
        F.stddev_pop("gap").alias("gap_std"),
    )


def centered(joined: DataFrame, keys: list[str], band: float = 1.0) -> DataFrame:
    """Z-scores inside the slice: mean |z|, share within ``band``, longest stay ratio, last z, mean of the last quarter of the rows,
    and reversion = -last z x slope of z per row."""
    part = Window.partitionBy(*keys)
    w = part.orderBy("t", "event_id")
    sd = F.stddev_pop("value").over(part)
    z = F.when(sd > 0, (F.col("value") - F.avg("value").over(part)) / sd).otherwise(0.0)
    rows = joined.where("value is not null").withColumns({"z": z, "rn": F.row_number().over(w), "n": F.count(F.lit(1)).over(part)})
    rows = rows.withColumn("inside", (F.abs("z") <= band).cast("int")).withColumn("out", F.sum(1 - F.col("inside")).over(w))
    rows = rows.withColumn("stay", F.sum("inside").over(Window.partitionBy(*keys, "out")))
    return rows.groupBy(*keys).agg(
        F.avg(F.abs("z")).alias("mean_abs_z"),
        F.avg("inside").alias("band_ratio"),
        (F.max("stay") / F.max("n")).alias("stay_ratio"),
        F.max_by("z", "rn").alias("last_z"),
        F.avg(F.when(F.col("rn") > F.col("n") - F.ceil(F.col("n") / 4), F.col("z"))).alias("tail_bias"),
        (-F.max_by("z", "rn") * F.coalesce(F.regr_slope("z", "rn"), F.lit(0.0))).alias("reversion"),
    )


def shape(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Quantiles, interquartile range, means of the three thirds (by row), their curvature, and where the extremes lie."""
    part = Window.partitionBy(*keys)
    rows = joined.where("value is not null").withColumns(
        {"rn": F.row_number().over(part.orderBy("t", "event_id")), "n": F.count(F.lit(1)).over(part)}
    )
    third = F.floor((F.col("rn") - 1) * 3 / F.col("n"))
    place = F.when(F.col("n") > 1, (F.col("rn") - 1) / (F.col("n") - 1)).otherwise(0.0)
    out = rows.groupBy(*keys).agg(
        F.percentile("value", F.lit(0.25)).alias("q25"),
        F.percentile("value", F.lit(0.5)).alias("q50"),
        F.percentile("value", F.lit(0.75)).alias("q75"),
        *[F.avg(F.when(third == k, F.col("value"))).alias(n) for k, n in enumerate(("head", "middle", "tail"))],
        F.min_by(place, F.struct(-F.col("value"), F.col("rn"))).alias("argmax_place"),
        F.min_by(place, F.struct("value", "rn")).alias("argmin_place"),
    )
    return out.withColumns({"iqr": F.col("q75") - F.col("q25"), "curvature": F.col("head") - 2 * F.col("middle") + F.col("tail")})


def ewma_slice(joined: DataFrame, keys: list[str], lam: float, min_valid: int = 3) -> DataFrame:
    """Exponential mean of the slice's valid values in time order (weight ``lam`` on the past, seeded at the first): last value,
    EWMA and their difference. The fold is over one slice, which the window bounds."""
    listed = joined.where("value is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "value"))).alias("v"))
    fold = F.aggregate(F.slice("v", 2, F.size("v")), F.get("v", F.lit(0))["value"], lambda a, x: lam * a + (1 - lam) * x["value"])
    out = listed.where(F.size("v") >= min_valid).select(*keys, F.element_at("v", -1)["value"].alias("last"), fold.alias("ewma"))
    return out.withColumn("last_minus_ewma", F.col("last") - F.col("ewma"))


def step_path(samples: DataFrame, stream: DataFrame, steps: int, step: int, by: list[str] | None = None) -> DataFrame:
    """Regular path before a sample: the last value of each of ``steps`` steps (micros), forward filled, ``p0`` the oldest."""
    joined = slice_join(samples, stream, steps * step - 1, by=by)
    k = (steps - 1 - F.floor((F.col("sample_t") - F.col("t")) / F.lit(step))).cast("int")
    last = joined.where("value is not null").withColumn("k", k).groupBy("sample_id", "k").agg(F.max(F.struct("t", "event_id", "value"))["value"].alias("v"))
    wide = last.groupBy("sample_id").agg(*[F.max(F.when(F.col("k") == i, F.col("v"))).alias(f"r{i}") for i in range(steps)])
    return wide.select("sample_id", *[F.coalesce(*[f"r{j}" for j in range(i, -1, -1)]).alias(f"p{i}") for i in range(steps)])


def rolling_grid(stream: DataFrame, by: list[str], width: int) -> DataFrame:
    """Left-open time windows ``(t - W, t]`` per key at every row: count, mean, std, min, max; parallel within a key by time
    buckets with a halo, so that a long stream of one sensor is not one task."""
    rows = halo(stream, "t", width)
    w = Window.partitionBy(*by, "_bucket").orderBy("t").rangeBetween(-(width - 1), 0)
    v = F.col("value")
    out = rows.withColumns({"n": F.count(v).over(w), "mean": F.avg(v).over(w), "std": F.stddev_pop(v).over(w), "min": F.min(v).over(w), "max": F.max(v).over(w)})
    return out.where("_own").drop("_own", "_bucket")


def interactions(wide: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Difference, absolute difference and ratio (NULL for a zero denominator) of column pairs."""
    made = {}
    for a, b in pairs:
        made |= {f"{a}_minus_{b}": F.col(a) - F.col(b), f"{a}_abs_{b}": F.abs(F.col(a) - F.col(b)), f"{a}_over_{b}": F.col(a) / F.nullif(F.col(b), F.lit(0.0))}
    return wide.withColumns(made)


def relative(features: DataFrame, mode: str = "full", eps: float = 1e-6) -> DataFrame:
    """Ratios among the statistics of a slice and the last value's place in the range."""
    f = F.col
    full = {
        "place": (f("last") - f("min")) / (f("max") - f("min") + eps),
        "std_over_mean": f("std") / (F.abs(f("mean")) + eps),
        "range_over_mean": (f("max") - f("min")) / (F.abs(f("mean")) + eps),
        "delta_over_std": f("delta") / (F.abs(f("std")) + eps),
        "last_minus_mean": f("last") - f("mean"),
    }
    names = {"full": list(full), "minimal": ["place", "std_over_mean"], "single": ["place"]}[mode]
    return features.withColumns({n: full[n] for n in names})


def key_change(path: DataFrame, columns: list[str]) -> DataFrame:
    """Change over a lag path (nearest first): nearest minus farthest, near pair minus far pair, and the least-squares slope per
    step over the present values (NULL with fewer than two)."""
    n = len(columns)
    v = F.array(*[F.col(c).cast("double") for c in columns])
    pts = F.filter(F.transform(v, lambda x, i: F.struct(i.cast("double").alias("i"), x.alias("x"))), lambda p: p["x"].isNotNull())
    total = lambda f: F.aggregate("_pts", F.lit(0.0), lambda a, p: a + f(p))
    m = F.size("_pts")
    mi, mx = F.try_divide(total(lambda p: p["i"]), m), F.try_divide(total(lambda p: p["x"]), m)
    var = total(lambda p: (p["i"] - mi) * (p["i"] - mi))
    slope = F.when((m >= 2) & (var > 0), total(lambda p: (p["i"] - mi) * (p["x"] - mx)) / var)
    pair = lambda a, b: (F.coalesce(F.col(a), F.col(b)) + F.coalesce(F.col(b), F.col(a))) / 2
    return path.withColumn("_pts", pts).withColumns(
        {
            "change": F.col(columns[0]) - F.col(columns[n - 1]),
            "near_minus_far": pair(columns[0], columns[1]) - pair(columns[n - 2], columns[n - 1]),
            "path_slope": slope,
        }
    ).drop("_pts")


def time_context(samples: DataFrame, ts: str) -> DataFrame:
    """Sine and cosine of the minute of the day and the day of the week (Monday 0), and three eight-hour shift flags."""
    minute, day = F.hour(ts) * 60 + F.minute(ts), F.weekday(ts)
    circle = lambda x, n: 2 * F.pi() * x / n
    return samples.withColumns(
        {
            "minute_sin": F.sin(circle(minute, 1440)),
            "minute_cos": F.cos(circle(minute, 1440)),
            "day_sin": F.sin(circle(day, 7)),
            "day_cos": F.cos(circle(day, 7)),
            **{f"shift_{k}": (F.floor(F.hour(ts) / 8) == k).cast("int") for k in range(3)},
        }
    )


def binned_information(features: DataFrame, feature: str, value: str, label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each feature's quantile bins with the label; long form. Edges are exact quantiles: a bin is the
    number of edges below the value."""
    names = [f"_e{i}" for i in range(1, bins)]
    edges = exact_quantiles(features, [feature], value, [i / bins for i in range(1, bins)], names)
    below = sum(((F.col(e) < F.col(value)).cast("int") for e in names), F.lit(0))
    counts = features.where(F.col(value).isNotNull()).join(edges, feature).groupBy(feature, below.alias("bin"), label).count()
    part = Window.partitionBy(feature)
    p = F.col("count") / F.sum("count").over(part)
    px = F.sum("count").over(Window.partitionBy(feature, "bin")) / F.sum("count").over(part)
    py = F.sum("count").over(Window.partitionBy(feature, label)) / F.sum("count").over(part)
    return counts.select(feature, (p * F.log(p / (px * py))).alias("mi")).groupBy(feature).agg(F.sum("mi").alias("mi"))


def segment_stats(joined: DataFrame, keys: list[str], edges: list[int]) -> DataFrame:
    """Mean and count per age segment of a slice: segment k holds rows with an age (micros) in [edges[k], edges[k + 1])."""
    age = F.col("sample_t") - F.col("t")
    aggs = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        v = F.when((age >= a) & (age < b), F.col("value"))
        aggs += [F.avg(v).alias(f"seg{k}__mean"), F.count(v).alias(f"seg{k}__count")]
    return joined.groupBy(*keys).agg(*aggs)


def drift_features(wide: DataFrame, short: str, long: str) -> DataFrame:
    """Short-window minus long-window mean, and the coefficient of variation where the mean is not zero."""
    return wide.withColumns({"drift": F.col(f"{short}__mean") - F.col(f"{long}__mean"), "cv": F.try_divide(F.col(f"{long}__std"), F.abs(F.col(f"{long}__mean")))})
