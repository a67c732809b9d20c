"""Column screening: profiles computed in one job over the long form, decisions on the column list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.text import numeric


def boundary_filter(samples: DataFrame, stream: DataFrame, margin: int) -> DataFrame:
    """Samples with ``kept``: inside [min + margin, max - margin] of the stream's times; the range is one row."""
    span = stream.agg((F.min("t") + margin).alias("_lo"), (F.max("t") - margin).alias("_hi"))
    state = F.when(F.col("t") < F.col("_lo"), "before").when(F.col("t") > F.col("_hi"), "after").otherwise("kept")
    return samples.crossJoin(F.broadcast(span)).withColumn("state", state).drop("_lo", "_hi")


def to_long(df: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, name, value)


def profile(long: DataFrame, name: str = "feature", value: str = "value", digits: int = 10) -> DataFrame:
    """Per feature: rows, missing ratio, distinct values, share of the commonest value (rounded), mean, population std, min, max.
    Values are counted first, so a feature with one hot value is a map-side aggregate."""
    counted = long.groupBy(name, F.round(value, digits).alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("ok"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss")
    )
    rows, ok, mean = F.sum("n"), F.sum("ok"), F.try_divide(F.sum("s"), F.sum("ok"))
    return counted.groupBy(name).agg(
        rows.alias("rows"),
        (1 - ok / rows).alias("missing"),
        F.count("v").alias("distinct"),
        F.try_divide(F.max(F.when(F.col("v").isNotNull(), F.col("n"))), ok).alias("dominant"),
        mean.alias("mean"),
        F.sqrt(F.greatest(F.try_divide(F.sum("ss"), ok) - mean * mean, F.lit(0.0))).alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )


def screen(profiled: DataFrame, max_missing: float = 0.4, min_distinct: int = 2, max_dominant: float = 0.995, min_std: float = 1e-8) -> DataFrame:
    """``reason`` per feature: the first rule it breaks, NULL if it stays."""
    reason = (
        F.when(F.col("missing") >= 1, "all_missing")
        .when(F.col("missing") > max_missing, "missing")
        .when(F.col("distinct") < min_distinct, "constant")
        .when(F.col("dominant") >= max_dominant, "dominant")
        .when(F.col("std") <= min_std, "flat")
    )
    return profiled.withColumn("reason", reason)


def signatures(long: DataFrame, keys: list[str], name: str = "feature", value: str = "value", digits: int = 8) -> DataFrame:
    """An order-free signature per feature: XOR of hashes of (key, rounded value). Equal columns have equal signatures."""
    v = F.coalesce(F.round(value, digits) + 0.0, F.lit(float("nan")))
    return long.groupBy(name).agg(F.bit_xor(F.xxhash64(*keys, v)).alias("signature"), F.count(value).alias("valid"))


def duplicate_features(long: DataFrame, keys: list[str], name: str = "feature", value: str = "value", digits: int = 8) -> DataFrame:
    """``feature, keeper``: features whose values equal those of a feature before them in name order. Candidates come from
    signatures; each is then compared value by value, so a hash collision drops nothing."""
    sig = signatures(long, keys, name, value, digits)
    first = sig.groupBy("signature", "valid").agg(F.min(name).alias("keeper"))
    pairs = sig.join(first, ["signature", "valid"]).where(F.col(name) > F.col("keeper")).select(name, "keeper")
    a = long.select(*keys, F.col(name), F.round(value, digits).alias("a")).join(F.broadcast(pairs), name)
    b = long.select(*keys, F.col(name).alias("keeper"), F.round(value, digits).alias("b"))
    same = a.join(b, [*keys, "keeper"]).groupBy(name, "keeper").agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same"))
    return same.where("same").select(name, "keeper")


def near_duplicate_pairs(df: DataFrame, columns: list[str], min_corr: float = 0.999999, max_diff: float | None = None) -> DataFrame:
    """``a, b, corr, mean_diff`` of column pairs that move together; all pairs of one bounded column list in one aggregate job."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_diff")) for a, b in pairs]
    rows = df.agg(F.array(*aggs).alias("p")).select(F.inline("p"))
    keep = F.abs("corr") >= min_corr
    return rows.where(keep if max_diff is None else keep & (F.col("mean_diff") <= max_diff))


def alias_pairs(main: DataFrame, extra: DataFrame, key: str, main_columns: list[str], extra_columns: list[str], atol: float) -> DataFrame:
    """For each main column the extra column that agrees best: share of shared rows within ``atol``, most shared rows first."""
    m = to_long(main, [key], main_columns, "a", "x").where("x is not null")
    e = to_long(extra, [key], extra_columns, "b", "y").where("y is not null")
    scored = m.join(e, key).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.avg((F.abs(F.col("x") - F.col("y")) <= atol).cast("int")).alias("agree"))
    w = Window.partitionBy("a").orderBy(F.col("agree").desc(), F.col("shared").desc(), "b")
    return scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def top_non_null(long: DataFrame, k: int, name: str = "feature", value: str = "value") -> DataFrame:
    return long.groupBy(name).agg((F.count(value) / F.count(F.lit(1))).alias("valid_ratio")).orderBy(F.col("valid_ratio").desc(), name).limit(k)


def prune_empty(df: DataFrame, keep: list[str]) -> DataFrame:
    """Drops numeric columns without any value; one aggregate job decides."""
    numbers = [c for c, t in df.dtypes if c not in keep and t in ("double", "float", "int", "bigint")]
    if not numbers:
        return df
    counts = df.agg(*[F.count(c).alias(c) for c in numbers]).first()
    return df.drop(*[c for c in numbers if counts[c] == 0])


def coerce_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: numeric(F.col(c)) for c in columns})


def invalid(value: Column, low: float | None = None, high: float | None = None) -> Column:
    out = value.isNull() | F.isnan(value)
    if low is not None:
        out = out | (value < low)
    return out if high is None else out | (value > high)


def select_or_all(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that fit, or every row if none does (a one-row count decides)."""
    return df.crossJoin(F.broadcast(df.agg(F.count_if(condition).alias("_n")))).where(condition | (F.col("_n") == 0)).drop("_n")


def feature_columns(df: DataFrame, blocked: set[str], include: set[str] | None = None) -> list[str]:
    """Numeric columns that are not blocked and, with ``include``, are named there by themselves or by their root."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint") and c not in blocked]
    return [c for c in numbers if include is None or c in include or c.split("__", 1)[0] in include]


def unsupervised_reasons(df: DataFrame, keys: list[str], columns_: list[str], order: str, first_rows: int = 120) -> DataFrame:
    """``feature, reason``: all missing, over 60 % missing, at most five values, flat, or the same rounded first rows as a feature
    before it in name order. The first rows are a small stated set by ``order``."""
    long = to_long(df, keys, columns_)
    reasons = screen(profile(long), 0.6, 6, 2.0, 1e-8).select("feature", "reason")
    head = to_long(df.orderBy(order).limit(first_rows), keys, columns_)
    sig = signatures(head, keys, digits=6)
    same = sig.withColumn("keeper", F.min("feature").over(Window.partitionBy("signature", "valid"))).where(F.col("keeper") < F.col("feature"))
    joined = reasons.join(same.select("feature", F.lit("same_head").alias("same")), "feature", "left")
    return joined.select("feature", F.coalesce("reason", "same").alias("reason"))


def keep_representatives(pairs: list[tuple[str, str]], columns_: list[str]) -> list[str]:
    """Columns left when every group of duplicates keeps its shortest name (then the first)."""
    group = {c: c for c in columns_}

    def top(c: str) -> str:
        while group[c] != c:
            c = group[c]
        return c

    for a, b in pairs:
        x, y = sorted((top(a), top(b)), key=lambda c: (len(c), c))
        group[y] = x
    return [c for c in columns_ if group[c] == c]
