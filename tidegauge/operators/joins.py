"""Merges of streams, tables and key sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.asof import keep_last


def outer_merge(main: DataFrame, extra: DataFrame, key: str, suffix: str = "_supp") -> DataFrame:
    """Full outer merge; a clashing column of the second side gets the suffix."""
    clash = {c: c + suffix for c in extra.columns if c in main.columns and c != key}
    return main.join(extra.withColumnsRenamed(clash), key, "full")


def combine_first(main: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Full outer merge, per column the first side's value, else the second's."""
    names = [*main.columns, *[c for c in extra.columns if c not in main.columns]]
    m, e = main.alias("m"), extra.alias("e")
    joined = m.join(e, key, "full")

    def column(c: str):
        both = c in main.columns and c in extra.columns
        return F.coalesce(F.col(f"m.{c}"), F.col(f"e.{c}")).alias(c) if both else F.col(c)

    return joined.select(*[F.col(key) if c == key else column(c) for c in names])


def union_keep_last(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of all frames, one per key: of repeats the one of the last frame, in it the last by all columns."""
    tagged = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    order = ["_src", *[c for c in rows.columns if c not in (key, "_src")]]
    return keep_last(rows, [key], order).drop("_src")


def common_keys(frames: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [f.select(key) for f in frames])


def align_common(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per key that all frames hold, columns ``{frame}__{column}``; a repeated key in a frame raises an error at run time."""
    out = None
    for name, f in frames.items():
        once = f.groupBy(key).agg(
            *[F.first(c).alias(f"{name}__{c}") for c in f.columns if c != key],
            F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"repeated key in {name}"))).alias("_check"),
        )
        once = once.where("_check is null").drop("_check")
        out = once if out is None else out.join(once, key)
    return out


def prefixed_inner(left: DataFrame, right: DataFrame, key: str, prefix: str) -> DataFrame:
    """Inner join; clashing names of the right side get ``prefix``."""
    return left.join(right.withColumnsRenamed({c: prefix + c for c in right.columns if c in left.columns and c != key}), key)


def attach(left: DataFrame, right: DataFrame, key: str, required: list[str] | None = None) -> DataFrame:
    """Inner join and complete rows only with ``required``; otherwise a left join to the first right row per key."""
    if required:
        return left.join(right, key).na.drop(subset=required)
    order = [c for c in right.columns if c != key]
    return left.join(keep_last(right, [key], order), key, "left")


def weighted_blend(tables: dict[int, DataFrame], key: str, weights: dict[int, float], columns: list[str]) -> DataFrame:
    """Weighted mean of the same columns over window tables, weights normalised; keys that all tables hold."""
    total = sum(weights.values())
    joined = reduce(
        lambda a, b: a.join(b, key), [t.select(key, *[F.col(c).alias(f"w{w}__{c}") for c in columns]) for w, t in tables.items()]
    )
    return joined.select(key, *[sum((F.col(f"w{w}__{c}") * (weights[w] / total) for w in tables), F.lit(0.0)).alias(c) for c in columns])


def replace_columns(base: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the listed columns taken from ``other`` by key (a hybrid of two feature tables)."""
    picked = other.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(picked, key, "left").withColumns({c: F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def grid_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cartesian product of two parameter grids; both are literal relations, so the right one is broadcast."""
    return a.crossJoin(F.broadcast(b))


def linspace(df_spark, name: str, low: float, high: float, n: int) -> DataFrame:
    return df_spark.range(n).select((F.lit(low) + F.col("id") * F.lit((high - low) / max(n - 1, 1))).alias(name))
