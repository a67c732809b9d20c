"""As-of joins without a quadratic plan: one union, one sort, bounded by the tolerance.

A match lies at most ``tolerance`` away, so the lookup side is dealt to time buckets of that width with a copy for the
neighbour, and the window partitions by key and bucket. Unkeyed streams therefore stay parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.timeline import MINUTE, bucket, halo


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    values: list[str],
    tolerance: int,
    by: list[str] | None = None,
    direction: str = "backward",
    left_time: str = "t",
    right_time: str = "t",
    lag: int = 0,
    suffix: str = "",
    order: list[str] | None = None,
) -> DataFrame:
    """Every left row with ``values`` of the right row nearest to ``left_time - lag`` (microseconds) within the inclusive
    tolerance, plus ``gap`` (micros, right minus left). Backward: at or before; nearest: either side, the earlier on ties.
    Of right rows at the same time the last in the ``order`` of these columns, then of ``values``, counts; looking ahead the first
    by ``order``. Unmatched rows get NULLs."""
    by = by or []
    width = max(int(tolerance), 1)
    names = left.columns
    l = left.withColumn("_at", F.col(left_time) - F.lit(lag)).select(
        *by, F.col("_at").alias("_t"), bucket(F.col("_at"), width).alias("_bucket"), F.lit(1).alias("_side"), F.struct(*names).alias("_row")
    )
    order = order or []
    ranks = [F.col(c).alias(f"_o_{i}") for i, c in enumerate(order)]
    found = F.struct(F.col(right_time).alias("t"), *ranks, *values).alias("_found")
    r = halo(right.where(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("_t"), found), "_t", width, True, direction == "nearest")
    r = r.select(*by, "_t", "_bucket", F.lit(0).alias("_side"), "_found")
    w = Window.partitionBy(*by, "_bucket").orderBy("_t", "_side", "_found")
    both = l.unionByName(r, allowMissingColumns=True)
    both = both.withColumn("_back", F.last("_found", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if direction == "nearest":
        ties = [F.col(f"_found._o_{i}").desc() for i in range(len(order))]
        forward = Window.partitionBy(*by, "_bucket").orderBy(F.col("_t").desc(), F.col("_side"), *ties, F.col("_found"))
        both = both.withColumn("_next", F.last("_found", ignorenulls=True).over(forward.rowsBetween(Window.unboundedPreceding, 0)))
        ahead, behind = F.col("_next.t") - F.col("_t"), F.col("_t") - F.col("_back.t")
        pick = F.when(F.col("_back").isNull() | (F.coalesce(ahead < behind, F.lit(False))), F.col("_next")).otherwise(F.col("_back"))
        both = both.withColumn("_back", pick)
    hit = F.when(F.abs(F.col("_back.t") - F.col("_t")) <= tolerance, F.col("_back"))
    out = both.where("_side = 1").select("_row", "_t", hit.alias("_hit"))
    return out.select("_row.*", *[F.col(f"_hit.{v}").alias(v + suffix) for v in values], (F.col("_hit.t") - F.col("_t")).alias("gap" + suffix))


def asof_snapshot(samples: DataFrame, values: DataFrame, names: list[str], lag_minutes: int, tolerance_minutes: int, order: str, by: list[str] | None = None) -> DataFrame:
    """Backward as-of after the right side was made unique per time, keeping the last by ``order``."""
    unique = keep_last(values, [*(by or []), "t"], [order])
    return asof_join(samples, unique, names, tolerance_minutes * MINUTE, by, lag=lag_minutes * MINUTE)


def lagged_snapshots(samples: DataFrame, values: DataFrame, names: list[str], lags: list[int], tolerance_minutes: int, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One snapshot column per lag and value (``{name}__lag{m}``), and ``available``, the share that was found.

    Every sample asks once per lag in one as-of pass; the answers meet again by a row number, texts and other columns of the
    samples travel once. ``order`` decides between values at the same time."""
    rows = samples.withColumn("_row", F.monotonically_increasing_id())
    asks = rows.select(*(by or []), "_row", "t", F.struct(*samples.columns).alias("_sample"), F.explode(F.array(*map(F.lit, lags))).alias("_lag"))
    # the sample's own columns go with the first lag
    asks = asks.withColumn("_sample", F.when(F.col("_lag") == lags[0], F.col("_sample"))).withColumn("t", F.col("t") - F.col("_lag").cast("long") * MINUTE)
    found = asof_join(asks, values, names, tolerance_minutes * MINUTE, by, order=order)
    at = lambda n, m: F.max(F.when(F.col("_lag") == m, F.col(n))).alias(f"{n}__lag{m}")
    wide = found.groupBy("_row").agg(F.first("_sample", ignorenulls=True).alias("_sample"), *[at(n, m) for m in lags for n in names])
    out = wide.select("_sample.*", *[f"{n}__lag{m}" for m in lags for n in names])
    got = [F.col(f"{n}__lag{m}").isNotNull().cast("int") for m in lags for n in names]
    return out.withColumn("available", sum(got[1:], got[0]) / len(got))


def row_window_slices(samples: DataFrame, stream: DataFrame, rows: int, stale: int, span: int, by: list[str]) -> DataFrame:
    """Fixed row-count slices per key: the ``rows`` stream rows that end at the last one at or before the sample, kept if that
    row is at most ``stale`` old and the slice spans at most ``span`` (micros).

    Row numbers are dealt to blocks of ``rows``; a slice lies in its last row's block and the one before, so a sample meets
    at most two blocks of its key, not the whole key."""
    numbered = stream.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("t", "event_id")))
    ends = asof_join(samples, numbered, ["rn"], stale, by)
    block = lambda c: F.floor(c / rows).cast("long")
    hit = ends.where("rn is not null").select("sample_id", *by, F.col("rn").alias("end"))
    hit = hit.withColumn("_block", F.explode(F.array(block(F.col("end")), block(F.col("end")) - 1)))
    joined = hit.join(numbered.withColumn("_block", block(F.col("rn"))), [*by, "_block"]).where((F.col("rn") <= F.col("end")) & (F.col("rn") > F.col("end") - rows))
    slices = joined.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span"), F.avg("value").alias("mean"))
    return slices.where((F.col("n") == rows) & (F.col("span") <= span))
