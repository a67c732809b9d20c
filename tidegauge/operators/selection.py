"""Exact ranks and quantiles of any number of values, without a buffer of values or a task that orders all of them.

Selection counts the rows of a group into ranges of value, keeps the ranges that hold a wanted rank and counts those more
finely, until none holds more than ``FINISH_ROWS`` rows; the different values of what is left are counted and ordered.
Cuts between ranges come from a sketch and reach the driver before they are used, so that every use sees the same ones:
they decide how many rows are looked at again, never which value is found.

Running totals order the different values of a group by ranges too, each starting from the totals of those before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.sources.scratch import stored

#: Rows of a range that are ordered at once, and ranges that one count tells apart.
FINISH_ROWS, RANGES = 100_000, 1_024
#: Different values that one task orders in running totals.
RANGE_VALUES = 50_000


def value_cuts(df: DataFrame, value: str, n: int) -> list[float]:
    """At most ``n - 1`` rising cuts that part the values about evenly (nulls, NaN and infinities apart)."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < math.inf), F.col(value))
    found = df.agg(F.percentile_approx(finite, [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    return sorted(set(found or []))


def range_of(value: Column, cuts: Sequence[float]) -> Column:
    """How many cuts lie below a value (NaN above all), by two short searches instead of a long one."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts) - 1) + 1
    rows = [list(cuts[i : i + width]) for i in range(0, len(cuts), width)]
    below = lambda array: F.size(F.filter(array, lambda c: c < value))
    coarse = below(F.array(*[F.lit(r[-1]) for r in rows]))  # rows that lie below as a whole
    fine = F.get(F.array(*[F.array(*map(F.lit, r)) for r in rows]), coarse)
    return F.when(coarse >= len(rows), F.lit(len(cuts))).otherwise(coarse * width + F.coalesce(below(fine), F.lit(0))).cast("int")


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def ranked_values(df: DataFrame, by: Sequence[str], value: str, ranks: Callable[[Column], Column], finish_rows: int | None = None) -> DataFrame:
    """``by, n, rank, value``: the values at the ``ranks`` (of a group's rows in rising order, from 0; an array of longs, from the
    group's number of rows) of each group. Null values do not count; NaN is the largest. Groups without a value are left out.

    One small job decides whether ranges are needed; where they are, the two columns are stored once."""
    limit = finish_rows or FINISH_ROWS
    keys = [*by] or ["_all"]
    rows = df.select(*by, *([] if by else [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v")).where("_v is not null")
    n, low, high = F.count(F.lit(1)), F.min("_v"), F.max("_v")
    state = rows.groupBy(*keys).agg(n.alias("_n"), low.alias("_low"), high.alias("_high")).select(
        *keys, F.col("_n").alias("n"), "_low", "_high", F.lit(0).cast("long").alias("_before"), "_n", F.array_distinct(ranks(F.col("_n"))).alias("_ranks")
    )
    most = lambda s: s.agg(F.max(F.when(F.col("_low") < F.col("_high"), F.col("_n")))).first()[0] or 0
    largest = most(state)
    if largest > limit:
        rows, state = stored(rows, "values"), stored(state, "ranges")
    while largest > limit:
        kept = _kept(rows, state, keys)
        cuts = value_cuts(kept, "_v", RANGES)
        counted = kept.groupBy(*keys, "n", "_low", "_before", "_ranks", range_of(F.col("_v"), cuts).alias("_range")).agg(n.alias("_c"), low.alias("_l"), high.alias("_h"))
        start = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_low").orderBy("_range")) - F.col("_c")
        held = F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_c")))
        nearer = counted.withColumn("_start", start).withColumn("_held", held).where(F.size("_held") > 0)
        state = stored(nearer.select(*keys, "n", F.col("_l").alias("_low"), F.col("_h").alias("_high"), F.col("_start").alias("_before"), F.col("_c").alias("_n"), F.col("_held").alias("_ranks")), "ranges")
        now = most(state)
        if now >= largest:  # the cuts part it no further
            break
        largest = now
    counted = _kept(rows, state, keys).groupBy(*keys, "n", "_low", "_before", "_ranks", "_v").agg(n.alias("_c"))
    start = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_low").orderBy("_v")) - F.col("_c")
    hit = counted.withColumn("_start", start).withColumn("rank", F.explode("_ranks")).where((F.col("rank") >= F.col("_start")) & (F.col("rank") < F.col("_start") + F.col("_c")))
    return hit.select(*by, "n", "rank", F.col("_v").alias("value"))


def _kept(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows inside a range that is still searched; ranges of a group do not overlap."""
    own = state.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = ((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
    return rows.join(own, same & inside).select(*keys, "_v", "n", "_low", "_before", "_ranks")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], finish_rows: int | None = None) -> DataFrame:
    """``by`` and one column per quantile of each group's values, between the two nearest ranks by their distance; as
    ``percentile`` gives them. Groups without a value are left out."""
    at = lambda n, p: (n - 1) * F.lit(float(p))
    ranks = lambda n: F.flatten(F.array(*[F.array(F.floor(at(n, p)), F.ceil(at(n, p))) for p in probs]))
    found = ranked_values(df, by, value, ranks, finish_rows)
    pairs = F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m")  # two a quantile
    group = [*by] or [F.lit(0).alias("_all")]
    held = found.groupBy(*group, "n").agg(pairs)
    out = []
    for p, name in zip(probs, names, strict=True):
        place = at(F.col("n"), p)
        a, b = (F.try_element_at("_m", f(place).cast("long")) for f in (F.floor, F.ceil))
        share = place - F.floor(place)
        out.append(F.when(share == 0, a).otherwise((1 - share) * a + share * b).alias(name))
    return held.select(*by, *out)


def running_totals(counted: DataFrame, part: Sequence[str], value: str, sums: Sequence[str], descending: bool = False, range_values: int | None = None) -> DataFrame:
    """``counted`` (a row for each ``part`` and different ``value``) with ``{c}_before``, the sum of ``c`` over the rows of the part
    whose value comes before, and ``{c}_all``, over all of them. One job counts the rows; where they are more than a task
    should order, another finds the cuts."""
    size = range_values or RANGE_VALUES
    n = counted.count()
    cuts = value_cuts(counted.withColumn("_x", F.col(value).cast("double")), "_x", min(RANGES, -(-n // size))) if n > size else []
    order = (lambda c: F.col(c).desc()) if descending else F.col
    whole = Window.partitionBy(*part)
    totals = {f"{c}_all": F.sum(c).over(whole) for c in sums}
    if not cuts:
        upto = whole.orderBy(order(value)).rowsBetween(Window.unboundedPreceding, -1)
        return counted.withColumns({**{f"{c}_before": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in sums}, **totals})
    placed = counted.withColumn("_b", range_of(F.col(value).cast("double"), cuts))
    ranges = placed.groupBy(*part, "_b").agg(*[F.sum(c).alias(c) for c in sums])  # RANGES a part at most
    up = whole.orderBy(order("_b"))
    carried = ranges.select(
        *[F.col(c).alias(f"_k_{c}") for c in part], F.col("_b").alias("_k"), *[(F.sum(c).over(up) - F.col(c)).alias(f"_s_{c}") for c in sums], *[F.sum(c).over(whole).alias(f"{c}_all") for c in sums]
    )
    local = Window.partitionBy(*part, "_b").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_b") == F.col("_k")
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    own = placed.withColumns({f"_l_{c}": F.coalesce(F.sum(c).over(local), F.lit(0)) for c in sums}).join(carried, same)
    return own.select(*counted.columns, *[(F.col(f"_l_{c}") + F.col(f"_s_{c}")).alias(f"{c}_before") for c in sums], *[f"{c}_all" for c in sums])
