"""Statistics of overlapping time slices from mergeable moment buckets.

The stream is summarised once per key and small time step (rows, valid values, mean and squared spread of values and of
times, their product, extremes, first and last value), and those buckets are merged by eights into longer ones. A slice is
a few whole buckets and two edges; raw rows are read at the edges alone, so that a row is not copied to every slice that
holds it. Spreads are merged about the means of the parts, never as differences of large sums.

Medians need the order of values: buckets also count values between fixed cuts, which names the interval that holds a
slice's rank; only the rows of that interval are read again. The cuts decide how many those are, not the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.timeline import MINUTE, bucket

RADIX = 8
#: A step is this part of the narrowest window.
STEPS = 16
#: Intervals of values that buckets count for medians.
CUTS = 31

_PART = ["rows", "n", "mean", "m2", "tm", "t2", "tv", "low", "high", "first", "last"]


def _raw(origin: Column) -> list[Column]:
    """Moments of raw rows ``t, value``; times in minutes, as small numbers from ``origin`` first."""
    v = F.col("value")
    at = F.when(v.isNotNull(), (F.col("t") - origin) / F.lit(float(MINUTE)))
    ok = F.when(v.isNotNull(), F.struct("t", "value"))
    n = F.count(v)
    return [
        F.count(F.lit(1)).alias("rows"), n.alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * n).alias("m2"), (F.avg(at) + F.first(origin) / F.lit(float(MINUTE))).alias("tm"),
        (F.var_pop(at) * n).alias("t2"), (F.covar_pop(at, v) * n).alias("tv"), F.min(v).alias("low"), F.max(v).alias("high"), F.min(ok).alias("first"), F.max(ok).alias("last"),
    ]


def _merged(counts: int) -> tuple[list[Column], list[Column]]:
    """How parts are merged: aggregates of a group of a few parts, and the columns that follow from them."""
    part = F.when(F.col("n") > 0, F.struct(F.col("n").cast("double").alias("n"), "mean", "m2", "tm", "t2", "tv"))
    aggregates = [
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.collect_list(part).alias("_p"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("first").alias("first"), F.max("last").alias("last"), *([F.collect_list("counts").alias("_c")] if counts else []),
    ]

    def add(a: Column, p: Column) -> Column:
        n = a["n"] + p["n"]
        dv, dt, share = p["mean"] - a["mean"], p["tm"] - a["tm"], a["n"] * p["n"] / n
        return F.struct(
            n.alias("n"), (a["mean"] + dv * p["n"] / n).alias("mean"), (a["m2"] + p["m2"] + dv * dv * share).alias("m2"),
            (a["tm"] + dt * p["n"] / n).alias("tm"), (a["t2"] + p["t2"] + dt * dt * share).alias("t2"), (a["tv"] + p["tv"] + dv * dt * share).alias("tv"),
        )

    # in the order of time, so that the same parts give the same sum
    ordered = F.array_sort("_p", lambda a, b: F.when(a["tm"] < b["tm"], -1).when(a["tm"] > b["tm"], 1).otherwise(F.when(a["mean"] < b["mean"], -1).when(a["mean"] > b["mean"], 1).otherwise(0)))
    whole = F.aggregate(F.slice("_o", 2, F.greatest(F.size("_o") - 1, F.lit(0))), F.get("_o", F.lit(0)), add)
    follow = [ordered.alias("_o"), whole.alias("_w")]
    if counts:
        zero = F.array_repeat(F.lit(0).cast("long"), counts)
        follow.append(F.aggregate("_c", zero, lambda a, c: F.zip_with(a, c, lambda x, y: x + y)).alias("counts"))
    return aggregates, follow


def _merge(parts: DataFrame, keys: list[str], counts: int) -> DataFrame:
    aggregates, follow = _merged(counts)
    held = parts.groupBy(*keys).agg(*aggregates).withColumn("_o", follow[0]).withColumn("_w", follow[1])
    if counts:
        held = held.withColumn("counts", follow[2])
    names = ["mean", "m2", "tm", "t2", "tv"]
    return held.select(*keys, "rows", "n", *[F.col(f"_w.{c}").alias(c) for c in names], "low", "high", "first", "last", *(["counts"] if counts else []))


def _interval(value: Column, cuts: list[float]) -> Column:
    """The number of cuts below a value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0)


def _counted(cuts: list[float]) -> list[Column]:
    at = _interval(F.col("value"), cuts)
    return [F.array(*[F.count_if((at == k) & F.col("value").isNotNull()) for k in range(len(cuts) + 1)]).alias("counts")] if cuts else []


@dataclass
class Buckets:
    """Moment buckets of a stream: ``levels`` of time steps, each ``RADIX`` times as long as the one before."""

    stream: DataFrame
    by: list[str]
    per: list[str]
    step: int
    widest: int
    cuts: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.levels, span = 1, self.step * RADIX
        while span < self.widest:
            self.levels, span = self.levels + 1, span * RADIX
        self.keys = [*self.by, *[p for p in self.per if p not in self.by]]
        self.counts = len(self.cuts) + 1 if self.cuts else 0

    def nodes(self) -> DataFrame:
        rows = self.stream.withColumn("node", bucket(F.col("t"), self.step)).withColumn("_start", F.col("node") * self.step)
        level = rows.where("t is not null").groupBy(*self.keys, "node").agg(*_raw(F.col("_start")), *_counted(self.cuts))
        out = level.withColumn("level", F.lit(0))
        for k in range(1, self.levels):
            level = _merge(level.withColumn("node", bucket(F.col("node"), RADIX)), [*self.keys, "node"], self.counts)
            out = out.unionByName(level.withColumn("level", F.lit(k)))
        return out

    def cover(self) -> Column:
        """Whole buckets of a slice ``[lo, hi]`` as (level, node)."""
        low, high = F.floor((F.col("lo") - 1) / self.step).cast("long") + 1, F.floor((F.col("hi") + 1) / self.step).cast("long")
        found = []
        pick = lambda k, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(k).alias("level"), x.alias("node")))).otherwise(
            F.array().cast("array<struct<level:int,node:bigint>>")
        )
        for k in range(self.levels):
            if k == self.levels - 1:
                found.append(pick(k, low, high))
                break
            up, down = (F.floor((low + RADIX - 1) / RADIX)).cast("long"), F.floor(high / RADIX).cast("long")
            none = up >= down  # no whole bucket of the next level: this level takes all
            found += [pick(k, low, F.when(none, high).otherwise(up * RADIX)), pick(k, F.when(none, high).otherwise(down * RADIX), high)]
            low, high = F.when(none, F.lit(0).cast("long")).otherwise(up), F.when(none, F.lit(0).cast("long")).otherwise(down)
        return F.concat(*found)

    def edges(self) -> Column:
        """Steps of which a slice holds a part."""
        a, b = bucket(F.col("lo"), self.step), bucket(F.col("hi"), self.step)
        left = F.when(F.pmod(F.col("lo"), F.lit(self.step)) != 0, a)
        right = F.when(F.pmod(F.col("hi") + 1, F.lit(self.step)) != 0, b)
        return F.array_distinct(F.array_compact(F.array(left, right)))


def slice_moments(asks: DataFrame, buckets: Buckets, keys: list[str]) -> DataFrame:
    """Moments of ``asks`` (``keys``, the stream's ``by`` columns, ``lo``, ``hi``: both ends included) for each of the stream's
    ``per`` columns; slices without a row are left out."""
    b = buckets
    asked = asks.where("lo <= hi")
    whole = asked.select(*keys, *b.by, F.inline(b.cover())).join(b.nodes(), ["level", "node", *b.by]).select(*keys, *b.per, *_PART, *(["counts"] if b.counts else []))
    rows = b.stream.withColumn("node", bucket(F.col("t"), b.step))
    rows = rows.select("node", *b.keys, "t", "value")
    edge = asked.select(*keys, *b.by, "lo", "hi", F.explode(b.edges()).alias("node"))
    at_edge = edge.join(rows, ["node", *b.by]).where("t between lo and hi").withColumn("_start", F.col("node") * b.step)
    parts = at_edge.groupBy(*keys, *b.per, "node").agg(*_raw(F.col("_start")), *_counted(b.cuts)).drop("node")
    return _merge(whole.unionByName(parts), [*keys, *b.per], b.counts)


def statistics() -> dict[str, Column]:
    """Statistics by name over the columns of ``slice_moments``."""
    n, std = F.col("n"), F.sqrt(F.col("m2") / F.col("n"))
    first, last = F.col("first.value"), F.col("last.value")
    return {
        "count": n, "rows": F.col("rows"), "mean": F.col("mean"), "var": F.col("m2") / n, "std": std, "min": F.col("low"), "max": F.col("high"),
        "range": F.col("high") - F.col("low"), "first": first, "last": last, "delta": last - first, "valid_ratio": n / F.col("rows"),
        "slope": F.when(n > 1, F.try_divide(F.col("tv"), F.when(F.col("t2") > 0, F.col("t2")))), "cv": F.try_divide(std, F.abs("mean")),
    }


def encode(samples: DataFrame, stream: DataFrame, width: int, keys: list[str], stats: list[str], min_rows: int = 1, by: list[str] | None = None, per: list[str] | None = None, lag: int = 0) -> DataFrame:
    """One row per sample (``keys``, ``per``) with ``stats`` of the stream in ``[t - lag - width, t - lag]``; slices with fewer than
    ``min_rows`` valid values are dropped. The same rows as ``slices.encode_slices`` over ``slices.slice_join``."""
    b = Buckets(stream, by or [], per or [], max(1, width // STEPS), width)
    hi = F.col("t") - F.lit(lag)
    asks = samples.where("t is not null").select(*keys, *b.by, (hi - F.lit(width)).alias("lo"), hi.alias("hi"))
    named = statistics()
    found = slice_moments(asks, b, list(dict.fromkeys([*keys, *b.by])))
    return found.where(F.col("n") >= min_rows).select(*keys, *b.per, *[named[s].alias(s) for s in stats])


def value_cuts(stream: DataFrame, n: int = CUTS) -> list[float]:
    """At most ``n`` rising cuts that part the stream's values about evenly. They come to the driver, so that every use of them
    sees the same."""
    shares = [i / (n + 1) for i in range(1, n + 1)]
    found = stream.agg(F.percentile_approx("value", shares, 1000)).first()[0] or []
    return sorted({float(x) for x in found if x == x and abs(x) != float("inf")})


def slice_medians(asks: DataFrame, moments: DataFrame, buckets: Buckets, keys: list[str]) -> DataFrame:
    """``keys, per, median`` from ``slice_moments`` with counts: the interval of values that holds each middle rank, then the rows of
    that interval alone, met by time blocks as wide as the widest slice."""
    b = buckets
    own = [*keys, *b.per]
    before = F.transform(F.sequence(F.lit(0), F.size("counts")), lambda i: F.aggregate(F.slice("counts", 1, i), F.lit(0).cast("long"), lambda a, c: a + c))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    asked = moments.where("n > 0").select(*own, F.explode(ranks).alias("rank"), before.alias("_b"))
    place = F.size(F.filter("_b", lambda x: x <= F.col("rank"))) - 1  # the last interval that begins at or before the rank
    asked = asked.withColumn("interval", place.cast("int")).withColumn("rank", F.col("rank") - F.get("_b", F.col("interval"))).drop("_b")
    wanted = asked.groupBy(*own, "interval").agg(F.collect_set("rank").alias("ranks"))  # one or two
    wide = b.widest + 1
    bounded = wanted.join(asks.select(*keys, *[c for c in b.by if c not in keys], "lo", "hi"), keys)
    bounded = bounded.withColumn("_at", F.explode(F.array_distinct(F.array(bucket(F.col("lo"), wide), bucket(F.col("hi"), wide)))))
    rows = b.stream.where("value is not null and t is not null").select(*b.keys, "t", "value", _interval(F.col("value"), b.cuts).cast("int").alias("interval"), bucket(F.col("t"), wide).alias("_at"))
    met = bounded.join(rows, ["_at", "interval", *b.keys]).where("t between lo and hi")
    numbered = met.withColumn("_r", F.row_number().over(Window.partitionBy(*own, "interval").orderBy("value")) - 1)
    return numbered.where(F.array_contains("ranks", F.col("_r").cast("long"))).groupBy(*own).agg(F.avg("value").alias("median"))


def window_lag_grid(
    samples: DataFrame, stream: DataFrame, windows: list[int], lags: list[int], tolerance: int, per: list[str], by: list[str] | None = None, drift: tuple[int, int] | None = None
) -> DataFrame:
    """``sample_id, window, lag`` (minutes), ``per``, and ``n, missing_rate, mean, median, var, std, min, max, range, cv, drift`` for every
    sample, window and lag: the rows in ``(r - window, r]``, where ``r`` is the stream's last row at or before ``t - lag`` and at most
    ``tolerance`` micros older. ``missing_rate`` is the share of all rows of the slice, of whatever ``per``, that hold no valid
    value of this one; ``drift`` is the mean over the first window less that over the second. Samples without such a row are
    left out, and so is a ``per`` without a valid value.
    """
    from tidegauge.operators.asof import asof_join

    by = by or []
    ends = asof_join(
        samples.select("sample_id", *by, "t").withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("at", F.col("t") - F.col("lag").cast("long") * MINUTE),
        stream.select(*by, "t").where("t is not null").distinct().withColumn("r", F.col("t")), ["r"], tolerance, by, left_time="at",
    ).where("r is not null")
    asks = ends.select("sample_id", "lag", *by, "r", F.explode(F.array(*map(F.lit, windows))).alias("window"))
    asks = asks.select("sample_id", "lag", "window", *by, (F.col("r") - F.col("window").cast("long") * MINUTE + 1).alias("lo"), F.col("r").alias("hi"))
    keys = ["sample_id", "lag", "window", *by]
    step = max(1, min(windows) * MINUTE // STEPS)
    b = Buckets(stream, by, per, step, max(windows) * MINUTE, value_cuts(stream))
    moments = slice_moments(asks, b, keys)
    medians = slice_medians(asks, moments, b, keys)
    own = [*keys, *per]
    named = statistics()
    all_rows = F.sum("rows").over(Window.partitionBy(*keys))
    short, long = drift or (windows[0], windows[-1])
    mean_of = lambda w: F.max(F.when(F.col("window") == w, F.col("mean"))).over(Window.partitionBy("sample_id", "lag", *by, *per))
    table = moments.select(*own, "n", all_rows.alias("_all"), *[named[s].alias(s) for s in ("mean", "var", "std", "min", "max", "range", "cv")]).where("n > 0")
    table = table.withColumns({"missing_rate": 1 - F.col("n") / F.col("_all"), "drift": mean_of(short) - mean_of(long)}).drop("_all")
    return table.join(medians, own)
