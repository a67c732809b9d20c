"""An exact index for nearest cases: cells by nearest pivot, cut into slices in order of time.

Cases are dealt to the cell of their nearest pivot, sorted by time within the cell and cut into slices of bounded size.
What is known of a slice (earliest time, least and greatest distance to its pivot, a box around its vectors) bounds the
distance of everything in it from below: by the triangle inequality for the Euclidean distance, by the box for both
distances. A query first searches the slices with the lowest bounds until they hold enough cases, and then those slices
alone whose bound does not exceed the k-th distance found. Slices that begin later than ``delay`` before the query are
never visited. Queries meet slices by a shuffle on the slice, in parts, so neither side is broadcast or collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.sources.scratch import stored

#: Slices at most (their bounds are broadcast: 16 bytes a feature and 40 more for each), rows of a slice at least, pivots at most.
MAX_SLICES, SLICE_ROWS, MAX_PIVOTS = 65_536, 4_096, 256
#: Queries that one copy of a slice serves.
PART_QUERIES = 65_536
#: Bounds are lowered by this share, so that rounding never hides a case.
SLACK = 1e-9
_EVER = 2**63 - 1  # the time of cases without one, and the cutoff of queries that ask without a delay


def euclidean(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = rows - q
    return np.sqrt((d * d).sum(axis=1))


def median_gap(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Median of the absolute differences (the mean of the middle two for an even number). No metric: no triangle holds."""
    gap = np.abs(rows - q)
    if gap.shape[1] == 3:
        a, b, c = gap.T
        return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
    return np.median(gap, axis=1)


def median_within(rows: np.ndarray, q: np.ndarray, limit: float) -> np.ndarray:
    """Rows whose ``median_gap`` may be ``limit`` or less: half of the features, rounded up, must be."""
    width, near = rows.shape[1], np.zeros(len(rows), np.int16)
    for j in range(width):
        near += np.abs(rows[:, j] - q[j]) <= limit
    return np.flatnonzero(near >= (width + 1) // 2)


DISTANCES = {"euclidean": euclidean, "median": median_gap}


@dataclass
class Slices:
    """What is known of each slice; at most about ``MAX_SLICES + MAX_PIVOTS`` plus one for each task."""

    kind: str
    pivots: np.ndarray
    slice: np.ndarray
    pivot: np.ndarray
    n: np.ndarray
    since: np.ndarray
    near: np.ndarray
    far: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """A lower bound of the distance from ``q`` to anything in each slice."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0.0)
        if self.kind == "median":
            return np.median(gap, axis=1) * (1 - SLACK)
        to_pivot = euclidean(self.pivots, q)[self.pivot]
        ring = np.maximum(to_pivot - self.far, self.near - to_pivot)
        return np.maximum(np.sqrt((gap * gap).sum(axis=1)), ring - SLACK * (1 + to_pivot)) * (1 - SLACK)

    def first(self, q: np.ndarray, cutoff: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds, and which slices to search first: the lowest bounds among those that begin in time, until they hold ``k`` rows."""
        bounds = np.where(self.since <= cutoff, self.bounds(q), np.inf)
        order = np.argsort(bounds, kind="stable")
        held = np.cumsum(self.n[order]) - self.n[order]
        chosen = np.zeros(len(order), bool)
        chosen[order[held < k]] = True
        return bounds, chosen & np.isfinite(bounds)


@dataclass
class CellIndex:
    rows: DataFrame  # slice, id, t, y, r, z: stored
    slices: Slices | None  # None without a case


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


_ROWS = "kind int, slice long, pivot int, id long, t long, y double, r double, z array<double>, low array<double>, high array<double>"
_ROW_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_LIST = pa.list_(pa.float64())
_ROW_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), _LIST, _LIST, _LIST]


def _lists(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def build_index(cases: DataFrame, kind: str = "euclidean", slice_rows: int = SLICE_ROWS) -> CellIndex:
    """Index of ``cases(id, z)`` with optional ``t`` (micros) and ``y``. Rows whose ``z`` is null, of another length than the
    first pivot's or holds a null or NaN are left out: they have no distance. A null ``t`` is never known in time."""
    names = cases.columns
    z = F.transform("z", lambda x: x.cast("double"))
    rows = cases.select(
        F.col("id").cast("long").alias("id"),
        (F.coalesce(F.col("t").cast("long"), F.lit(_EVER)) if "t" in names else F.lit(0).cast("long")).alias("t"),
        (F.col("y").cast("double") if "y" in names else F.lit(None).cast("double")).alias("y"),
        z.alias("z"),
    ).where(F.coalesce(F.size("z") > 0, F.lit(False)) & F.coalesce(F.forall("z", lambda x: ~F.isnan(x)), F.lit(False)))
    rows = stored(rows, "vectors")  # read four times
    n = rows.count()
    n_pivots = int(min(MAX_PIVOTS, max(1, math.isqrt(n) // 2)))
    drawn = rows.select("z", F.xxhash64("id", "z").alias("_h")).orderBy("_h").limit(n_pivots).collect()
    if not drawn:
        return CellIndex(rows.withColumns({"slice": F.lit(0).cast("long"), "r": F.lit(0.0)}), None)
    width = len(drawn[0]["z"])
    pivots = np.unique(np.array([r["z"] for r in drawn if len(r["z"]) == width]), axis=0)
    squares = (pivots * pivots).sum(axis=1)
    per_slice = max(slice_rows, -(-n // MAX_SLICES))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column("z"))
                cell = np.argmin(squares - 2 * (x @ pivots.T), axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(euclidean(x, pivots[cell])), *b.columns], ["pivot", "r", *b.schema.names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers the slices of a sorted partition and adds a row of bounds at the end of each."""
        own, held, now, low, high, since, near, far = -1, 0, None, None, None, 0, 0.0, 0.0

        def closed() -> pa.RecordBatch:
            values = [1, part << 24 | own, now, held, since, near, far, None, low.tolist(), high.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _ROW_TYPES, strict=True)], _ROW_NAMES)

        for b in batches:
            if not b.num_rows:
                continue
            x, cell, r = _vectors(b.column("z")), b.column("pivot").to_numpy(), b.column("r").to_numpy()
            t, part = b.column("t").to_numpy(), b.column("part")[0].as_py()
            at = 0
            while at < len(cell):
                if own < 0 or held >= per_slice or cell[at] != now:
                    if own >= 0:
                        yield closed()
                    own, held, now = own + 1, 0, int(cell[at])
                    low, high, since, near, far = x[at].copy(), x[at].copy(), _EVER, np.inf, 0.0
                same = np.flatnonzero(cell[at:] != now)
                end = min(at + per_slice - held, at + int(same[0]) if len(same) else len(cell))
                np.minimum(low, x[at:end].min(axis=0), out=low)
                np.maximum(high, x[at:end].max(axis=0), out=high)
                since, near, far = min(since, int(t[at:end].min())), min(near, float(r[at:end].min())), max(far, float(r[at:end].max()))
                m, piece = end - at, b.slice(at, end - at)
                none = pa.nulls(m, _LIST)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(m, np.int32)), pa.array(np.full(m, part << 24 | own)), piece.column("pivot"), piece.column("id"), pa.array(t[at:end]), piece.column("y"), piece.column("r"), _lists(x[at:end]), none, none],
                    _ROW_NAMES,
                )
                held, at = held + m, end
        if own >= 0:
            yield closed()

    dealt = rows.where(F.size("z") == width).mapInArrow(assign, "pivot int, r double, id long, t long, y double, z array<double>")
    order = ["pivot", "t", "id"]
    dealt = dealt.repartitionByRange(max(1, min(8192, n // slice_rows)), *order).sortWithinPartitions(*order)
    cut_rows = stored(dealt.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(cut, _ROWS), "cells")
    heads = cut_rows.where("kind = 1").select("slice", "pivot", "id", "t", "y", "r", "low", "high").toPandas()  # a row a slice
    column = lambda c, t: heads[c].to_numpy(t)
    known = Slices(
        kind, pivots, column("slice", np.int64), column("pivot", np.int64), column("id", np.int64), column("t", np.int64), column("y", np.float64), column("r", np.float64),
        np.stack(heads["low"].to_list()), np.stack(heads["high"].to_list()),
    )
    return CellIndex(cut_rows.where("kind = 0").select("slice", "id", "t", "y", "r", "z"), known)


_PAIR = "slice long, query_id long, t long, limit double, z array<double>"
_FOUND = "query_id long, case_id long, distance double, t long, y double, z array<double>"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def nearest(queries: DataFrame, index: CellIndex, k: int, delay: int | None = None, exclude_self: bool = True, with_z: bool = False) -> DataFrame:
    """``query_id, case_id, distance, rank`` and the case's ``t, y`` (with ``with_z`` its ``z``): the ``k`` nearest cases of each of
    ``queries(id, z)``, ties by the smaller case_id. With ``delay`` only cases that are known ``delay`` before the query's ``t``.

    Exact: a slice is passed over only if its bound exceeds the query's k-th distance. A query without a usable vector, or of
    another width than the cases, has no neighbours.
    """
    spark, names = queries.sparkSession, queries.columns
    w = Window.partitionBy("query_id").orderBy("distance", "case_id")
    if index.slices is None:
        return spark.createDataFrame([], f"query_id long, case_id long, distance double, t long, y double, {'z array<double>, ' * with_z}rank int")
    sent = spark.sparkContext.broadcast(index.slices)
    width, wanted, distance = index.slices.pivots.shape[1], k + exclude_self, DISTANCES[index.slices.kind]
    asked = queries.select(
        F.col("id").cast("long").alias("query_id"),
        (F.col("t").cast("long") - F.lit(delay) if delay is not None and "t" in names else F.lit(_EVER)).alias("t"),
        F.transform("z", lambda x: x.cast("double")).alias("z"),
    ).where((F.size("z") == width) & F.forall("z", lambda x: x.isNotNull() & ~F.isnan(x)) & F.col("t").isNotNull())

    def plan(rest: bool):
        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slices = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                x, t = _vectors(b.column("z")), b.column("t").to_numpy()
                limits = b.column("limit").to_numpy() if rest else np.full(len(t), np.inf)
                rows, found = [], []
                for i in range(len(t)):
                    bounds, first = slices.first(x[i], t[i], wanted)
                    own = np.flatnonzero((bounds <= limits[i]) & np.isfinite(bounds) & ~first if rest else first)
                    found.append(slices.slice[own])
                    rows.append(np.full(len(own), i))
                at = np.concatenate(rows)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), b.column("query_id").take(take), b.column("t").take(take), pa.array(limits[at]), b.column("z").take(take)],
                    ["slice", "query_id", "t", "limit", "z"],
                )

        return pairs

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by slice and part, cases before queries: a slice's cases are held, its queries stream past."""
        slices, key, cases, ready = sent.value, None, [], None
        pivot = dict(zip(slices.slice.tolist(), slices.pivot.tolist(), strict=True))
        for b in batches:
            if not b.num_rows:
                continue
            groups = np.stack([b.column(c).to_numpy() for c in ("slice", "part", "kind")], axis=1)
            edges = [0, *(np.flatnonzero((groups[1:] != groups[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for a, e in zip(edges, edges[1:], strict=False):
                piece, (own, part, kind) = b.slice(a, e - a), groups[a].tolist()
                if (own, part) != key:
                    key, cases, ready = (own, part), [], None
                if kind == 0:
                    cases.append((piece.column("id").to_numpy(), piece.column("t").to_numpy(), piece.column("y").to_numpy(zero_copy_only=False), piece.column("r").to_numpy(), _vectors(piece.column("z"))))
                    continue
                if ready is None:
                    ready, cases = [np.concatenate(c) for c in zip(*cases, strict=True)], []
                ids, times, ys, r, z = ready
                x, limits, cutoffs, askers = _vectors(piece.column("z")), piece.column("r").to_numpy(), piece.column("t").to_numpy(), piece.column("id").to_numpy()
                out = []
                for i in range(len(x)):
                    at = np.arange(np.searchsorted(times, cutoffs[i], "right"))
                    if slices.kind == "euclidean" and np.isfinite(limits[i]):
                        to_pivot = float(euclidean(slices.pivots[pivot[own]][None], x[i])[0])
                        at = at[np.abs(r[at] - to_pivot) <= limits[i] + SLACK * (1 + to_pivot)]
                    elif np.isfinite(limits[i]):
                        at = median_within(z[: len(at)], x[i], limits[i])
                    if exclude_self:
                        at = at[ids[at] != askers[i]]
                    d = distance(z[at], x[i])
                    if len(d) > k:
                        kept = d <= np.partition(d, k - 1)[k - 1]
                        at, d = at[kept], d[kept]
                    best = np.lexsort((ids[at], d))[:k]
                    out.append((np.full(len(best), askers[i]), ids[at[best]], d[best], times[at[best]], ys[at[best]], at[best]))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                vectors = _lists(z[columns[5]]) if with_z else pa.nulls(len(columns[0]), _LIST)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3]), pa.array(columns[4], from_pandas=True), vectors], _FOUND_NAMES)

    n_parts = max(1, -(-queries.count() // PART_QUERIES))
    part = F.pmod(F.xxhash64("query_id"), F.lit(n_parts)).cast("int").alias("part")
    none = lambda t: F.lit(None).cast(t)

    def round_of(rows: DataFrame, rest: bool) -> DataFrame:
        pairs = rows.mapInArrow(plan(rest), _PAIR)
        needed = pairs.select("slice", part).distinct()
        copies = index.rows.join(needed, "slice").select("slice", "part", F.lit(0).alias("kind"), "id", "t", "y", "r", "z")
        visits = pairs.select("slice", part, F.lit(1).alias("kind"), F.col("query_id").alias("id"), "t", none("double").alias("y"), F.col("limit").alias("r"), "z")
        met = copies.unionByName(visits).repartition("slice", "part").sortWithinPartitions("slice", "part", "kind", "t", "id")
        return met.mapInArrow(search, _FOUND)

    ranked = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    one = stored(ranked(round_of(asked, False)).drop("rank"), "first")
    limit = F.when(F.count(F.lit(1)) >= k, F.max("distance") * (1 + SLACK)).otherwise(F.lit(math.inf))
    limits = one.groupBy("query_id").agg(limit.alias("limit"))
    more = asked.join(limits, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(math.inf)))
    both = ranked(one.unionByName(round_of(more, True)))
    return both if with_z else both.drop("z")
