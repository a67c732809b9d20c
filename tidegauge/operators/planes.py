"""Exact nearest cases by the median of three differences, found in planes.

The median of three differences is at most r exactly where two of them are, so it is the least of the three planes' distances, a plane
being a pair of features and its distance the larger difference. In each plane the cases are dealt to strips by the one feature and cut
into tiles by the other; a tile's box bounds the distance of everything in it from below. A query first visits the tile with the lowest
bound in each plane, more where few of a tile's rows are known in time, for a limit of its k-th distance, and then every tile whose
bound does not exceed the limit. Visits meet tiles by a shuffle, packed by tile; what is broadcast are the boxes.
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

from tidegauge.operators.cells import _EVER, _lists, _vectors
from tidegauge.sources.scratch import stored

PLANES = ((0, 1), (0, 2), (1, 2))
#: Rows of a tile at least, tiles of a plane at most (48 bytes each are broadcast; and one more for each strip).
TILE_ROWS, MAX_TILES = 1_024, 16_384
#: Queries that one copy of a tile serves, queries that one task sends to their tiles at least.
PART_QUERIES, GROUP_QUERIES = 4_194_304, 8_192
#: Queries whose bounds are computed at once, classes of limits among them; distances that are computed at once, rows given out at once.
AT_ONCE, LIMIT_CLASSES, BLOCK, OUT_ROWS = 64, 4, 1 << 17, 8_192
#: The first visits go on until so many times the wanted rows are expected to be known.
AMPLE = 4

_CASE = np.dtype([("id", "<i8"), ("t", "<i8"), ("y", "<f8"), ("z", "<f8", 3)])
_VISIT = np.dtype([("id", "<i8"), ("t", "<i8"), ("limit", "<f8"), ("last", "<i8"), ("z", "<f8", 3)])
_TILE = "plane int, tile long, n long, since long, until long, first long, low_a double, high_a double, low_b double, high_b double, rows binary"
_TILE_TYPES = [pa.int32(), *[pa.int64()] * 5, *[pa.float64()] * 4, pa.binary()]
_PACKED = "plane int, tile long, part int, rows binary"
_LIMIT = "query_id long, plane int, distance double, last long, few array<double>"
_FOUND = "query_id long, case_id long, distance double, t long, y double, z array<double>"


def _batch(schema: str, columns: list, types: list | None = None) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)] if types else columns, names)


@dataclass
class Boxes:
    """The tiles of a plane in order of their smallest id."""

    tile: np.ndarray
    n: np.ndarray
    since: np.ndarray
    until: np.ndarray
    first: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def near(self, q: np.ndarray, cutoffs: np.ndarray, reach: float) -> np.ndarray:
        """Places of the tiles within ``reach`` of the box around ``q`` that begin in time for one of them."""
        far = np.zeros(len(self.tile))
        for j in (0, 1):
            np.maximum(far, self.low[:, j] - q[:, j].max(), out=far)
            np.maximum(far, q[:, j].min() - self.high[:, j], out=far)
        return np.flatnonzero((far <= reach) & (self.since <= cutoffs.max()))

    def bounds(self, q: np.ndarray, cutoffs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances from each row of ``q`` to anything in the tiles ``at``, infinite where nothing is known in time."""
        out = np.zeros((len(q), len(at)))
        for j in (0, 1):
            x = q[:, j, None]
            np.maximum(out, self.low[at, j] - x, out=out)
            np.maximum(out, x - self.high[at, j], out=out)
        out[self.since[at] > cutoffs[:, None]] = np.inf
        return out

    def expected(self, cutoffs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows that are known at each cutoff, were a tile's rows spread evenly over its time."""
        since, until, n = self.since[at], self.until[at], self.n[at]
        share = (cutoffs[:, None] - since) / np.maximum(until - since, 1).astype(float)
        return np.where(until <= cutoffs[:, None], n, n * np.clip(share, 0.0, 1.0))

    def first_visits(self, q: np.ndarray, cutoffs: np.ndarray, wanted: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Queries and places of the tiles that they visit first: the nearest of those that meet the queries' box, of all where these
        are not expected to hold enough known rows."""
        whole = at is not None
        at = at if whole else self.near(q, cutoffs, 0.0)
        bounds, known = self.bounds(q, cutoffs, at), self.expected(cutoffs, at)
        known[~np.isfinite(bounds)] = 0.0
        order = np.argsort(bounds, axis=1, kind="stable")
        held = np.cumsum(np.take_along_axis(known, order, axis=1), axis=1)
        before = held - np.take_along_axis(known, order, axis=1)
        take = (before < wanted) & np.isfinite(np.take_along_axis(bounds, order, axis=1))
        poor = np.zeros(len(q), bool) if whole else (held[:, -1] < wanted if len(at) else np.ones(len(q), bool))
        poor &= cutoffs >= self.since.min()
        rows, place = np.nonzero(take & ~poor[:, None])
        rows, found = [rows], [at[order[rows, place]]]
        for i in np.flatnonzero(poor):
            r, c = self.first_visits(q[i : i + 1], cutoffs[i : i + 1], wanted, np.arange(len(self.tile)))
            rows.append(r + i)
            found.append(c)
        return np.concatenate(rows), np.concatenate(found)

    def visits_within(self, q: np.ndarray, cutoffs: np.ndarray, limits: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and places of the tiles that may hold a case nearer than the limit, or as near and of no larger id than ``last``."""
        at = self.near(q, cutoffs, limits.max())
        bounds = self.bounds(q, cutoffs, at)
        near = (bounds < limits[:, None]) | ((bounds == limits[:, None]) & (self.first[at] <= last[:, None]))
        rows, place = np.nonzero(near & np.isfinite(bounds))
        return rows, at[place]


def _blocks(x: np.ndarray, limits: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of blocks of rows that lie close together in a plane and have limits alike."""
    by_limit = np.argsort(limits, kind="stable")
    finite = int(np.isfinite(limits).sum())
    for some in [*np.array_split(by_limit[:finite], LIMIT_CLASSES), by_limit[finite:]]:
        strips = math.ceil(math.sqrt(len(some) / AT_ONCE)) if len(some) else 0
        for strip in np.array_split(some[np.argsort(x[some, 0], kind="stable")], strips) if strips else []:
            strip = strip[np.argsort(x[strip, 1], kind="stable")]
            for lo in range(0, len(strip), AT_ONCE):
                yield strip[lo : lo + AT_ONCE]


def _clean(df: DataFrame, *columns) -> DataFrame:
    z = F.transform("z", lambda x: x.cast("double"))
    return df.select(F.col("id").cast("long").alias("id"), *columns, z.alias("z")).where((F.size("z") == 3) & F.forall("z", lambda x: x.isNotNull() & ~F.isnan(x)))


def tiles(rows: DataFrame, n: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Tiles of ``n`` rows ``(id, t, y, z)`` in every plane, a row each: bounds, and the rows in order of time, packed."""
    size = max(tile_rows, -(-n // MAX_TILES))
    strips = max(1, min(4096, round(math.sqrt(n / size))))

    def cut(plane: int):
        a, b = PLANES[plane]

        def tile(held: np.ndarray, part: int, own: int) -> pa.RecordBatch:
            held = held[np.lexsort((held["id"], held["t"]))]
            x, y = held["z"][:, a], held["z"][:, b]
            values = [plane, part << 24 | own, len(held), held["t"][0], held["t"][-1], held["id"].min(), x.min(), x.max(), y.min(), y.max(), held.tobytes()]
            return _batch(_TILE, [[v] for v in values], _TILE_TYPES)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, own, part = np.empty(0, _CASE), 0, 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                part, new = batch.column("part")[0].as_py(), np.empty(batch.num_rows, _CASE)
                for c in ("id", "t", "y"):
                    new[c] = batch.column(c).to_numpy(zero_copy_only=False)
                new["z"] = _vectors(batch.column("z"))
                held = np.concatenate([held, new])
                while len(held) >= size:
                    yield tile(held[:size], part, own)
                    held, own = held[size:], own + 1
            if len(held):
                yield tile(held, part, own)

        by = lambda *columns: [F.get("z", F.lit(c)) for c in columns] + [F.col("id")]
        dealt = rows.repartitionByRange(strips, *by(a, b)).sortWithinPartitions(*by(b, a))
        return dealt.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, _TILE)

    return cut(0).unionByName(cut(1)).unionByName(cut(2))


def nearest(queries: DataFrame, cases: DataFrame, k: int, delay: int | None = None, exclude_self: bool = True, with_z: bool = False, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``query_id, case_id, distance, rank`` and the case's ``t, y`` (with ``with_z`` its ``z``): the ``k`` nearest of ``cases(id, t, y, z)``
    to each of ``queries(id, t, z)``, ties by the smaller case_id; with ``delay`` only cases known ``delay`` before the query's ``t``.
    Vectors have three numbers; rows without such a vector are left out, cases without ``t`` are never known in time."""
    spark = queries.sparkSession
    rows = stored(_clean(cases, F.coalesce(F.col("t").cast("long"), F.lit(_EVER)).alias("t"), F.col("y").cast("double").alias("y")), "vectors")
    asked = _clean(queries, (F.col("t").cast("long") - F.lit(delay) if delay is not None else F.lit(_EVER)).alias("t")).where(F.col("t").isNotNull())
    n = rows.count()
    if not n:
        return spark.createDataFrame([], f"query_id long, case_id long, distance double, t long, y double, {'z array<double>, ' * with_z}rank int")
    index = stored(tiles(rows, n, tile_rows), "tiles")
    heads = index.drop("rows").toPandas().sort_values(["plane", "first", "tile"])
    boxes = []
    for plane in range(3):
        h = heads[heads["plane"] == plane]
        numbers = [h[c].to_numpy(np.int64) for c in ("tile", "n", "since", "until", "first")]
        boxes.append(Boxes(*numbers, h[["low_a", "low_b"]].to_numpy(np.float64), h[["high_a", "high_b"]].to_numpy(np.float64)))
    sent = spark.sparkContext.broadcast(boxes)
    n_asked = asked.count()
    n_parts, groups = max(1, -(-n_asked // PART_QUERIES)), max(1, min(2048, n_asked // GROUP_QUERIES))
    tasks = int(min(2048, max(1, len(heads) * n_parts // 2)))

    def plan(rest: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = np.empty(batch.num_rows, _VISIT)
                for c in ("id", "t", "limit", "last"):
                    q[c] = batch.column(c).to_numpy()
                q["z"] = _vectors(batch.column("z"))
                part = int(batch.column("part")[0].as_py())
                for plane, (known, pair) in enumerate(zip(sent.value, PLANES, strict=True)):
                    own, at, x = [], [], q["z"][:, list(pair)]
                    for some in _blocks(x, q["limit"]):
                        t = q["t"][some]
                        r, c = known.visits_within(x[some], t, q["limit"][some], q["last"][some]) if rest else known.first_visits(x[some], t, AMPLE * (k + exclude_self))
                        own.append(some[r])
                        at.append(c)
                    own, at = np.concatenate(own), np.concatenate(at)
                    order = np.argsort(at, kind="stable")
                    own, at = own[order], at[order]
                    edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else [0]
                    packed = [q[own[a:e]].tobytes() for a, e in zip(edges, edges[1:], strict=False)]
                    if packed:
                        m = len(packed)
                        yield _batch(_PACKED, [np.full(m, plane, np.int32), known.tile[at[edges[:-1]]], np.full(m, part, np.int32), packed], [pa.int32(), pa.int64(), pa.int32(), pa.binary()])

        return run

    def distances(case: np.ndarray, q: np.ndarray, plane: int) -> np.ndarray:
        """Distances in a plane, infinite where a case is not known in time or is the query itself."""
        d = np.zeros((len(q), len(case)))
        for j in PLANES[plane]:
            np.maximum(d, np.abs(case["z"][:, j] - q["z"][:, j, None]), out=d)
        d[case["t"] > q["t"][:, None]] = np.inf
        if exclude_self:
            d[case["id"] == q["id"][:, None]] = np.inf
        return d

    def limits_of(case: np.ndarray, q: np.ndarray, plane: int) -> pa.RecordBatch:
        """The k-th distance in a tile and the id of the k-th case, or the distances of what few rows are known."""
        d = distances(case, q, plane)
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if len(case) >= k else np.full(len(q), np.inf)
        full = np.isfinite(kth)
        equal = d == kth[:, None]
        last = np.where(equal, case["id"], -_EVER - 1).max(axis=1)
        wanted = k - (d < kth[:, None]).sum(axis=1)
        for i in np.flatnonzero(full & (equal.sum(axis=1) > wanted)):
            last[i] = np.partition(case["id"][equal[i]], wanted[i] - 1)[wanted[i] - 1]
        few = [None if f else row[np.isfinite(row)].tolist() for f, row in zip(full, d, strict=True)]
        return _batch(_LIMIT, [pa.array(q["id"]), pa.array(np.full(len(q), plane, np.int32)), pa.array(kth, mask=~full), pa.array(last, mask=~full), pa.array(few, pa.list_(pa.float64()))])

    def found_by(case: np.ndarray, q: np.ndarray, plane: int) -> pa.RecordBatch | None:
        """The ``k`` best of a tile within each query's limit; a case belongs to the first plane that has it within the limit."""
        d = distances(case, q, plane)
        i, j = np.nonzero((d <= q["limit"][:, None]) & np.isfinite(d))
        ids, limit, last = case["id"][j], q["limit"][i], q["last"][i]
        gap = np.abs(case["z"][j] - q["z"][i])
        within = [np.maximum(gap[:, a], gap[:, b]) for a, b in PLANES]
        has = [(w < limit) | ((w == limit) & (ids <= last)) for w in within]
        mine = has[plane]
        for earlier in has[:plane]:
            mine = mine & ~earlier
        mine = np.flatnonzero(mine)
        if not len(mine):
            return None
        i, j, ids, best = i[mine], j[mine], ids[mine], np.minimum(np.minimum(within[0], within[1]), within[2])[mine]
        order = np.lexsort((ids, best, i))
        starts = np.flatnonzero(np.diff(i[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
        order = order[place < k]
        i, j = i[order], j[order]
        z = _lists(case["z"][j]) if with_z else pa.nulls(len(j), pa.list_(pa.float64()))
        return _batch(_FOUND, [pa.array(q["id"][i]), pa.array(ids[order]), pa.array(best[order]), pa.array(case["t"][j]), pa.array(case["y"][j], from_pandas=True), z])

    def search(answer):
        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
            """A tile's rows with some of its visits, sorted by tile and part, the tile before its visits."""
            case, where, held, size = np.empty(0, _CASE), 0, [], 0
            for batch in batches:
                for plane, kind, packed in zip(batch.column("plane").to_pylist(), batch.column("kind").to_pylist(), batch.column("rows"), strict=True):
                    if held and (kind == 0 or size * len(case) >= BLOCK * _VISIT.itemsize):
                        yield case, np.frombuffer(b"".join(held), _VISIT), where
                        held, size = [], 0
                    if kind == 0:
                        case, where = np.frombuffer(packed.as_py(), _CASE), plane
                    else:
                        held.append(packed.as_py())
                        size += len(held[-1])
            if held:
                yield case, np.frombuffer(b"".join(held), _VISIT), where

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for case, q, plane in visits(batches):
                step = max(1, BLOCK // len(case))
                for lo in range(0, len(q), step):
                    out = answer(case, q[lo : lo + step], plane)
                    if out is not None:
                        held.append(out)
                        n += out.num_rows
                        if n >= OUT_ROWS:
                            yield pa.concat_batches(held)
                            held, n = [], 0
            if held:
                yield pa.concat_batches(held)

        return run

    def met(asking: DataFrame, rest: bool, answer, schema: str) -> DataFrame:
        dealt = asking.repartition(groups, "id").withColumn("part", F.spark_partition_id() % n_parts)
        visits = dealt.mapInArrow(plan(rest), _PACKED).withColumn("kind", F.lit(1))
        copies = index.select("plane", "tile", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), "rows", F.lit(0).alias("kind"))
        both = copies.unionByName(visits).repartition(tasks, "plane", "tile", "part").sortWithinPartitions("plane", "tile", "part", "kind")
        return both.mapInArrow(search(answer), schema)

    limited = lambda df, distance, last: df.select("id", "t", distance.alias("limit"), last.alias("last"), "z")
    none, any_id = F.lit(math.inf), F.lit(_EVER)
    seen = met(limited(asked, none, any_id), False, limits_of, _LIMIT).repartition("query_id")
    # a plane's tiles share no case, so those with less than k known rows are counted together
    few = F.try_element_at(F.sort_array(F.flatten(F.collect_list("few"))), F.lit(k))
    full = F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "last")))
    planes = seen.groupBy("query_id", "plane").agg(full.alias("_full"), few.alias("_few"))
    either = F.array(F.col("_full"), F.when(F.col("_few").isNotNull(), F.struct(F.col("_few").alias("distance"), any_id.alias("last"))))
    limits = planes.groupBy("query_id").agg(F.min(F.array_min(either)).alias("_l"))
    more = asked.join(limits, asked["id"] == limits["query_id"], "left")
    found = met(limited(more, F.coalesce(F.col("_l.distance"), none), F.coalesce(F.col("_l.last"), any_id)), True, found_by, _FOUND).repartition(max(1, min(2048, 4 * n_asked // GROUP_QUERIES)), "query_id")
    w = Window.partitionBy("query_id").orderBy("distance", "case_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best if with_z else best.drop("z")
