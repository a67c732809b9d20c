"""Ridge models of many training sets from one scan of additive sums.

The rows of a group lie in order of time, and every training set of (nested) expanding folds is the rows before some place.
All those places cut a group into cells; one scan sums the products of features and target in each cell (a Gram matrix with
the counts and the sums in it). A training set's sums are a running total of cells, from which its standardised ridge model
follows by a small linear system, one group's systems to a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.timeline import DAY, bucket
from tidegauge.sources.scratch import stored


def fold_places(n: int, outer: int, inner: int = 0) -> list[tuple[int, int, int, int]]:
    """``(outer, inner, first, end)`` of every test part of ``n`` rows in time order, which all rows before ``first`` train: the
    outer folds (inner 0), and with ``inner`` the folds of each outer training set. A test part has n div (folds + 1) rows; none
    where that is zero."""
    found = []
    for i in range(1, outer + 1):
        size = n // (outer + 1)
        start = n - (outer - i + 1) * size
        if size:
            found.append((i, 0, start, start + size))
            part = start // (inner + 1) if inner else 0
            found += [(i, j, start - (inner - j + 1) * part, start - (inner - j) * part) for j in range(1, inner + 1) if part]
    return found


def placed_rows(df: DataFrame, by: Sequence[str], order: str, t: str = "t", width: int = DAY) -> DataFrame:
    """``df`` with ``pos`` (from 0) and ``total`` within ``by`` in the order of ``t`` and ``order``: counts per time bucket carried over, and
    a rank inside it."""
    rows = df.withColumn("_b", bucket(F.col(t), width))
    counts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*by, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"), F.sum("_c").over(Window.partitionBy(*by)).alias("total"))
    local = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(t, order)) - 1
    return rows.withColumn("_l", local).join(shift, [*by, "_b"]).withColumn("pos", F.col("_l") + F.col("_s")).drop("_b", "_l", "_s")


def gram_cells(rows: DataFrame, group: str, cell: str, features: Sequence[str], target: str) -> DataFrame:
    """``group, cell, sums``: per cell the flattened matrix of products of (1, features, target). Tasks add up their own rows first,
    so what is shuffled is a matrix for each cell and task."""
    width = len(features) + 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([np.ones(b.num_rows), *[b.column(c).to_numpy() for c in (*features, target)]])
            keys = np.column_stack([b.column("_g").to_numpy(), b.column("_c").to_numpy()])
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            keys, x = keys[order], x[order]
            edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            for a, e in zip(edges, np.append(edges[1:], len(keys)), strict=True):
                key = tuple(keys[a].tolist())
                held[key] = held.get(key, 0) + x[a:e].T @ x[a:e]
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int64()), pa.array([m.reshape(-1).tolist() for m in held.values()], pa.list_(pa.float64()))],
                ["_g", "_c", "m"],
            )

    wanted = rows.select(F.col(group).cast("long").alias("_g"), F.col(cell).cast("long").alias("_c"), *[F.col(c).cast("double").alias(c) for c in (*features, target)])
    parts = wanted.mapInArrow(add, "_g long, _c long, m array<double>")
    sums = F.array(*[F.sum(F.get("m", F.lit(i))) for i in range(width * width)]).alias("sums")
    return parts.groupBy(F.col("_g").alias(group), F.col("_c").alias(cell)).agg(sums)


def ridge_of(sums: np.ndarray, alpha: float) -> tuple[np.ndarray, float] | None:
    """Weights and intercept, on the features as they are, of a ridge model on standardised features (population std, 1 where a
    feature does not vary); None without rows."""
    n = sums[0, 0]
    if n < 1:
        return None
    mean = sums[0, 1:-1] / n
    c = sums[1:-1, 1:-1] - n * np.outer(mean, mean)
    var = np.diag(c) / n
    sd = np.where(var > 1e-12 * np.maximum(1.0, mean * mean), np.sqrt(np.maximum(var, 0)), 1.0)
    y = sums[0, -1] / n
    right = (sums[1:-1, -1] - n * mean * y) / sd
    w = np.linalg.solve(c / np.outer(sd, sd) + alpha * np.eye(len(mean)), right) / sd
    return w, float(y - w @ mean)


def ridge_folds(df: DataFrame, group: str, features: Sequence[str], target: str, order: str, outer: int, inner: int = 0, alpha: float = 1.0, t: str = "t") -> DataFrame:
    """``group, order, outer, inner, score, target`` for every row of a test part: out-of-fold scores of the outer folds (inner 0), and
    with ``inner`` those of the folds inside each outer training set. ``group`` is a whole number (the lag, say); rows with a null
    feature, target or time take no part. Values are taken less their overall means, so that sums of products stay small."""
    names = [*features, target]
    keep = df.where(" and ".join(f"`{c}` is not null" for c in [*names, group, t])).select(F.col(group).cast("long").alias(group), order, t, *[F.col(c).cast("double").alias(c) for c in names])
    rows = stored(placed_rows(keep, [group], order, t).withColumnRenamed("pos", "_pos").drop("total"), "placed")
    means = rows.agg(*[F.avg(c).alias(c) for c in names]).first()
    centre = {c: means[c] or 0.0 for c in names}
    places = {r[group]: fold_places(r["n"], outer, inner) for r in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a group
    parts = [(g, *p) for g, own in places.items() for p in own]
    schema = f"{group} long, outer int, inner int, _first long, _end long"
    folds = df.sparkSession.createDataFrame(parts, schema)
    cuts = folds.select(group, F.explode(F.array("_first", "_end")).alias("cut")).distinct().groupBy(group).agg(F.array_sort(F.collect_list("cut")).alias("_cuts"))
    celled = rows.withColumns({c: F.col(c) - centre[c] for c in names}).join(cuts, group).withColumn("_cell", F.size(F.filter("_cuts", lambda x: x <= F.col("_pos"))))
    cells = gram_cells(celled, group, "_cell", features, target)
    width = len(names) + 1

    def solve(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        own = places[key[0]]
        borders = sorted({p for part in own for p in part[2:]})
        upto = np.zeros((len(borders) + 1, width, width))
        for k, m in zip(g["_cell"], g["sums"], strict=True):
            upto[k] = np.asarray(m).reshape(width, width)
        upto = np.cumsum(upto, axis=0)
        made = []
        for i, j, first, end in own:
            fit = ridge_of(upto[borders.index(first)], alpha)  # cells before this border
            if fit:
                made.append((key[0], i, j, first, end, fit[0].tolist(), fit[1]))
        return pd.DataFrame(made, columns=[group, "outer", "inner", "_first", "_end", "_w", "_b"])

    models = cells.groupBy(group).applyInPandas(solve, f"{schema}, _w array<double>, _b double")
    met = rows.join(models, group).where("_pos >= _first and _pos < _end")
    score = F.col("_b") + F.lit(centre[target])
    for k, c in enumerate(features):
        score = score + F.get("_w", F.lit(k)) * (F.col(c) - centre[c])
    return met.select(group, order, "outer", "inner", score.alias("score"), F.col(target).alias("target"))


def ridge_cv(df: DataFrame, group: str, features: Sequence[str], target: str, order: str, folds: int, alpha: float = 1.0, min_rows: int = 0, t: str = "t") -> DataFrame:
    """``group, n, r2, mae``: means over expanding folds of each fold's R2 and mean absolute error; null where a group has fewer
    than ``min_rows`` complete rows."""
    found = ridge_folds(df, group, features, target, order, folds, 0, alpha, t)
    e = F.col("target") - F.col("score")
    each = found.groupBy(group, "outer").agg((1 - F.sum(e * e) / F.nullif(F.var_pop("target") * F.count("target"), F.lit(0.0))).alias("r2"), F.avg(F.abs(e)).alias("mae"))
    mean = each.groupBy(F.col(group).alias("_g")).agg(F.avg("r2").alias("_r2"), F.avg("mae").alias("_mae"))
    complete = F.lit(True)
    for c in (*features, target, t):
        complete = complete & F.col(c).isNotNull()
    sizes = df.groupBy(group).agg(F.count_if(complete).alias("n"))
    enough = F.col("n") >= min_rows
    return sizes.join(mean, F.col(group) == F.col("_g"), "left").select(group, "n", F.when(enough, F.col("_r2")).alias("r2"), F.when(enough, F.col("_mae")).alias("mae"))
