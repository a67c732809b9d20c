"""Ridge models from additive sums against models fitted on the rows of each training set."""

import numpy as np
import pytest

from tidegauge.operators import gram


def plain_ridge(x, y, alpha):
    sd = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = (x - x.mean(axis=0)) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda q: y.mean() + ((q - x.mean(axis=0)) / sd) @ w


def test_fold_places():
    assert gram.fold_places(13, 3) == [(1, 0, 4, 7), (2, 0, 7, 10), (3, 0, 10, 13)]
    assert gram.fold_places(13, 3, 2) == [
        (1, 0, 4, 7), (1, 1, 2, 3), (1, 2, 3, 4), (2, 0, 7, 10), (2, 1, 3, 5), (2, 2, 5, 7), (3, 0, 10, 13), (3, 1, 4, 7), (3, 2, 7, 10),
    ]
    assert gram.fold_places(3, 5) == [] and gram.fold_places(0, 2, 2) == []


@pytest.mark.parametrize("inner", [0, 3])
def test_nested_folds(spark, inner):
    """Three groups, equal times, a feature that does not vary at first, large offsets, incomplete rows, many tasks."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(3):
        for i in range(150 + 7 * g):
            x = [1e6 + rng.normal(), float(i > 60), rng.normal() if i % 17 else None]
            rows.append((g, 1000 * g + i, int(i // 2 * 86_400_000_000 / 9), *x, 5e5 + float(rng.normal() + (x[2] or 0) * 2)))
    rows.append((None, 9999, 5, 1.0, 1.0, 1.0, 1.0))
    rows.append((0, 9998, None, 1.0, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "lag long, id long, t long, a double, b double, c double, y double").repartition(6)
    got = {(r["lag"], r["outer"], r["inner"], r["id"]): r["score"] for r in gram.ridge_folds(df, "lag", ["a", "b", "c"], "y", "id", 4, inner, 2.0).collect()}
    n = 0
    for g in range(3):
        own = sorted((r for r in rows if r[0] == g and r[5] is not None and r[2] is not None), key=lambda r: (r[2], r[1]))
        x, y = np.array([r[3:6] for r in own]), np.array([r[6] for r in own])
        for i, j, first, end in gram.fold_places(len(own), 4, inner):
            fit = plain_ridge(x[:first], y[:first], 2.0)
            for k in range(first, end):
                n += 1
                assert got[g, i, j, own[k][1]] == pytest.approx(float(fit(x[k])), rel=1e-9)
    assert n == len(got)


def test_cv_by_group(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, i * 3_600_000_000, float(x := rng.normal()), float(2 * x + 0.1 * rng.normal()) if g else float(rng.normal())) for g in (0, 1) for i in range(120)] + [(2, 0, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "lag long, id long, t long, x double, y double")
    got = {r["lag"]: r for r in gram.ridge_cv(df, "lag", ["x"], "y", "id", 5, min_rows=40).collect()}
    assert got[1]["r2"] > 0.95 and got[1]["mae"] < 0.2 and got[0]["r2"] < 0.3
    assert (got[2]["n"], got[2]["r2"], got[2]["mae"]) == (1, None, None)
    assert gram.ridge_folds(df.limit(0), "lag", ["x"], "y", "id", 3).collect() == []


def test_one_scan_of_sums(spark):
    """A matrix for each cell and task leaves the tasks, whatever the rows."""
    df = spark.range(5000).selectExpr("0L as g", "id % 7 as c", "double(id % 13) as x", "double(id % 5) as y").repartition(3)
    cells = gram.gram_cells(df, "g", "c", ["x"], "y").collect()
    rows = np.array([(1.0, i % 13, i % 5) for i in range(5000)])
    for r in cells:
        own = rows[np.arange(5000) % 7 == r["c"]]
        assert np.array(r["sums"]).reshape(3, 3) == pytest.approx(own.T @ own)
    assert len(cells) == 7
