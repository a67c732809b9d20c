"""Nearest cases by the median of three differences, held against brute force; local models of all queries against the plain version."""

import numpy as np
import pytest

from tidegauge.operators import huber, planes
from tidegauge.plans import learning, registry

SMOKE = "/root/testdata/sf0.001"


def _brute(queries, cases, k, delay):
    ids, times, rows = np.array([c[0] for c in cases]), np.array([c[1] for c in cases]), np.array([c[3] for c in cases])
    out = {}
    for i, t, z in queries:
        d = np.median(np.abs(rows - z), axis=1)
        known = np.flatnonzero((ids != i) & (times <= t - delay if delay is not None else True))
        best = known[np.lexsort((ids[known], d[known]))[:k]]
        if len(best):
            out[i] = list(zip(d[best].tolist(), ids[best].tolist(), strict=True))
    return out


def _found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["distance"], r["case_id"]))
    return out


@pytest.mark.parametrize("kind", ["spread", "ties", "copies", "constant", "drift"])
def test_planes_find_what_brute_force_finds(spark, kind):
    rng = np.random.default_rng(11)
    n = 600
    z = {
        "spread": lambda: rng.normal(size=(n, 3)),
        "ties": lambda: rng.integers(0, 4, size=(n, 3)).astype(float),
        "copies": lambda: np.repeat(rng.normal(size=(n // 30, 3)), 30, axis=0),
        "constant": lambda: np.ones((n, 3)),
        "drift": lambda: np.arange(n)[:, None] / 50.0 + rng.normal(size=(n, 3)) / 9,
    }[kind]()
    t = np.arange(n) if kind == "drift" else rng.integers(0, 300, n)
    cases = [(i, int(t[i]), float(i % 2), z[i].tolist()) for i in rng.permutation(n).tolist()]
    queries = [(c[0], c[1], c[3]) for c in cases]
    known = spark.createDataFrame(cases, "id long, t long, y double, z array<double>")
    asked = spark.createDataFrame(queries, "id long, t long, z array<double>")
    for k, delay, size in ((7, 20, 16), (25, 40, 64), (7, None, 4096)):
        assert _found(planes.nearest(asked, known, k, delay, tile_rows=size)) == _brute(queries, cases, k, delay)


def test_planes_take_few_cases_and_rows_without_a_vector(spark):
    known = spark.createDataFrame([(1, 5, 1.0, [0.0, 0.0, 0.0]), (2, 5, None, [1.0, 9.0, 1.0]), (3, None, 1.0, [0.0, 0.0, 0.0]), (4, 5, 1.0, [0.0, None, 0.0]), (5, 5, 1.0, [0.0, 0.0])], "id long, t long, y double, z array<double>")
    asked = spark.createDataFrame([(1, 9, [0.0, 0.0, 0.0]), (7, 9, [0.0, 9.0, 0.0]), (8, 4, [0.0, 0.0, 0.0]), (9, None, [0.0, 0.0, 0.0]), (10, 9, None)], "id long, t long, z array<double>")
    found = planes.nearest(asked, known, 3, 1, with_z=True)
    assert _found(found) == {1: [(1.0, 2)], 7: [(0.0, 1), (1.0, 2)]}
    assert {(r["case_id"], r["t"], r["y"], tuple(r["z"])) for r in found.collect()} == {(1, 5, 1.0, (0.0, 0.0, 0.0)), (2, 5, None, (1.0, 9.0, 1.0))}
    assert planes.nearest(asked, known.where("id > 9"), 3, 1).count() == 0


def test_local_models_side_by_side_are_the_plain_ones():
    rng = np.random.default_rng(5)
    m, k = 80, 25
    n = rng.integers(1, k + 1, m)
    n[:40] = k
    x, q, w = rng.normal(size=(m, k, 3)).round(1), rng.normal(size=(m, 3)).round(1), np.exp(-3 * rng.random((m, k)))
    y = np.where(np.arange(m)[:, None] % 2, rng.normal(size=(m, k)), rng.integers(0, 2, (m, k)))
    w[rng.random((m, k)) < 0.1] = 0.0
    w[3] = 0.0
    for trees, depth in ((1, 2), (60, 2), (20, 3)):
        plain = [huber.local_boosting(x[i, : n[i]], y[i, : n[i]], w[i, : n[i]], q[i], trees, depth=depth) for i in range(m)]
        assert huber.local_boosting_many(x, y, w, n, q, trees, depth=depth).tolist() == plain


def test_every_case_has_its_local_model(spark):
    cases = {r["id"] for r in learning._library(spark, SMOKE).collect()}
    found = registry.QUERIES["delayed_local_models"](spark, SMOKE).collect()
    assert len(found) == len(cases) and {r["id"] for r in found} == cases
    assert all(r["local_model"] is not None and abs(r["local_blend"] - 0.7 * r["local_model"] - 0.3 * r["local_mean"]) < 2e-6 for r in found)
