"""The case base of the delayed searches: computed once, pruned without loss."""

import numpy as np

from tidegauge.operators import cells
from tidegauge.plans import learning

SMOKE = "/root/testdata/sf0.001"


def test_pruning_by_half_of_the_features_loses_no_row():
    rng = np.random.default_rng(7)
    for width in (1, 2, 3, 4, 5):
        rows, q = rng.normal(size=(500, width)).round(1), rng.normal(size=width).round(1)
        d = np.median(np.abs(rows - q), axis=1)
        assert np.array_equal(cells.median_gap(rows, q), d)
        for limit in np.quantile(d, [0.0, 0.05, 0.5]):
            kept = cells.median_within(rows, q, limit)
            assert set(np.flatnonzero(d <= limit)) <= set(kept)
            assert width != 3 or len(kept) == (d <= limit).sum()


def test_cases_are_read_from_a_table_and_not_swept_for_every_reader(spark):
    plan = learning._library(spark, SMOKE)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Window" not in plan


def test_a_column_without_values_drops_no_row_and_medians_hold_no_column(spark):
    from tidegauge.operators import retrieval

    rows = spark.createDataFrame([(1, 1.0, None), (2, 5.0, None), (3, None, None)], "id long, a double, b double")
    scaled = retrieval.scaled_features(rows, ["a", "b"])
    assert "percentile" not in scaled._jdf.queryExecution().toString()
    got = {r["id"]: r["z"] for r in scaled.collect()}
    assert len(got) == 3 and got[3][0] == 0.0 and got[3][1] is None
