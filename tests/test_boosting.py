"""Boosting over sums of equal bins grows the trees of ``GBTRegressor``; medians of prepared features are exact."""

import statistics

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tidegauge.operators import models, selection


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, float(i % 7), float(i * i % 23), (i * 37 % 101) + 5.0 * (i % 7 > 3) * (i * i % 23)) for i in range(4000)]
    return spark.createDataFrame(made, "i long, a double, b double, _y double").cache()


def test_trees_of_sums_are_the_trees_of_rows(rows):
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="_x").transform(rows)
    want = GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=20, maxDepth=3, seed=42).fit(ready).transform(ready).select("i", F.col("prediction").alias("want"))
    got = models.BoostedTrees(20, 3, 1.0, 42).fit(rows, ["a", "b"]).transform(rows)
    both = got.join(want, "i").select("prediction", "want").collect()
    assert len(both) == 4000 and all(r["prediction"] == pytest.approx(r["want"], rel=1e-9) for r in both)


def test_trees_grow_from_sums(rows, monkeypatch):
    """However many rows: a tree is given a row per different vector of bins, of all rows that the coins take."""
    sizes = []
    fit = models.DecisionTreeRegressor.fit
    monkeypatch.setattr(models.DecisionTreeRegressor, "fit", lambda self, df: (sizes.append(df.agg(F.count("*"), F.sum("_w")).first()), fit(self, df))[1])
    models.REGRESSORS["boosting"]().fit(rows, ["a", "b"])
    different = rows.select("a", "b").distinct().count()
    assert len(sizes) == 20 and all(n <= different < 100 and 3000 < w < 3400 for n, w in sizes)
    assert len({w for _, w in sizes}) > 10  # other coins for each tree


def test_search_scores_every_row(rows):
    valid = rows.withColumn("a", F.when(F.col("i") % 5 != 0, F.col("a")))
    found = models.model_search(rows, valid, ["a", "b"], "_y", ["mean", "ridge", "boosting"])
    assert [f[2] for f in found] == ["boosting", "ridge", "mean"]
    assert models.fit_regressor("boosting", rows, ["a", "b"], "_y").transform(valid).where("score is not null").count() == 4000


def test_more_values_than_bins_and_constant_columns(spark):
    df = spark.range(500).select(F.col("id").cast("double").alias("a"), F.lit(3.0).alias("b"), (F.col("id") * 2.0).alias("_y"))
    few, same = models.bin_cuts(df, ["a", "b"])
    assert 20 < len(few) <= 31 and few == sorted(set(few)) and same == [3.0]
    out = models.BoostedTrees(3, 3, 1.0, 1).fit(df, ["a", "b"]).transform(df).agg(F.avg("prediction"), F.count("prediction")).first()
    assert out[0] == pytest.approx(499.0) and out[1] == 500


def test_medians(spark, monkeypatch):
    monkeypatch.setattr(selection, "FINISH_ROWS", 10)
    values = [(float(i * 7 % 50) if i % 3 else None, float("nan") if i % 4 == 0 else float(i % 5), i) for i in range(300)]
    df = spark.createDataFrame(values, "a double, `b c` double, d int")
    want = [statistics.median_low([v[k] for v in values if v[k] is not None and v[k] == v[k]]) for k in range(3)]
    assert models.medians(df, ["a", "b c", "d"]) == want
    with pytest.raises(ValueError):
        models.medians(df.withColumn("a", F.lit(None).cast("double")), ["a", "b c"])
