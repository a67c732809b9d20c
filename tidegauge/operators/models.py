"""Model fitting on pyspark.ml: small fixed pipelines, out-of-fold scores and calibration.

Solvers differ from other libraries in the last digits; results are checked by properties, not digits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Bucketizer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GeneralizedLinearRegression, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.selection import ranked_values, value_cuts
from tidegauge.sources.scratch import stored


def _missing(c: str) -> str:
    return f"(`{c}` IS NULL OR isnan(`{c}`))"


def medians(train: DataFrame, features: Sequence[str]) -> list[float]:
    """The exact lower median of every feature (nulls and NaN apart), by selection: ``Imputer`` with a relative error of 0 gathers
    all values of all columns in the driver."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.expr(f"CASE WHEN NOT {_missing(c)} THEN double(`{c}`) END").alias("v")) for i, c in enumerate(features)])).alias("_s")
    found = ranked_values(train.select(values).select("_s.i", "_s.v"), ["i"], "v", lambda n: F.array(F.floor((n - 1) / 2).cast("long")))
    by = {r["i"]: r["value"] for r in found.collect()}  # a row per feature
    if empty := [c for i, c in enumerate(features) if i not in by]:
        raise ValueError(f"no value to take a median of: {empty}")
    return [by[i] for i in range(len(features))]


def _prepared(train: DataFrame, features: Sequence[str]) -> list:
    filled = [f"_f_{c}" for c in features]
    cases = ", ".join(f"CASE WHEN {_missing(c)} THEN double('{m!r}') ELSE double(`{c}`) END AS `{f}`" for c, f, m in zip(features, filled, medians(train, features), strict=True))
    return [
        SQLTransformer(statement=f"SELECT *, {cases} FROM __THIS__"),
        VectorAssembler(inputCols=filled, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
    ]


def balanced_weights(df: DataFrame, label: str, out: str = "_w") -> DataFrame:
    """Inverse class frequency weights n / (classes x n_class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    total = n.agg(F.sum("_rows").alias("_total"), F.count(F.lit(1)).alias("_classes"))
    return df.join(F.broadcast(n), label).crossJoin(F.broadcast(total)).withColumn(out, F.col("_total") / (F.col("_classes") * F.col("_rows"))).drop("_rows", "_total", "_classes")


class Constant:
    """The model of a single class: its share as the score of every row."""

    def __init__(self, p: float):
        self.p = p

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", F.lit(self.p))


class Scored:
    """A fitted pipeline whose ``transform`` adds ``score`` and leaves no work columns."""

    def __init__(self, model: PipelineModel | Stages, column: str, index: int | None):
        self.model, self.column, self.index = model, column, index

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        score = F.col(self.column) if self.index is None else vector_to_array(self.column)[self.index]
        return out.select(*df.columns, score.alias("score"))


def fit_binary(train: DataFrame, features: Sequence[str], label: str, balanced: bool = True, weight: str | None = None) -> Scored | Constant:
    """Median impute, standardise, (balanced) logistic regression; a single class gives the constant model."""
    n, p = train.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("int"))).first()
    if not n or p in (0, n):
        return Constant(float(p or 0) / max(n, 1))
    rows = train.withColumn("_y", F.col(label).cast("double"))
    rows = balanced_weights(rows, "_y") if balanced and not weight else rows.withColumn("_w", F.col(weight) if weight else F.lit(1.0))
    model = Pipeline(stages=[*_prepared(rows, features), LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / n, maxIter=200)]).fit(rows)
    return Scored(model, "probability", 1)


def fit_soft_binary(train: DataFrame, features: Sequence[str], target: str) -> Scored | Constant:
    """Logistic regression on fractional targets: each row counts as a positive of weight y and a negative of weight 1 - y."""
    both = train.select("*", F.explode(F.array(F.struct(F.lit(1).alias("l"), F.col(target).alias("w")), F.struct(F.lit(0).alias("l"), (1 - F.col(target)).alias("w")))).alias("_s"))
    rows = both.withColumns({"_label": F.col("_s.l"), "_weight": F.col("_s.w")}).where("_weight > 0").drop("_s")
    return fit_binary(rows, features, "_label", balanced=False, weight="_weight")


def fit_distribution(train: DataFrame, features: Sequence[str], masses: str, k: int) -> Scored:
    """Multinomial model on soft class masses (array): a weighted row per class with mass; ``score`` is the class array."""
    rows = train.select("*", F.posexplode(masses).alias("_y", "_m")).where("_m > 0").withColumn("_y", F.col("_y").cast("double"))
    model = Pipeline(stages=[*_prepared(rows, features), LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_m", family="multinomial", regParam=1e-3)]).fit(rows)

    class Distribution(Scored):
        def transform(self, df: DataFrame) -> DataFrame:
            p = vector_to_array(self.column)
            full = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.get(p, i), F.lit(0.0)))
            return self.model.transform(df).select(*df.columns, full.alias("score"))

    return Distribution(model, "probability", None)


def fit_ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> Scored:
    n = max(train.count(), 1)
    model = Pipeline(stages=[*_prepared(train, features), LinearRegression(featuresCol="_x", labelCol=target, regParam=alpha / n, elasticNetParam=0.0)]).fit(train)
    return Scored(model, "prediction", None)


def clipped(scored: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return scored.withColumn("score", F.greatest(F.lit(low), F.least(F.lit(high), F.col("score"))))


#: Candidates by name. Families that Spark lacks (extra trees, histogram boosting, partial least squares) are left out.
CLASSIFIERS: dict[str, Callable] = {
    "logistic": lambda: LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.01),
    "forest": lambda: RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=60, maxDepth=6, seed=42),
    "boosting": lambda: GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=20, maxDepth=3, subsamplingRate=0.8, seed=42),
    "bayes": lambda: NaiveBayes(featuresCol="_x", labelCol="_y", modelType="gaussian"),
}
REGRESSORS: dict[str, Callable] = {
    "mean": lambda: GeneralizedLinearRegression(featuresCol="_x", labelCol="_y", regParam=1e9),
    "ridge": lambda: LinearRegression(featuresCol="_x", labelCol="_y", regParam=0.1),
    "elastic": lambda: LinearRegression(featuresCol="_x", labelCol="_y", regParam=0.1, elasticNetParam=0.5),
    "huber": lambda: LinearRegression(featuresCol="_x", labelCol="_y", loss="huber", regParam=0.01),
    "forest": lambda: RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=60, maxDepth=6, seed=42),
    "boosting": lambda: BoostedTrees(rounds=20, depth=3, share=0.8, seed=42),
}


def bin_cuts(df: DataFrame, columns: Sequence[str], most: int = 32) -> list[list[float]]:
    """Rising cuts that part a column into ``most`` bins at most: between all its different values where they are that few, else at
    quantiles."""
    near = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    out = []
    for c in columns:
        few = sorted(r[0] for r in df.select(c).distinct().limit(most + 1).collect()) if near[c] <= 2 * most else []
        if 0 < len(few) <= most:
            out.append([(a + b) / 2 if a < (a + b) / 2 < math.inf else b for a, b in itertools.pairwise(few)] or few)
        else:
            out.append(value_cuts(df, c, most))
    return out


class BoostedTrees:
    """Least-squares boosting as ``GBTRegressor`` does it (step 0.1, 32 bins a feature, each tree from a random ``share`` of the
    rows). A tree sees a row's bins and target only, so rows of equal bins are summed once, for each tree those that its coins
    take; the trees then grow from the sums, with the number of rows as weight."""

    STEP = 0.1

    def __init__(self, rounds: int, depth: int, share: float, seed: int):
        self.rounds, self.depth, self.share, self.seed = rounds, depth, share, seed

    def fit(self, rows: DataFrame, columns: Sequence[str]) -> BoostedModel:
        """``rows`` have the ``columns`` (no null, no NaN) and the target ``_y``."""
        bins = [f"_b{i}" for i in range(len(columns))]
        splits = [[-math.inf, *(c for c in cuts if -math.inf < c < math.inf), math.inf] for cuts in bin_cuts(rows, columns)]
        splits = [s if len(s) > 2 else [-math.inf, 0.0, math.inf] for s in splits]
        model = BoostedModel(Bucketizer(inputCols=list(columns), outputCols=bins, splitsArray=splits), VectorAssembler(inputCols=bins, outputCol="_v"))
        every = range(self.rounds)
        drawn = model.binned(rows).select(*bins, "_y", *[(F.rand(self.seed + i) < self.share).alias(f"_c{i}") for i in every])
        sums = drawn.groupBy(*bins).agg(*[F.sum(F.when(F.col(f"_c{i}"), F.col("_y"))).alias(f"_s{i}") for i in every], *[F.sum(F.col(f"_c{i}").cast("double")).alias(f"_n{i}") for i in every])
        groups = stored(model.vectors.transform(sums).withColumn("_f", F.lit(0.0)), "boosting")
        taken = groups.agg(*[F.sum(f"_n{i}") for i in every]).first()
        for i in every:
            if not taken[i]:  # no row at all, of a few
                continue
            first = not model.trees
            own = groups.where(f"_n{i} > 0").select("_v", ((F.col(f"_s{i}") / F.col(f"_n{i}") - F.col("_f")) * (1 if first else 2)).alias("_r"), F.col(f"_n{i}").alias("_w"))
            tree = DecisionTreeRegressor(featuresCol="_v", labelCol="_r", weightCol="_w", maxDepth=self.depth, seed=self.seed + i, predictionCol="_t").fit(own)
            model.trees.append((tree, 1.0 if first else self.STEP))
            if i + 1 < self.rounds:
                groups = stored(tree.transform(groups).withColumn("_f", F.col("_f") + F.col("_t") * model.trees[-1][1]).drop("_t"), "boosting")
        return model


class BoostedModel:
    """Each different vector of bins is scored once, and rows look their score up."""

    def __init__(self, bins: Bucketizer, vectors: VectorAssembler):
        self.bins, self.vectors, self.trees = bins, vectors, []

    def binned(self, df: DataFrame) -> DataFrame:
        """Bins as plain numbers: ``Bucketizer`` marks them as categories, whose order trees ignore."""
        return self.bins.transform(df).withColumns({b: F.col(b) + F.lit(0.0) for b in self.bins.getOutputCols()})

    def transform(self, df: DataFrame) -> DataFrame:
        names, rows = self.bins.getOutputCols(), self.binned(df)
        scored = self.vectors.transform(rows.select(*names).distinct()).withColumn("prediction", F.lit(0.0))
        for tree, step in self.trees:
            scored = tree.transform(scored).withColumn("prediction", F.col("prediction") + F.col("_t") * step).drop("_t")
        return rows.join(stored(scored.drop("_v"), "boosted"), names)


class Stages:
    """Fitted stages one after the other, as a fitted pipeline has them."""

    def __init__(self, *stages):
        self.stages = stages

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.stages:
            df = s.transform(df)
        return df


def fit_regressor(name: str, train: DataFrame, features: Sequence[str], target: str, prepared: PipelineModel | None = None) -> Scored:
    """``prepared``: the preparing stages where they are fitted on ``train`` already."""
    rows = train.withColumn("_y", F.col(target).cast("double"))
    prepared = prepared or Pipeline(stages=_prepared(rows, features)).fit(rows)
    learner, ready = REGRESSORS[name](), prepared.transform(rows)
    model = learner.fit(ready, [f"_f_{c}" for c in features]) if isinstance(learner, BoostedTrees) else learner.fit(ready)
    return Scored(Stages(prepared, model), "prediction", None)


def fit_classifier(name: str, train: DataFrame, features: Sequence[str], label: str) -> Scored:
    rows = train.withColumn("_y", F.col(label).cast("double"))
    return Scored(Pipeline(stages=[*_prepared(rows, features), CLASSIFIERS[name]()]).fit(rows), "probability", 1)


def model_search(train: DataFrame, valid: DataFrame, features: Sequence[str], target: str, names: Sequence[str] | None = None) -> list[tuple]:
    """(rmse, mae, name) of every candidate on the valid rows, best first."""
    out = []
    prepared = Pipeline(stages=_prepared(train, features)).fit(train)
    for name in names or REGRESSORS:
        e = F.col(target) - F.col("score")
        r = fit_regressor(name, train, features, target, prepared).transform(valid).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")).first()
        out.append((r["rmse"], r["mae"], name))
    return sorted(out)


def ensemble_score(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str) -> DataFrame:
    """Mean of the logistic and the forest score."""
    a = fit_classifier("logistic", train, features, label).transform(test)
    b = fit_classifier("forest", train, features, label).transform(test).select(key, F.col("score").alias("_b"))
    return a.join(b, key).withColumn("score", (F.col("score") + F.col("_b")) / 2).drop("_b")


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, fold: str = "fold", k: int = 5) -> DataFrame:
    """Scores of expanding folds (rows of fold 0 only train); a fold whose training rows hold one class is skipped, features
    without any training value are left out of a fold."""
    parts = []
    for i in range(1, k + 1):
        train, test = df.where(F.col(fold) < i), df.where(F.col(fold) == i)
        row = train.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("int")).alias("_p"), *[F.count(c).alias(c) for c in features]).first()
        if row["_n"] and 0 < (row["_p"] or 0) < row["_n"]:
            parts.append(fit_binary(train, [c for c in features if row[c]], label).transform(test))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def isotonic(calibration: DataFrame, score: str, label: str, min_rows: int = 20):
    """Scores to calibrated probabilities in [0, 1]; the identity below ``min_rows`` rows or for a single class."""
    n, p = calibration.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("double"))).first()
    if n < min_rows or p in (0, n):
        return lambda df: df.withColumn("calibrated", F.col(score))
    prepared = VectorAssembler(inputCols=[score], outputCol="_s")
    model = Pipeline(stages=[prepared, IsotonicRegression(featuresCol="_s", labelCol="_y")]).fit(calibration.withColumn("_y", F.col(label).cast("double")))
    return lambda df: model.transform(df).select(*df.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias("calibrated"))


def platt(calibration: DataFrame, score: str, label: str):
    model = fit_binary(calibration.withColumn("_score_in", F.col(score)), ["_score_in"], label, balanced=False)
    return lambda df: model.transform(df.withColumn("_score_in", F.col(score))).withColumnRenamed("score", "calibrated").drop("_score_in")


def cluster_regimes(train: DataFrame, features: Sequence[str], k: int, components: int | None = None, seed: int = 42):
    """K-means over scaled context (optionally reduced by PCA); returns a function that adds ``regime``."""
    stages = _prepared(train, features)
    column = "_x"
    if components:
        stages.append(PCA(k=components, inputCol="_x", outputCol="_p"))
        column = "_p"
    model = Pipeline(stages=[*stages, KMeans(featuresCol=column, predictionCol="regime", k=k, seed=seed)]).fit(train)
    return lambda df: model.transform(df).select(*df.columns, "regime")


def per_group_scores(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, group: str, min_rows: int) -> DataFrame:
    """A model per group with enough rows and both classes, the global model elsewhere. The groups are few and named."""
    stats = train.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("p")).collect()
    good = [r[group] for r in stats if r["n"] >= min_rows and 0 < r["p"] < r["n"]]
    rest = ~F.col(group).isin(good) | F.col(group).isNull() if good else F.lit(True)
    out = fit_binary(train, features, label).transform(test.where(rest))
    for g in good:
        out = out.unionByName(fit_binary(train.where(F.col(group) == g), features, label).transform(test.where(F.col(group) == g)))
    return out


def importance(train: DataFrame, features: Sequence[str], label: str, top: int) -> list[tuple[str, float]]:
    """Features by random-forest importance."""
    rows = train.withColumn("_y", F.col(label).cast("double"))
    model = Pipeline(stages=[*_prepared(rows, features), RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=60, minInstancesPerNode=5, seed=42)]).fit(rows)
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:top]


def cumulative_models(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, cuts: Sequence[float]) -> DataFrame:
    """P(y < cut) per cut from one binary model each, made monotone: columns ``p0..``."""
    out = test
    for i, c in enumerate(cuts):
        scored = fit_binary(train.withColumn("_t", (F.col(target) < c).cast("int")), features, "_t").transform(out)
        out = scored.withColumnRenamed("score", f"p{i}")
    return out.withColumns({f"p{i}": F.greatest(F.lit(0.0), *[F.col(f"p{j}") for j in range(i + 1)]) for i in range(len(cuts))})


def flat_tree(tree, average: Callable) -> tuple:
    """A tree of ``(feature, cut, below, above)`` and leaf sizes as arrays: feature, cut, both next nodes, depth at the leaf. A leaf leads to
    itself."""
    import numpy as np

    feature, cut, after, depth = [], [], [], []

    def add(node, steps: int) -> int:
        at = len(feature)
        inner = isinstance(node, tuple)
        value = 0.0 if inner else float(average(node))
        for _ in range(0 if inner else steps):
            value = 1 + value
        feature.append(node[0] if inner else 0)
        cut.append(node[1] if inner else np.inf)
        after.append([at, at])
        depth.append(value)
        if inner:
            after[at] = [add(node[2], steps + 1), add(node[3], steps + 1)]
        return at

    add(tree, 0)
    return np.array(feature, np.int64), np.array(cut), np.array(after, np.int64).reshape(-1), np.array(depth)


def tree_depths(flat: tuple, x, levels: int):
    """The leaf depth of every row, all rows a level at a time."""
    import numpy as np

    feature, cut, after, depth = flat
    values, start = np.ascontiguousarray(x).reshape(-1), np.arange(len(x)) * x.shape[1]
    at = np.zeros(len(x), np.int64)
    for _ in range(levels):
        below = values[start + feature[at]] < cut[at]
        at = after[2 * at + ~below]
    return depth[at]


def isolation_scores(train: DataFrame, test: DataFrame, features: Sequence[str], key: str, trees: int = 64, sample: int = 256, seed: int = 42) -> DataFrame:
    """Isolation forest: each tree is grown from a bounded random sample (``sample`` rows, a parameter of the method) and the scores
    of the test rows are computed in Arrow batches, min-max scaled by the training sample's scores."""
    import numpy as np
    import pandas as pd

    rows = train.na.drop(subset=list(features)).orderBy(F.rand(seed)).limit(trees * sample).select(*features).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)

    def grow(x: np.ndarray, depth: int):
        if depth == 0 or len(x) <= 1:
            return len(x)
        f = int(rng.integers(x.shape[1]))
        low, high = x[:, f].min(), x[:, f].max()
        if low == high:
            return len(x)
        cut = float(rng.uniform(low, high))
        return f, cut, grow(x[x[:, f] < cut], depth - 1), grow(x[x[:, f] >= cut], depth - 1)

    size = min(sample, max(2, len(rows)))
    forest = [grow(rows[rng.choice(len(rows), size, replace=len(rows) < size)], int(np.ceil(np.log2(size)))) for _ in range(trees)]

    def average(n: int) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    levels = int(np.ceil(np.log2(size)))
    flat = [flat_tree(t, average) for t in forest]

    def raw(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in flat:
            total += tree_depths(t, x, levels)
        return 2 ** (-(total / len(flat)) / average(size))

    base = raw(rows)
    low, span = float(base.min()), float(max(base.max() - base.min(), 1e-12))

    def score(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "score": (raw(b[list(features)].to_numpy(float)) - low) / span})

    kept = test.na.drop(subset=list(features)).select(key, *features)
    return kept.mapInPandas(score, f"{key} {dict(test.dtypes)[key]}, score double")
