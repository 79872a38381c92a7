"""Regressors and classifiers on the feature table, with MLlib.

Fits take rows with a ``features`` vector and a ``label``; :func:`model_rows` makes them.  Every
forecast goes into the long predictions table, so nothing later needs the fitted object.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.operators import evaluate
from barline.operators.features import LABEL
from barline.operators.profile import Moments, Standardizer, moments_by
from barline.operators.split import sequences
from barline.plans.trials import ELASTIC_NET, LASSO_ALPHA, RIDGE_GRID, Trial

SEED = 42  # fixed value
TOLERANCE = 1e-10  # at which the sparse fits stop


def model_rows(df: DataFrame, columns: Sequence[str], label: str = LABEL) -> tuple[DataFrame, Standardizer]:
    """Keys, split, label and the scaled feature vector; scaling comes from the training rows."""
    scaler = Standardizer(columns).fit(df.where(F.col("split") == "train"))
    kept = [c for c in ("symbol", "date", "split", "fold") if c in df.columns]
    rows = scaler.features(df).select(*kept, F.col(label).alias("label"), "features")
    return rows, scaler


def part(rows: DataFrame, split: str) -> DataFrame:
    return rows.where(F.col("split") == split)


def predict(model, rows: DataFrame, name: str) -> DataFrame:
    """Forecasts of a fitted model in the layout of the predictions table."""
    return model.transform(rows).select(
        F.lit(name).alias("model"), "split", "symbol", "date",
        F.col("label").alias("y"), F.col("prediction").cast("double").alias("yhat"),
    )


def forecast_gap(first, other, rows: DataFrame) -> DataFrame:
    """``gap``: the largest difference between two stored models' forecasts of the same row, from one pass without a join."""
    both = other.transform(first.transform(rows.select("features"), {first.stages[-1].predictionCol: "_first"}))
    return both.agg(F.max(F.abs(F.col("_first") - F.col("prediction"))).alias("gap"))


# --- linear models ------------------------------------------------------------------------


def _label_scale(train: DataFrame) -> tuple[int, float]:
    found = train.agg(F.count("label").alias("n"), F.stddev_pop("label").alias("s")).first()
    return found["n"], found["s"] or 1.0


def fit_ridge(train: DataFrame, alpha: float):
    """Least squares with penalty ``alpha * |w|^2``; the penalty is restated in MLlib's units."""
    n, scale = _label_scale(train)
    return LinearRegression(
        elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha * scale / n
    ).fit(train)


def fit_lasso(train: DataFrame, alpha: float = LASSO_ALPHA, max_iter: int = 3000):
    """Mean squared error halved, plus ``alpha * |w|``."""
    return LinearRegression(elasticNetParam=1.0, standardization=False, regParam=alpha, maxIter=max_iter, tol=TOLERANCE).fit(train)


def fit_elastic_net(train: DataFrame, alpha: float = ELASTIC_NET[0], ratio: float = ELASTIC_NET[1], max_iter: int = 3000):
    """Penalty split between ``|w|`` and ``|w|^2``; only the second depends on the label's scale."""
    _, scale = _label_scale(train)
    first, second = alpha * ratio, alpha * (1 - ratio) * scale
    return LinearRegression(
        elasticNetParam=first / (first + second), standardization=False, regParam=first + second, maxIter=max_iter, tol=TOLERANCE
    ).fit(train)


def ridge_solution(found: Moments, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge coefficients and intercept from moments whose last column is the label."""
    covariance = found.corr * np.outer(found.std, found.std)
    covariance = np.nan_to_num(covariance)
    gram, target = covariance[:-1, :-1], covariance[:-1, -1]
    weights = np.linalg.solve(gram + np.eye(len(target)) * alpha / found.n, target)
    return weights, float(found.mean[-1] - weights @ found.mean[:-1])


def ridge_r2(found: Moments, weights: np.ndarray, intercept: float) -> float:
    """R2 of a linear forecast on rows known only by their moments."""
    covariance = np.nan_to_num(found.corr * np.outer(found.std, found.std))
    gram, target, total = covariance[:-1, :-1], covariance[:-1, -1], covariance[-1, -1]
    bias = found.mean[-1] - weights @ found.mean[:-1] - intercept
    return float(1 - (total - 2 * weights @ target + weights @ gram @ weights + bias**2) / total)


def merged(parts: Sequence[Moments]) -> Moments:
    """Moments of the union of disjoint row sets."""
    n = sum(p.n for p in parts)
    mean = sum(p.n * p.mean for p in parts) / n
    second = sum(
        p.n * (np.nan_to_num(p.corr) * np.outer(p.std, p.std) + np.outer(p.mean - mean, p.mean - mean)) for p in parts
    ) / n
    std = np.sqrt(np.diag(second))
    safe = np.where(std > 0, std, 1.0)
    corr = np.where(np.outer(std > 0, std > 0), second / np.outer(safe, safe), np.nan)
    return Moments(parts[0].columns, n, mean, std, corr)


def ridge_path(train: DataFrame, columns: Sequence[str], alphas: Sequence[float] = RIDGE_GRID, label: str = LABEL,
               folds: int = 3) -> tuple[float, dict[float, float], np.ndarray, float]:
    """Best alpha by cross-validated R2, the score of each alpha, and the refit on all rows.

    Each fold's rows are aggregated once to k*k moments; every alpha of every fold, and the final
    fit, is solved from those.  The first of equal scores wins.
    """
    names = [*columns, label]
    by_fold = moments_by(train, names, F.col("fold"))
    parts = [by_fold[i] for i in range(folds)]
    scores = {}
    for alpha in alphas:
        held_out = []
        for i in range(folds):
            weights, intercept = ridge_solution(merged(parts[:i] + parts[i + 1 :]), alpha)
            held_out.append(ridge_r2(parts[i], weights, intercept))
        scores[alpha] = float(np.mean(held_out))
    best = max(alphas, key=lambda a: scores[a])
    weights, intercept = ridge_solution(merged(parts), best)
    return best, scores, weights, intercept


def linear_forecast(columns: Sequence[str], weights: Sequence[float], intercept: float) -> Column:
    """A linear model as a plain column expression."""
    total = F.lit(float(intercept))
    for c, w in zip(columns, weights):
        total = total + F.col(c) * F.lit(float(w))
    return total


# --- trees --------------------------------------------------------------------------------


def fit_tree(train: DataFrame, depth: int = 5, leaf: int = 20, gain: float = 0.001):
    return DecisionTreeRegressor(maxDepth=depth, minInstancesPerNode=leaf, minInfoGain=gain, seed=SEED).fit(train)


def forest(trial: Trial) -> RandomForestRegressor:
    return RandomForestRegressor(
        numTrees=trial.trees, maxDepth=trial.depth, minInstancesPerNode=trial.leaf,
        featureSubsetStrategy=trial.columns, seed=SEED,
    )


def fit_forest(train: DataFrame, trial: Trial):
    return forest(trial).fit(train)


def fit_gbt(train: DataFrame, trees: int = 100, depth: int = 5, rate: float = 0.05):
    return GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, seed=SEED).fit(train)


def boosted_trees(trial: Trial) -> GBTRegressor:
    """Boosted trees with row and column sampling on binned features."""
    return GBTRegressor(
        maxIter=trial.trees, maxDepth=trial.depth, stepSize=trial.rate, subsamplingRate=trial.rows,
        featureSubsetStrategy=trial.columns, minInstancesPerNode=trial.leaf, seed=SEED,
    )


def fit_hist_gbt(train: DataFrame, trial: Trial):
    return boosted_trees(trial).fit(train)


def fit_early_stopping(rows: DataFrame, trees: int = 150, depth: int = 5, rate: float = 0.05, tolerance: float = 0.01):
    """Boosting that stops when the validation rows no longer improve."""
    marked = rows.where(F.col("split").isin("train", "val")).withColumn("is_val", F.col("split") == "val")
    return GBTRegressor(
        maxIter=trees, maxDepth=depth, stepSize=rate, validationIndicatorCol="is_val", validationTol=tolerance, seed=SEED
    ).fit(marked)


# --- search -------------------------------------------------------------------------------


def cut_tree(model: DecisionTreeRegressionModel, depth: int) -> DecisionTreeRegressionModel:
    """The fitted tree down to ``depth``: a node there is a leaf with its own mean.

    A single tree looks at all features of a node and at its rows alone, so it equals a fit with that depth.
    """
    ml = SparkContext._active_spark_context._jvm.org.apache.spark.ml

    def cut(node, left: int):
        if not left or not node.subtreeDepth():
            return ml.tree.LeafNode(node.prediction(), node.impurity(), node.impurityStats())
        below = cut(node.leftChild(), left - 1), cut(node.rightChild(), left - 1)
        return ml.tree.InternalNode(node.prediction(), node.impurity(), node.gain(), *below, node.split(), node.impurityStats())

    own = ml.regression.DecisionTreeRegressionModel(cut(model._java_obj.rootNode(), depth), model.numFeatures)
    return model._copyValues(DecisionTreeRegressionModel(own))


def _checked_folds(train: DataFrame, folds: int) -> None:
    found = {r["fold"] for r in train.select("fold").distinct().collect()}
    if found != set(range(folds)):
        raise ValueError(f"folds 0 to {folds - 1}, all with rows, are needed, not {sorted(found, key=str)}")


def _depth_search(estimator: DecisionTreeRegressor, depths: Sequence[int], train: DataFrame, folds: int) -> CrossValidatorModel:
    """:func:`grid_search` over the depth of a single tree: a fold is fitted once, the other depths are that tree cut."""
    _checked_folds(train, folds)
    scores = []
    for i in range(folds):
        deep = estimator.copy({estimator.maxDepth: max(depths)}).fit(train.where(F.col("fold") != i))
        held = train.where(F.col("fold") == i)
        for d in depths:
            held = cut_tree(deep, d).setPredictionCol(f"_depth{d}").transform(held)
        y = F.col(estimator.getLabelCol())
        # As RegressionEvaluator has it, for all depths in one pass.
        scores.append(held.agg(*[1 - F.sum((y - F.col(f"_depth{d}")) ** 2) / (F.var_pop(y) * F.count(y)) for d in depths]).first())
    mean, std = np.mean(scores, axis=0).tolist(), np.std(scores, axis=0).tolist()
    best = estimator.copy({estimator.maxDepth: depths[int(np.argmax(mean))]}).fit(train)
    return CrossValidatorModel(best, mean, None, std)


def grid_search(estimator, grid: dict, train: DataFrame, folds: int = 3, parallelism: int = 4) -> CrossValidatorModel:
    """Best parameters by mean R2 over contiguous folds; the first of equal scores wins.

    The depths of a single tree take one fit a fold: no fold is cached, and no fits run beside each other.
    """
    if isinstance(estimator, DecisionTreeRegressor) and list(grid) == ["maxDepth"]:
        return _depth_search(estimator, list(grid["maxDepth"]), train, folds)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    return CrossValidator(
        estimator=estimator, estimatorParamMaps=builder.build(), evaluator=RegressionEvaluator(metricName="r2"),
        numFolds=folds, foldCol="fold", parallelism=parallelism,
    ).fit(train)


def fold_score(estimator, train: DataFrame, folds: int = 3) -> float:
    """Mean held-out R2 of one configuration over contiguous folds, in place of an out-of-bag score.

    One fit per fold: a search would fit all rows once more, only to know the best of one. Every row needs a fold.
    """
    _checked_folds(train, folds)
    scorer = RegressionEvaluator(metricName="r2")
    scores = []
    for i in range(folds):
        model = estimator.fit(train.where(F.col("fold") != i))
        scores.append(scorer.evaluate(model.transform(train.where(F.col("fold") == i))))
    return float(np.mean(scores))


def sweep(trials: Sequence[Trial], rows: DataFrame, splits: Sequence[str] = ("val", "test"), parallelism: int = 4) -> DataFrame:
    """Fits every trial and returns their forecasts, one ``model`` per trial id.

    ``rows`` is read once per fit, so it should be materialised.
    """
    train, scored = part(rows, "train"), rows.where(F.col("split").isin(*splits))

    def run(trial: Trial) -> DataFrame:
        estimator = forest(trial) if trial.family == "RF" else boosted_trees(trial)
        return predict(estimator.fit(train), scored, trial.name).withColumn("trial_id", F.lit(trial.trial_id))

    with ThreadPoolExecutor(parallelism) as pool:
        found = list(pool.map(inheritable_thread_target(rows.sparkSession)(run), trials))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def trial_metrics(forecasts: DataFrame, split: str = "val") -> DataFrame:
    """Scores of a sweep on the split that decides, one row per trial."""
    scored = evaluate.regression_metrics(part(forecasts, split), by=["trial_id"])
    return scored.where(F.col("r2").isNotNull())


def fit_baselines(rows: DataFrame, ridge_alpha: float, splits: Sequence[str] = ("val", "test")) -> tuple[DataFrame, dict[str, float]]:
    """Forecasts of the simple models and the seconds each fit took."""
    train, scored = part(rows, "train"), rows.where(F.col("split").isin(*splits))
    fits = {
        "Ridge": lambda: fit_ridge(train, ridge_alpha),
        "Lasso": lambda: fit_lasso(train),
        "ElasticNet": lambda: fit_elastic_net(train),
        "DecisionTree": lambda: fit_tree(train),
        "GradientBoosting": lambda: fit_gbt(train),
    }
    out, seconds = None, {}
    for name, fit in fits.items():
        started = time.time()
        forecasts = predict(fit(), scored, name)
        seconds[name] = time.time() - started
        out = forecasts if out is None else out.unionByName(forecasts)
    return out, seconds


# --- sequences, surfaces, components -------------------------------------------------------


def sequence_rows(df: DataFrame, columns: Sequence[str], length: int = 20, label: str = LABEL) -> DataFrame:
    """Rows whose ``features`` are the scaled columns of the last ``length`` rows, side by side."""
    scaled = Standardizer(columns).fit(part(df, "train")).transform(df)
    rows = sequences(scaled, columns, length)
    return rows.select(
        "symbol", "date", "split", F.col(label).alias("label"), array_to_vector(F.flatten("sequence")).alias("features")
    )


def fit_sequence_linear(rows: DataFrame, alpha: float):
    """Ridge regression on sequence rows."""
    return fit_ridge(part(rows, "train"), alpha)


def response_surface(trials: DataFrame, x: str, y: str, z: str, points: int = 20) -> DataFrame:
    """Quadratic surface of ``z`` over ``x`` and ``y``, evaluated on a grid spanning both.

    Its six coefficients need points that determine them; otherwise the design is singular and an error says so.
    """
    places = np.array([(r[x], r[y]) for r in trials.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).distinct().collect()])
    design = np.column_stack([np.ones(len(places)), places, places**2, places[:, 0] * places[:, 1]]) if len(places) else np.zeros((0, 6))
    if np.linalg.matrix_rank(design) < 6:
        raise ValueError(f"{len(places)} distinct points do not determine a quadratic surface")
    assembler = VectorAssembler(inputCols=[x, y], outputCol="_xy")
    powers = PolynomialExpansion(degree=2, inputCol="_xy", outputCol="features")
    rows = trials.select(F.col(x).cast("double"), F.col(y).cast("double"), F.col(z).cast("double").alias("label"))
    model = LinearRegression(solver="normal", regParam=0.0).fit(powers.transform(assembler.transform(rows)))
    span = rows.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()

    def at(index: Column, low: float, high: float) -> Column:
        return F.lit(low) + index * F.lit((high - low) / (points - 1))

    cells = trials.sparkSession.range(points * points).select(
        at(F.floor(F.col("id") / points), span[0], span[1]).alias(x), at(F.col("id") % points, span[2], span[3]).alias(y)
    )
    grid = powers.transform(assembler.transform(cells))
    return model.transform(grid).select(x, y, F.col("prediction").alias(z))


def fit_pca(rows: DataFrame, k: int):
    """Principal components of the scaled features."""
    return PCA(k=k, inputCol="features", outputCol="components").fit(rows)


def pca_report(model, columns: Sequence[str], spark) -> DataFrame:
    """Explained variance, its running sum and the loading of each feature, per component."""
    loadings, shares = model.pc.toArray(), model.explainedVariance.toArray()
    upto = np.cumsum(shares)
    rows = [
        (j + 1, float(shares[j]), float(upto[j]), c, float(loadings[i, j]))
        for j in range(len(shares))
        for i, c in enumerate(columns)
    ]
    return spark.createDataFrame(rows, "component int, share double, running double, feature string, loading double")


def pca_scores(model, rows: DataFrame) -> DataFrame:
    """Coordinates of each row, one column per component."""
    scored = model.transform(rows).withColumn("_c", vector_to_array("components"))
    return scored.select("symbol", "date", *[F.col("_c")[j].alias(f"pc{j + 1}") for j in range(model.getK())])


def feature_importance(model, columns: Sequence[str], spark) -> DataFrame:
    """Importance of each feature in a fitted forest, with its share and place."""
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    table = spark.createDataFrame(rows, "feature string, importance double")
    order = Window.orderBy(F.col("importance").desc(), "feature")
    total = F.sum("importance").over(Window.partitionBy())
    return table.withColumns(
        {"share": F.col("importance") * 100 / total, "place": F.row_number().over(order)}
    )


# --- direction ----------------------------------------------------------------------------


def fit_direction(rows: DataFrame) -> dict:
    """Up/down classifiers on the training rows."""
    train = part(rows, "train").withColumn("label", evaluate.direction(F.col("label")).cast("double"))
    return {
        "Logistic": LogisticRegression().fit(train),
        "Forest": RandomForestClassifier(numTrees=50, maxDepth=5, seed=SEED).fit(train),
        "Boosted": GBTClassifier(maxIter=20, maxDepth=3, seed=SEED).fit(train),
    }


def predict_direction(models: dict, rows: DataFrame) -> DataFrame:
    """Class forecasts of all classifiers; ``y`` keeps the return, ``yhat`` is the class."""
    out = None
    for name, model in models.items():
        forecasts = predict(model, rows, name)
        out = forecasts if out is None else out.unionByName(forecasts)
    return out


def vote(forecasts: DataFrame) -> DataFrame:
    """Majority of the class forecasts per row."""
    return forecasts.groupBy("split", "symbol", "date").agg(
        F.first("y").alias("y"), (F.avg("yhat") > 0.5).cast("double").alias("yhat")
    ).select(F.lit("Vote").alias("model"), "split", "symbol", "date", "y", "yhat")
