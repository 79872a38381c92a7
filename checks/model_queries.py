"""Model fits.  Most have no SQL; ``tests/test_models.py`` checks them against closed forms."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from barline.operators import choose, ensemble, evaluate, features, fill, lagged, models, select, split, staged
from barline.operators.profile import Standardizer, moments
from barline.plans import trials
from barline.session import materialise, shared_folder
from barline.sources import sinks
from checks import panels as p
from checks.feature_queries import SUPPLIER, date_split_sql
from checks.registry import fixed_sql, query, shaped, shaped_sql

LABEL = features.LABEL
KEYS = ("model", "split")
SCORES = {"r2": 4, "rmse": 4, "mae": 4}


def lean(spark, sf):
    """The lean feature set without the columns no model reads, split at common dates, with folds on the training rows."""
    # Written before the split: the counts per date and the calendar of the training rows would each make the table again.
    # Columns that follow from the date or equal another one are not written.
    table = features.lean_feature_table(p.stored_indicators(spark, sf)).drop(*features.LEAN_DROPPED)
    table = features.with_lean_derived(materialise(table.drop(*features.LEAN_DERIVED))).select(*table.columns)
    df = split.chrono_split(table, mode="date")
    # The folds cut the calendar of the training rows: one row per date, written so that no plan makes it again.
    folds = materialise(split.time_folds(df.where(F.col("split") == "train").select("date").distinct(), 3, mode="date"))
    return df.join(F.broadcast(folds), "date", "left")


def model_rows(spark, sf):
    """Model rows that many fits read: the lean table is written, scaling its rows again costs less than a second copy of them."""

    def make():
        df = lean(spark, sf)
        columns = features.feature_columns(df, features.LEAN_DROPPED)
        rows, scaler = models.model_rows(df, columns)
        return rows, columns, df, scaler

    return p.once(spark, sf, "rows", make)


def sweep_metrics(spark, sf, name):
    """Validation scores of every trial of a list."""

    def make():
        rows, *_ = model_rows(spark, sf)
        return materialise(models.trial_metrics(models.sweep(getattr(trials, name), rows)))

    return p.once(spark, sf, name, make)


def scored(forecasts):
    return shaped(evaluate.regression_metrics(forecasts), KEYS, SCORES, ("n",))


def test_rows(rows):
    return rows.where(F.col("split") != "train")


# --- ridge with two features has a closed form SQL can state --------------------------------

TWO = ("r", "v")
ALPHA = 500.0
TWO_SQL = (
    SUPPLIER,
    p.added("a", "bars", {**p.LABEL_SQL, "r": p.RETURN_SQL["return"], "v": p.RETURN_SQL["volume_change"]}),
    f"known AS (SELECT symbol, date, {LABEL} AS y, r, v FROM a WHERE {LABEL} IS NOT NULL AND r IS NOT NULL AND v IS NOT NULL)",
    date_split_sql("known"),
    """m AS (SELECT count(*) AS n, avg(r) AS mr, avg(v) AS mv, avg(y) AS my, stddev_pop(r) AS sr, stddev_pop(v) AS sv,
  covar_pop(r, v) / (stddev_pop(r) * stddev_pop(v)) AS rv, covar_pop(r, y) / stddev_pop(r) AS ry,
  covar_pop(v, y) / stddev_pop(v) AS vy FROM parted WHERE split = 'train')""",
    f"""coef AS (SELECT *, (ry * (1 + {ALPHA} / n) - rv * vy) / ((1 + {ALPHA} / n) * (1 + {ALPHA} / n) - rv * rv) AS br,
  (vy * (1 + {ALPHA} / n) - rv * ry) / ((1 + {ALPHA} / n) * (1 + {ALPHA} / n) - rv * rv) AS bv FROM m)""",
)


def two_features(spark, sf):
    df = features.forward_return(features.returns(p.bars(spark, sf)))
    df = df.select("symbol", "date", LABEL, F.col("return").alias("r"), F.col("volume_change").alias("v"))
    # Written once: the split and every fit and forecast behind it read these five columns.
    return split.chrono_split(materialise(fill.drop_warmup(df)), mode="date")


@query(
    p.with_sql(*TWO_SQL, """x AS (SELECT 'Ridge' AS model, split, symbol, date, y,
  my + br * (r - mr) / sr + bv * (v - mv) / sv AS yhat FROM parted CROSS JOIN coef)""")
    + shaped_sql("x", ("model", "split", "symbol", "date"), {"y": 5, "yhat": 5})
)
def ridge_forecasts(spark, sf):
    rows, _ = models.model_rows(two_features(spark, sf), TWO)
    model = models.fit_ridge(models.part(rows, "train"), ALPHA)
    return shaped(models.predict(model, rows, "Ridge"), ("model", "split", "symbol", "date"), {"y": 5, "yhat": 5})


ATTRIBUTION_SQL = """parts AS (SELECT symbol, date, 'r' AS feature, br * (r - mr) / sr AS attribution, place
  FROM tst CROSS JOIN coef UNION ALL SELECT symbol, date, 'v', bv * (v - mv) / sv, place FROM tst CROSS JOIN coef)"""
TEST_SQL = "tst AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS place FROM parted WHERE split = 'test')"


def attributions(spark, sf, n=None):
    df = two_features(spark, sf)
    train = df.where(F.col("split") == "train")
    scaler = Standardizer(TWO).fit(train)
    found = moments(scaler.transform(train), [*TWO, LABEL])
    weights, _ = models.ridge_solution(found, ALPHA)
    rows = scaler.transform(df.where(F.col("split") == "test"))
    return evaluate.linear_attribution(rows, dict(zip(TWO, weights)), dict.fromkeys(TWO, 0.0), n=n)


@query(p.with_sql(*TWO_SQL, TEST_SQL, ATTRIBUTION_SQL)
       + shaped_sql("parts", ("symbol", "date", "feature"), {"attribution": 5}) + " WHERE place <= 200")
def linear_attributions(spark, sf):
    """The first 200 test rows of every series, as the report shows them."""
    return shaped(attributions(spark, sf, 200), ("symbol", "date", "feature"), {"attribution": 5})


@query(
    p.with_sql(*TWO_SQL, TEST_SQL, ATTRIBUTION_SQL, """x AS (SELECT feature, avg(abs(attribution)) AS mean_abs,
  row_number() OVER (ORDER BY avg(abs(attribution)) DESC, feature) AS place FROM parts GROUP BY 1)""")
    + shaped_sql("x", ("feature",), {"mean_abs": 5}, ("place",)) + " WHERE place <= 10"
)
def attribution_ranking(spark, sf):
    return shaped(evaluate.attribution_rank(attributions(spark, sf)), ("feature",), {"mean_abs": 5}, ("place",))


# --- other linear models ------------------------------------------------------------------


@query()
def ridge_alpha_search(spark, sf):
    """Cross-validated score of every alpha, from one aggregation per fold."""
    df = lean(spark, sf)
    columns = features.feature_columns(df, features.LEAN_DROPPED)
    train = df.where(F.col("split") == "train")
    scaled = Standardizer(columns).fit(train).transform(train)
    alphas = (*trials.RIDGE_GRID, *map(float, trials.RIDGE_ROUND_2), *map(float, trials.RIDGE_ROUND_3))
    best, scores, _, _ = models.ridge_path(scaled, columns, alphas)
    rows = [(f"Ridge_{a:g}", a, s, a == best) for a, s in scores.items()]
    return spark.createDataFrame(rows, "model string, alpha double, r2 double, best boolean")


@query()
def lasso_forecast_scores(spark, sf):
    rows, *_ = model_rows(spark, sf)
    return scored(models.predict(models.fit_lasso(models.part(rows, "train")), test_rows(rows), "Lasso"))


@query()
def elastic_net_forecast_scores(spark, sf):
    rows, *_ = model_rows(spark, sf)
    train = models.part(rows, "train")
    wide = models.predict(models.fit_elastic_net(train, *trials.ELASTIC_NET), test_rows(rows), "ElasticNet")
    narrow = models.predict(models.fit_elastic_net(train, *trials.ELASTIC_NET_LEAN), test_rows(rows), "ElasticNetLean")
    return scored(wide.unionByName(narrow))


@query()
def attribution_after_refit(spark, sf):
    """The ridge model refitted on the small feature set with the same alpha, then attributed."""
    df = lean(spark, sf)
    small = ["return_lag5", "return_mean_10", "return_std_10", "close_to_sma50", "price_momentum_5"]
    train = df.where(F.col("split") == "train")
    scaler = Standardizer(small).fit(train)
    found = moments(scaler.transform(train), [*small, LABEL])
    weights, _ = models.ridge_solution(found, ALPHA)
    rows = scaler.transform(df.where(F.col("split") == "test"))
    parts = evaluate.linear_attribution(rows, dict(zip(small, weights)), dict.fromkeys(small, 0.0))
    return evaluate.attribution_rank(parts)


# --- trees --------------------------------------------------------------------------------


@query()
def tree_forecast_scores(spark, sf):
    rows, *_ = model_rows(spark, sf)
    return scored(models.predict(models.fit_tree(models.part(rows, "train")), test_rows(rows), "DecisionTree"))


def best_of(spark, sf, name):
    """Every trial of a list fitted, kept above the floor, best three."""
    kept = choose.metric_floor(sweep_metrics(spark, sf, name), choose.SWEEP_FLOORS)
    return choose.top_per_family(kept.drop("family"), 3)


@query()
def forest_sweep(spark, sf):
    return best_of(spark, sf, "RF_TRIALS")


@query()
def forest_sweep_round_2(spark, sf):
    return best_of(spark, sf, "RF_ROUND_2")


@query()
def boosted_sweep(spark, sf):
    """Light boosted trials with row and column sampling."""
    return best_of(spark, sf, "LGB_TRIALS")


@query()
def deep_boosted_sweep(spark, sf):
    return best_of(spark, sf, "XGB_TRIALS")


@query()
def deep_boosted_sweep_round_2(spark, sf):
    return best_of(spark, sf, "XGB_ROUND_2")


@query()
def early_stopped_boosting(spark, sf):
    rows, *_ = model_rows(spark, sf)
    model = models.fit_early_stopping(rows)
    return scored(models.predict(model, test_rows(rows), "GradientBoosting"))


@query()
def boosting_stages(spark, sf):
    """Validation loss of every boosted tree; those up to the best within patience are kept."""
    rows, *_ = model_rows(spark, sf)
    return spark.createDataFrame(staged.stages(staged.fit_patience(rows, most=80)), "tree int, loss double, kept boolean")


@query()
def boosting_with_patience(spark, sf):
    rows, *_ = model_rows(spark, sf)
    return scored(models.predict(staged.fit_patience(rows, most=80), test_rows(rows), "GradientBoosting"))


@query()
def forest_out_of_bag(spark, sf):
    """Score of the rows each tree left out, beside the score over contiguous folds."""
    rows, *_ = model_rows(spark, sf)
    train, trial = models.part(rows, "train"), trials.RF_TRIALS[3]
    found = staged.out_of_bag_scores(staged.fit_bagged(train, trial), train, trial.name)
    return found.withColumn("fold_r2", F.lit(float(models.fold_score(models.forest(trial), train))))


# A tree of one split on whole numbers: SQL can try every cut.
PARTS = ("day", "month")
STUMP_SQL = (
    *TWO_SQL[:3], date_split_sql("known"),
    "num AS (SELECT *, CAST(isodow(date) - 1 AS DOUBLE) AS day, CAST(month(date) AS DOUBLE) AS month FROM parted)",
    "fitted AS (SELECT 'day' AS feature, day AS v, y FROM num WHERE split = 'train' UNION ALL SELECT 'month', month, y FROM num WHERE split = 'train')",
    "cells AS (SELECT feature, v, sum(y) AS s, count(*) AS n FROM fitted GROUP BY 1, 2)",
    """cuts AS (SELECT feature, v, sum(s) OVER up AS ls, sum(n) OVER up AS ln, sum(s) OVER (PARTITION BY feature) AS ts,
  sum(n) OVER (PARTITION BY feature) AS tn FROM cells WINDOW up AS (PARTITION BY feature ORDER BY v))""",
    """cut AS (SELECT *, ls / ln AS low, (ts - ls) / (tn - ln) AS high FROM cuts WHERE ln >= 20 AND tn - ln >= 20
  ORDER BY ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) DESC LIMIT 1)""",
)


@query(
    p.with_sql(*STUMP_SQL, """x AS (SELECT 'Stump' AS model, split, symbol, date, y,
  CASE WHEN (CASE feature WHEN 'day' THEN day ELSE month END) <= cut.v THEN low ELSE high END AS yhat FROM num CROSS JOIN cut)""")
    + shaped_sql("x", ("model", "split", "symbol", "date"), {"y": 5, "yhat": 5})
)
def stump_forecasts(spark, sf):
    """A tree of one split; the best of all cuts and the means on both sides."""
    df = two_features(spark, sf).withColumns({"day": F.weekday("date").cast("double"), "month": F.month("date").cast("double"), "label": F.col(LABEL)})
    rows = VectorAssembler(inputCols=list(PARTS), outputCol="features").transform(df)
    model = models.fit_tree(models.part(rows, "train"), depth=1, gain=0.0)
    return shaped(models.predict(model, rows, "Stump"), ("model", "split", "symbol", "date"), {"y": 5, "yhat": 5})


DEPTHS = [3, 4, 5, 6, 7]


@query()
def tree_grid_search(spark, sf):
    """Depth of a tree by contiguous folds."""
    rows, *_ = model_rows(spark, sf)
    found = models.grid_search(
        DecisionTreeRegressor(minInstancesPerNode=20, seed=models.SEED), {"maxDepth": DEPTHS}, models.part(rows, "train")
    )
    return spark.createDataFrame([(d, float(m)) for d, m in zip(DEPTHS, found.avgMetrics)], "depth int, r2 double")


@query()
def forest_fold_score(spark, sf):
    rows, *_ = model_rows(spark, sf)
    trial = trials.RF_TRIALS[0]
    score = models.fold_score(models.forest(trial), models.part(rows, "train"))
    return spark.createDataFrame([(trial.name, float(score))], "model string, r2 double")


@query()
def baseline_forecast_scores(spark, sf):
    rows, *_ = model_rows(spark, sf)
    forecasts, seconds = models.fit_baselines(rows, 100.0)
    times = spark.createDataFrame(list(seconds.items()), "model string, time double")
    return evaluate.regression_metrics(forecasts).join(F.broadcast(times), "model")


@query()
def forest_importances(spark, sf):
    rows, columns, *_ = model_rows(spark, sf)
    return models.feature_importance(models.fit_forest(models.part(rows, "train"), trials.RF_TRIALS[0]), columns, spark)


# --- sequences, surfaces, components, direction ---------------------------------------------


@query()
def sequence_ridge_scores(spark, sf):
    df = lean(spark, sf)
    columns = features.feature_columns(df, features.LEAN_DROPPED)
    rows = materialise(models.sequence_rows(df, columns, 20))
    return scored(models.predict(models.fit_sequence_linear(rows, 100.0), test_rows(rows), "SequenceRidge"))


PAIR_SQL = (
    *TWO_SQL[:5],
    "scaled AS (SELECT symbol, date, split, y, (r - mr) / sr AS z FROM parted CROSS JOIN (SELECT mr, sr FROM m))",
    "pairs AS (SELECT *, lag(z) OVER (PARTITION BY symbol, split ORDER BY date) AS b FROM scaled)",
    f"""s AS (SELECT avg(b) AS mb, avg(z) AS mz, avg(y) AS my, var_pop(b) + {ALPHA} / count(*) AS bb, var_pop(z) + {ALPHA} / count(*) AS zz,
  covar_pop(b, z) AS bz, covar_pop(b, y) AS sb, covar_pop(z, y) AS sz FROM pairs WHERE split = 'train' AND b IS NOT NULL)""",
    """x AS (SELECT 'Pair' AS model, split, symbol, date, y, my + (sb * zz - bz * sz) / (bb * zz - bz * bz) * (b - mb)
  + (sz * bb - bz * sb) / (bb * zz - bz * bz) * (z - mz) AS yhat FROM pairs CROSS JOIN s WHERE b IS NOT NULL)""",
)


@query(p.with_sql(*PAIR_SQL) + shaped_sql("x", ("model", "split", "symbol", "date"), {"y": 5, "yhat": 5}))
def lagged_ridge_forecasts(spark, sf):
    """Ridge regression on sequences of two rows, from lagged products."""
    df = two_features(spark, sf)
    scaled = materialise(Standardizer(["r"]).fit(models.part(df, "train")).transform(df))
    found = lagged.sequence_moments(models.part(scaled, "train"), ["r"], 2)
    out = lagged.sequence_forecasts(scaled, ["r"], *lagged.sequence_ridge(found, ALPHA), "Pair")
    return shaped(out, ("model", "split", "symbol", "date"), {"y": 5, "yhat": 5})


@query()
def lagged_ridge_scores(spark, sf):
    """Test scores of the ridge regression on sequences of 20 rows of the lean features, without writing the sequences."""
    df = lean(spark, sf)
    columns = features.feature_columns(df, features.LEAN_DROPPED)
    scaled = Standardizer(columns).fit(models.part(df, "train")).transform(df)  # in the order of the lean table
    found = lagged.sequence_moments(models.part(scaled, "train"), columns, 20, in_order=True)
    return scored(lagged.sequence_forecasts(test_rows(scaled), columns, *lagged.sequence_ridge(found, 100.0), "LaggedRidge", in_order=True))


@query()
def response_surface(spark, sf):
    """Validation R2 of the light boosted trials over their two sizes, trees and smallest leaf."""
    sizes = spark.createDataFrame([(t.trial_id, t.trees, t.leaf) for t in trials.LGB_TRIALS], "trial_id int, trees int, leaf int")
    scores = sweep_metrics(spark, sf, "LGB_TRIALS").where("r2 > -0.5").join(F.broadcast(sizes), "trial_id")
    return models.response_surface(materialise(scores.select("trees", "leaf", "r2")), "trees", "leaf", "r2")


@query()
def principal_components(spark, sf):
    rows, columns, *_ = model_rows(spark, sf)
    return models.pca_report(models.fit_pca(models.part(rows, "train"), 5), columns, spark)


@query()
def principal_component_scores(spark, sf):
    rows, *_ = model_rows(spark, sf)
    return models.pca_scores(models.fit_pca(models.part(rows, "train"), 2), rows)


@query()
def direction_votes(spark, sf):
    rows, *_ = model_rows(spark, sf)
    forecasts = models.predict_direction(models.fit_direction(rows), models.part(rows, "test"))
    both = forecasts.unionByName(models.vote(forecasts))
    return evaluate.class_metrics(evaluate.confusion(both))


@query()
def blended_model_scores(spark, sf):
    """Fitted models, chosen on validation rows, blended and stacked, scored on test rows."""
    rows, *_ = model_rows(spark, sf)
    train = models.part(rows, "train")
    out = test_rows(rows)
    forest = trials.RF_TRIALS[2]
    forecasts = models.predict(models.fit_ridge(train, 500.0), out, "Ridge_500").unionByName(
        models.predict(models.fit_forest(train, forest), out, forest.name)
    )
    forecasts = materialise(forecasts)
    chosen = evaluate.regression_metrics(forecasts).where(F.col("split") == "val")
    weights = ensemble.power_weights(ensemble.ensemble_sizes(choose.pick_heterogeneous(chosen)))
    stack = ensemble.stack_fit(forecasts, ["Ridge_500", forest.name])
    stacked = ensemble.stack_apply(forecasts, ["Ridge_500", forest.name], stack, "Ensemble_R2³_2模型")
    return scored(forecasts.unionByName(ensemble.blend(forecasts, weights)).unionByName(stacked))


# --- statements that hold for any data, recomputed from it: every row has to say 1 ----------------


def holds(spark, **facts):
    """One row per fact: 1 where it holds."""
    return spark.createDataFrame([(name, int(bool(value))) for name, value in facts.items()], "fact string, holds bigint")


def all_hold(*names):
    return "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST(1 AS BIGINT))" for n in names) + ") t(fact, holds)"


@query(all_hold("best_is_largest", "equal_to_refit", "falls_behind_best"))
def ridge_search_facts(spark, sf):
    """The chosen alpha has the best held-out score, recomputed by fits on the folds themselves."""
    df = materialise(two_features(spark, sf))
    train = materialise(split.time_folds(df.where(F.col("split") == "train"), 3, mode="date"))
    scaled = materialise(Standardizer(TWO).fit(train).transform(train))
    alphas = (1.0, 500.0, 50000.0)
    best, scores, *_ = models.ridge_path(scaled, TWO, alphas)
    again = {}
    for alpha in alphas:
        r2 = []
        for fold in range(3):
            weights, intercept = models.ridge_solution(moments(scaled.where(F.col("fold") != fold), [*TWO, LABEL]), alpha)
            held = scaled.where(F.col("fold") == fold).withColumn("e", F.col(LABEL) - models.linear_forecast(TWO, weights, intercept))
            r2.append(held.agg(1 - F.sum(F.col("e") ** 2) / (F.var_pop(LABEL) * F.count(LABEL))).first()[0])
        again[alpha] = sum(r2) / 3
    return holds(
        spark, best_is_largest=scores[best] == max(scores.values()), equal_to_refit=all(abs(scores[a] - again[a]) < 1e-8 for a in alphas),
        falls_behind_best=all(again[a] <= again[best] + 1e-12 for a in alphas),
    )


@query(all_hold("lasso_conditions", "elastic_net_conditions"))
def sparse_model_facts(spark, sf):
    """Conditions of the optimum: the gradient equals the penalty's slope, or stays within it at zero."""
    rows, *_ = model_rows(spark, sf)
    train = models.part(rows, "train")
    k = len(train.first()["features"])
    wide = train.select("label", *[vector_to_array("features")[i].alias(f"f{i}") for i in range(k)])  # read once
    found = moments(wide, [*[f"f{i}" for i in range(k)], "label"])
    covariance = np.nan_to_num(found.corr) * np.outer(found.std, found.std)

    def optimal(weights, first, second):
        slope = covariance[:-1, -1] - covariance[:-1, :-1] @ weights - second * weights
        near = 1e-5 * found.std[-1]
        return all(abs(s - first * np.sign(w)) < near if w else abs(s) <= first + near for s, w in zip(slope, weights))

    lasso = models.fit_lasso(train).coefficients.toArray()
    alpha, ratio = trials.ELASTIC_NET
    net = models.fit_elastic_net(train, alpha, ratio).coefficients.toArray()
    return holds(spark, lasso_conditions=optimal(lasso, trials.LASSO_ALPHA, 0.0), elastic_net_conditions=optimal(net, alpha * ratio, alpha * (1 - ratio)))


@query(all_hold("shares_fall", "shares_sum_to_one", "loadings_orthonormal"))
def component_facts(spark, sf):
    rows, columns, *_ = model_rows(spark, sf)
    model = models.fit_pca(models.part(rows, "train"), len(columns))
    shares, loadings = model.explainedVariance.toArray(), model.pc.toArray()
    return holds(
        spark, shares_fall=(np.diff(shares) <= 1e-12).all(), shares_sum_to_one=abs(shares.sum() - 1) < 1e-6,
        loadings_orthonormal=np.allclose(loadings.T @ loadings, np.eye(len(columns)), atol=1e-6),
    )


@query(all_hold("factors_of_three", "steps_never_rise", "no_factor_above_the_limit"))
def selection_facts(spark, sf):
    """The cascade on the feature table; inflation factors against regressions on the other columns."""
    df = materialise(split.chrono_split(fill.drop_warmup(features.forward_return(features.returns(p.bars(spark, sf)))), mode="date"))
    train = df.where(F.col("split") == "train")
    three = ["return", "volume_change", "log_return"]
    rows = materialise(train.select(*[F.col(c).alias(c) for c in three]).withColumn("log_return", F.col("log_return") + F.col("volume_change") / 50))
    found = moments(rows, three)
    factors = {r["feature"]: r["vif"] for r in select.vif_table(rows, three).collect()}
    by_hand = np.diag(np.linalg.inv(found.corr))
    chosen = select.select_features(train, features.feature_columns(train), min_keep=2)
    sizes = [len(kept) for _, kept in chosen.steps[:5]]
    left = dict(chosen.steps)["inflation"]
    last = np.diag(np.linalg.pinv(moments(train, left).corr)) if len(left) > 1 else np.ones(1)
    return holds(
        spark, factors_of_three=all(abs(factors[c] / v - 1) < 1e-6 for c, v in zip(three, by_hand)),
        steps_never_rise=all(a >= b for a, b in zip(sizes, sizes[1:])) and len(chosen.sequence) <= len(chosen.tabular) <= sizes[-1],
        no_factor_above_the_limit=len(left) <= 2 or (last <= select.VIF_LIMIT + 1e-6).all(),
    )


@query(all_hold("no_test_date_in_training", "weights_sum_to_one", "steps_never_rise", "blend_scored", "selected_columns_fitted"))
def panel_pipeline(spark, sf):
    """The whole path: features, warm-up, split by date, selection, fits on the selected set, blend, score."""
    # Written before rows with gaps go: a condition on all of 156 derived columns would be planned for minutes.
    table = materialise(features.feature_table(p.indicators(spark, sf)))
    table = materialise(split.chrono_split(fill.drop_warmup(table), mode="date"))
    train = table.where(F.col("split") == "train")
    chosen = select.select_features(train, features.feature_columns(table))
    rows, _ = models.model_rows(table, chosen.tabular)
    rows = materialise(rows)
    fitted = models.part(rows, "train")
    forest = trials.RF_TRIALS[2]
    forecasts = materialise(
        models.predict(models.fit_ridge(fitted, 500.0), test_rows(rows), "Ridge_500").unionByName(
            models.predict(models.fit_forest(fitted, forest), test_rows(rows), forest.name)
        )
    )
    picks = choose.pick_heterogeneous(evaluate.regression_metrics(evaluate.common_rows(forecasts)).where(F.col("split") == "val"))
    weights = materialise(ensemble.power_weights(ensemble.ensemble_sizes(picks)))
    blended = evaluate.regression_metrics(ensemble.blend(forecasts.where(F.col("split") == "test"), weights))
    dates = {r["split"]: (r["a"], r["b"]) for r in table.groupBy("split").agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()}
    sums = [r["s"] for r in weights.groupBy("ensemble").agg(F.sum("weight").alias("s")).collect()]
    sizes = [len(kept) for _, kept in chosen.steps[:5]]
    return holds(
        spark, no_test_date_in_training=dates["train"][1] < dates["val"][0] and dates["val"][1] < dates["test"][0],
        weights_sum_to_one=bool(sums) and all(abs(s - 1) < 1e-9 for s in sums), steps_never_rise=all(a >= b for a, b in zip(sizes, sizes[1:])),
        blend_scored=blended.where("r2 is not null").count() == len(sums), selected_columns_fitted=len(fitted.first()["features"]) == len(chosen.tabular),
    )


@query(all_hold("same_forecasts", "other_parameters_refitted"))
def stored_model_facts(spark, sf):
    """A stored model forecasts what the fitted one does; other parameters are never mistaken for it."""
    rows, _ = models.model_rows(two_features(spark, sf), TWO)
    train, path = materialise(models.part(rows, "train")), shared_folder(spark, "models")
    first, again = (sinks.fit_or_load(LinearRegression(regParam=0.1), train, path) for _ in range(2))
    other = sinks.fit_or_load(LinearRegression(regParam=0.2), train, path)
    test = models.part(rows, "test")
    apart = lambda m: models.forecast_gap(first, m, test).first()["gap"]
    return holds(spark, same_forecasts=apart(again) == 0, other_parameters_refitted=apart(other) > 0)


@query(all_hold("importances_sum_to_one", "votes_follow_the_majority"))
def tree_facts(spark, sf):
    rows, columns, *_ = model_rows(spark, sf)
    shares = models.feature_importance(models.fit_forest(models.part(rows, "train"), trials.RF_TRIALS[2]), columns, spark)
    classes = materialise(models.predict_direction(models.fit_direction(rows), models.part(rows, "test")))
    votes = models.vote(classes).select("split", "symbol", "date", F.col("yhat").alias("vote"))
    wide = classes.groupBy("split", "symbol", "date").agg(F.sum("yhat").alias("up"), F.count(F.lit(1)).alias("n")).join(votes, ["split", "symbol", "date"])
    wrong = wide.where(F.col("vote") != (F.col("up") * 2 > F.col("n")).cast("double")).count()
    return holds(spark, importances_sum_to_one=abs(shares.agg(F.sum("importance")).first()[0] - 1) < 1e-9, votes_follow_the_majority=wrong == 0)
