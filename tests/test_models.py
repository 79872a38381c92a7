"""Model fits against closed forms; trees and classifiers for sound and repeatable output."""

import datetime as dt
import os
import threading

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from barline.operators import ensemble, evaluate, features, models, profile, split
from barline.operators.profile import Standardizer, moments
from barline.plans import trials
from barline.sources import bars as bar_source
from barline.sources import sinks
from checks import model_queries, panels, profile_queries

COLUMNS = ["a", "b", "c"]
LABEL = "next_5day_return"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 240
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0.0, 10.0, 1.0]
    y = 0.3 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(0, 0.5, n)
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), *map(float, x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, f"symbol string, date date, a double, b double, c double, {LABEL} double")
    return split.time_folds(split.chrono_split(df), 3).cache()


@pytest.fixture(scope="module")
def rows(table):
    return models.model_rows(table, COLUMNS)[0].cache()


def scaled_train(table):
    pdf = table.where("split = 'train'").orderBy("date").toPandas()
    x = pdf[COLUMNS].to_numpy()
    return (x - x.mean(0)) / x.std(0), pdf[LABEL].to_numpy(), pdf["fold"].to_numpy()


def ridge_by_hand(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - w @ x.mean(0)


@pytest.mark.parametrize("alpha", [0.01, 10.0, 500.0])
def test_ridge_equals_the_normal_equations(table, rows, alpha):
    x, y, _ = scaled_train(table)
    w, b = ridge_by_hand(x, y, alpha)
    fitted = models.fit_ridge(models.part(rows, "train"), alpha)
    np.testing.assert_allclose(fitted.coefficients.toArray(), w, rtol=1e-9)
    assert abs(fitted.intercept - b) < 1e-9
    train = table.where("split = 'train'")
    found = moments(Standardizer(COLUMNS).fit(train).transform(train), [*COLUMNS, LABEL])
    np.testing.assert_allclose(models.ridge_solution(found, alpha)[0], w, rtol=1e-8)


def test_alpha_search_equals_refitting_each_fold(table):
    train = table.where("split = 'train'")
    scaled = Standardizer(COLUMNS).fit(train).transform(train)
    x, y, fold = scaled_train(table)
    best, scores, weights, _ = models.ridge_path(scaled, COLUMNS, (0.1, 10.0, 1000.0))
    for alpha, score in scores.items():
        held = []
        for i in range(3):
            w, b = ridge_by_hand(x[fold != i], y[fold != i], alpha)
            t = y[fold == i]
            held.append(1 - ((t - x[fold == i] @ w - b) ** 2).sum() / ((t - t.mean()) ** 2).sum())
        assert abs(score - np.mean(held)) < 1e-9
    assert best == max(scores, key=scores.get)
    np.testing.assert_allclose(weights, ridge_by_hand(x, y, best)[0], rtol=1e-8)


def test_lasso_and_elastic_net_meet_their_optimality_conditions(table, rows):
    x, y, _ = scaled_train(table)
    train = models.part(rows, "train")
    lasso = models.fit_lasso(train, 0.05)
    residual = y - x @ lasso.coefficients.toArray() - lasso.intercept
    slope = x.T @ residual / len(y)
    for w, g in zip(lasso.coefficients.toArray(), slope):
        assert abs(g - 0.05 * np.sign(w)) < 1e-4 if w else abs(g) <= 0.05 + 1e-4
    net = models.fit_elastic_net(train, 0.1, 0.5)
    w = net.coefficients.toArray()
    slope = x.T @ (y - x @ w - net.intercept) / len(y) - 0.1 * 0.5 * w
    for v, g in zip(w, slope):
        assert abs(g - 0.05 * np.sign(v)) < 1e-4 if v else abs(g) <= 0.05 + 1e-4


def test_attribution_sums_to_the_forecast(table):
    train = table.where("split = 'train'")
    scaler = Standardizer(COLUMNS).fit(train)
    found = moments(scaler.transform(train), [*COLUMNS, LABEL])
    weights, intercept = models.ridge_solution(found, 5.0)
    test = scaler.transform(table.where("split = 'test'"))
    parts = evaluate.linear_attribution(test, dict(zip(COLUMNS, weights)), dict.fromkeys(COLUMNS, 0.0))
    total = parts.groupBy("symbol", "date").agg(F.sum("attribution").alias("t"))
    forecast = test.select("symbol", "date", models.linear_forecast(COLUMNS, weights, intercept).alias("f"))
    worst = forecast.join(total, ["symbol", "date"]).select(F.max(F.abs(F.col("f") - F.col("t") - intercept))).first()[0]
    assert worst < 1e-12
    assert evaluate.attribution_rank(parts, 2).count() == 2


def test_trees_repeat_with_the_seed_and_learn(rows):
    train = models.part(rows, "train")
    trial = trials.Trial(0, "RF", "RF_10_4", 10, 4, 3, "sqrt")

    def scores():
        out = models.predict(models.fit_forest(train, trial), rows, "RF_10_4")
        out = out.unionByName(models.predict(models.fit_tree(train, leaf=5), rows, "DecisionTree"))
        return sorted(map(tuple, evaluate.regression_metrics(out).select("model", "split", "r2").collect()))

    first = scores()
    assert first == scores()
    assert all(r2 >= 0 for _, s, r2 in first if s == "train")


def test_sweep_keeps_trials_of_the_same_name_apart(rows):
    twins = [trials.Trial(i, "RF", "RF_5_3", 5, 3, leaf, "sqrt") for i, leaf in enumerate((2, 30))]
    found = models.trial_metrics(models.sweep(twins, rows))
    assert found.count() == 2 and found.select("model").distinct().count() == 1


def test_trial_lists_and_names():
    assert [len(t) for t in (trials.XGB_TRIALS, trials.XGB_ROUND_2)] == [12, 5]
    assert len(trials.LGB_TRIALS) == len(trials.RF_TRIALS) == len(trials.RF_ROUND_2) == 12
    assert trials.XGB_TRIALS[4].name == "XGB_100_4_70"
    assert trials.RF_ROUND_2[3].name == "RF_200_9"


def test_grid_search_uses_the_given_folds(rows):
    found = models.grid_search(DecisionTreeRegressor(seed=1), {"maxDepth": [1, 4]}, models.part(rows, "train"))
    assert len(found.avgMetrics) == 2 and np.isfinite(found.avgMetrics).all()


def test_boosting_stops_early(rows):
    noisy = rows.withColumn("label", F.when(F.col("split") == "val", -F.col("label")).otherwise(F.col("label")))
    assert len(models.fit_early_stopping(noisy, trees=15, depth=3).trees) < 15


def test_sequence_rows_hold_the_window_in_order(table):
    out = models.sequence_rows(table, ["a", "b"], 5)
    assert out.where("split = 'val'").count() == table.where("split = 'val'").count() - 4
    assert len(out.first()["features"]) == 10


def test_response_surface_reproduces_a_quadratic(spark):
    points = [(float(x), float(y), 1 + x - 2 * y + 0.5 * x * y + x * x) for x in range(1, 6) for y in range(1, 5)]
    grid = models.response_surface(spark.createDataFrame(points, "x double, y double, z double"), "x", "y", "z")
    worst = grid.select(
        F.max(F.abs(F.col("z") - (1 + F.col("x") - 2 * F.col("y") + 0.5 * F.col("x") * F.col("y") + F.col("x") ** 2)))
    ).first()[0]
    assert grid.count() == 400 and worst < 1e-6


def test_singular_surface_is_refused(spark):
    points = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 2.0, 3.0), (3.0, 1.0, 4.0)], "x double, y double, z double")
    with pytest.raises(ValueError, match="3 distinct points"):
        models.response_surface(points, "x", "y", "z")


def test_components_equal_the_eigenvectors(spark, table, rows):
    x, _, _ = scaled_train(table)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    model = models.fit_pca(models.part(rows, "train"), 3)
    np.testing.assert_allclose(model.explainedVariance.toArray(), values / values.sum(), rtol=1e-8)
    assert models.pca_report(model, COLUMNS, spark).count() == 9
    assert models.pca_scores(model, rows).columns == ["symbol", "date", "pc1", "pc2", "pc3"]


def test_direction_votes_follow_the_majority(rows):
    votes = models.predict_direction(models.fit_direction(rows), models.part(rows, "test"))
    wrong = (
        models.vote(votes).alias("v")
        .join(votes.groupBy("symbol", "date").agg(F.sum("yhat").alias("ups")), ["symbol", "date"])
        .where((F.col("ups") >= 2) != (F.col("yhat") == 1))
    )
    assert wrong.count() == 0


def test_stack_equals_least_squares(rows):
    train = models.part(rows, "train")
    out = models.predict(models.fit_ridge(train, 1.0), rows, "Ridge").unionByName(
        models.predict(models.fit_tree(train, leaf=5), rows, "Tree")
    )
    stack = ensemble.stack_fit(out, ["Ridge", "Tree"])
    pdf = ensemble.wide(out.where("split = 'val'"), ["Ridge", "Tree"]).toPandas()
    design = np.column_stack([pdf[["Ridge", "Tree"]], np.ones(len(pdf))])
    want = np.linalg.lstsq(design, pdf["y"], rcond=None)[0]
    np.testing.assert_allclose([*stack.coefficients, stack.intercept], want, rtol=1e-7)
    assert ensemble.stack_apply(out, ["Ridge", "Tree"], stack, "E").where("model = 'E_OLS'").count() == models.part(rows, "test").count()


def test_snapshot_and_model_are_computed_once(spark, rows, bars, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return bars

    for _ in range(2):
        assert sinks.snapshot(spark, compute, str(tmp_path / "s"), "k").count() == bars.count()
    assert len(calls) == 1
    sinks.snapshot(spark, compute, str(tmp_path / "s"), "other")
    assert len(calls) == 2
    train = models.part(rows, "train")
    first = sinks.fit_or_load(LinearRegression(), train, str(tmp_path / "m"))
    again = sinks.fit_or_load(LinearRegression(), train, str(tmp_path / "m"))
    assert first.stages[0].coefficients == again.stages[0].coefficients
    other = sinks.fit_or_load(LinearRegression(regParam=9.0), train, str(tmp_path / "m"))
    assert first.stages[0].coefficients != other.stages[0].coefficients
    assert len(list((tmp_path / "m").glob("fp=*"))) == 2
    sinks.fit_or_load(LinearRegression(), train, str(tmp_path / "m"), key="other rows")
    assert len(list((tmp_path / "m").glob("fp=*"))) == 3


def test_snapshots_of_writers_at_the_same_time(spark, tmp_path):
    home, both, slow = str(tmp_path / "s"), threading.Barrier(2), threading.Event()
    seen = []

    def rows(value, last):
        def compute():
            both.wait()  # neither has published when the other starts
            if last:
                slow.wait()
            return spark.range(1000, numPartitions=4).select("id", F.lit(value).alias("writer"))

        return compute

    def write(value, last):
        seen.append(sinks.snapshot(spark, rows(value, last), home, "k").select("writer").distinct().collect())

    writers = [threading.Thread(target=write, args=a) for a in (("first", False), ("second", True))]
    [w.start() for w in writers]
    writers[0].join()
    early = sinks.snapshot(spark, lambda: pytest.fail("published already"), home, "k")
    slow.set()
    writers[1].join()
    assert seen == [[("first",)], [("first",)]]
    assert early.groupBy("writer").count().collect() == [("first", 1000)]

    def broken():
        return spark.range(4).select(F.raise_error(F.lit("lost")).cast("string").alias("writer"))

    with pytest.raises(Exception, match="lost"):
        sinks.snapshot(spark, broken, home, "other")
    assert sinks.snapshot(spark, lambda: spark.range(3), home, "other").count() == 3


def test_key_of_files_follows_the_files(spark, tmp_path):
    folder = tmp_path / "in"
    spark.range(10).coalesce(1).write.parquet(str(folder))
    key = sinks.file_key(spark, str(folder))
    assert key == sinks.file_key(spark, str(folder))
    spark.range(1).coalesce(1).write.mode("append").parquet(str(folder))
    more = sinks.file_key(spark, str(folder))
    one = next(folder.glob("*.parquet"))
    os.utime(one, (1, 1))
    assert len({key, more, sinks.file_key(spark, str(folder))}) == 3


def test_csv_nan_is_read_as_missing(spark, tmp_path):
    (tmp_path / "b.csv").write_text("symbol,date,open,high,low,close,volume\nA,2024-01-02,1,2,0.5,NaN,7\n")
    row = bar_source.read_bars(spark, str(tmp_path / "b.csv")).first()
    assert row["close"] is None and row["date"] == dt.date(2024, 1, 2) and row["volume"] == 7.0


def test_bars_take_first_and_last_by_the_full_order(spark):
    trades = [("A", "2024-01-02 10:00:00", 2, 5.0, 1.0), ("A", "2024-01-02 10:00:00", 1, 7.0, 2.0),
              ("A", "2024-01-02 11:00:00", 1, 6.0, 4.0)]
    df = spark.createDataFrame(trades, "s string, t string, k int, p double, q double").withColumn("t", F.to_timestamp("t"))
    row = bar_source.bars_from_trades(df, F.col("s"), F.col("t"), F.col("p"), F.col("q"), [F.col("k")]).first()
    assert (row["open"], row["high"], row["low"], row["close"], row["volume"]) == (7.0, 7.0, 5.0, 6.0, 7.0)


def test_bars_of_spread_trades_need_one_exchange(spark):
    trades = [(s, f"2024-01-0{d} 10:00:00", k, float(d * k), 1.0) for s in ("A", "B", None) for d in (1, 2) for k in (1, 2, 2)]
    df = spark.createDataFrame(trades, "s string, t string, k int, p double, q double").withColumn("t", F.to_timestamp("t"))
    bars = lambda n: bar_source.bars_from_trades(df, F.col("s"), F.col("t"), F.col("p"), F.col("q"), [F.col("k")], n)
    spread = features.returns(bars(5))
    assert spread._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    keys = ("symbol", "date")
    assert spread.orderBy(*keys).collect() == features.returns(bars(None)).orderBy(*keys).collect()


def test_gap_of_stored_models_joins_no_rows(spark, tmp_path):
    rows = spark.range(400).select(
        array_to_vector(F.array(F.col("id") % 2 * 1.0, F.lit(1.0))).alias("features"), (F.col("id") % 2 * 3.0).alias("label")
    )
    first, again = (sinks.fit_or_load(LinearRegression(regParam=0.1), rows, str(tmp_path)) for _ in range(2))
    other = sinks.fit_or_load(LinearRegression(regParam=0.5), rows, str(tmp_path))
    same, apart = models.forecast_gap(first, again, rows), models.forecast_gap(first, other, rows)
    assert same.first()["gap"] == 0 and apart.first()["gap"] > 0
    assert "Join" not in same._jdf.queryExecution().executedPlan().toString()


def test_counts_of_missing_values_write_nothing(spark, tmp_path, monkeypatch):
    trades = [(d % 4, 1, d % 2, 1, 1.0 + d % 3, 10.0 + d, dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for d in range(60)]
    names = "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(trades, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    stored = profile.null_total(profile_queries.panel(spark, str(tmp_path))).first()["n_null"]
    monkeypatch.setattr(panels, "materialise", lambda df: pytest.fail("written"))
    assert profile_queries.null_total(spark, str(tmp_path)).first()["n_null"] == stored > 0
    assert profile_queries.missing_ratios(spark, str(tmp_path)).count() == len(profile_queries.COLUMNS)


def test_missing_share_is_counted_not_averaged(spark):
    rows = spark.createDataFrame([(1.0, None), (float("nan"), 2), (None, None)], "a double, b int")
    found = profile.missing_filter(rows, ["a", "b"], 0.5)
    assert {r["feature"]: (r["missing_ratio"], r["kept"]) for r in found.collect()} == {"a": (1 / 3, True), "b": (2 / 3, False)}
    assert "avg(" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["missing_ratio"] for r in profile.missing_filter(rows.where("a > 5 and b > 5"), ["a"]).collect()] == [None]


def test_lean_table_is_made_once_for_split_folds_and_rows(spark, tmp_path, monkeypatch):
    trades = [(d, 1, 1 + d % 2, 1, 1.0 + d % 3, 10.0 + d % 7, dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for d in range(300)]
    names = "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(trades, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = []
    table = model_queries.features.lean_feature_table
    monkeypatch.setattr(model_queries.features, "lean_feature_table", lambda df: made.append(table(df)) or made[-1])
    found = model_queries.lean(spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    costly = [n for n in ("MapInArrow", "MapInPandas", "ArrowEvalPython", "Window", "Generate") if n in plan(made[0])]
    assert costly and not any(n in plan(found) for n in costly) and len(made) == 1
    rows = found.groupBy("split").agg(F.count("fold").alias("folds"), F.count(F.lit(1)).alias("n")).collect()
    assert {r["split"] for r in rows} == {"train", "val", "test"} and all(r["folds"] == (r["n"] if r["split"] == "train" else 0) for r in rows)


def test_a_tree_cut_equals_a_fit_of_that_depth(rows, monkeypatch):
    """Every depth is scored as a search that fits it does, from one fit a fold and one of the best depth."""
    train, estimator = models.part(rows, "train"), DecisionTreeRegressor(minInstancesPerNode=3, seed=5)
    deep = estimator.copy({estimator.maxDepth: 5}).fit(train)
    for depth in (0, 1, 3):
        own = estimator.copy({estimator.maxDepth: depth}).fit(train)
        assert models.cut_tree(deep, depth).toDebugString.splitlines()[1:] == own.toDebugString.splitlines()[1:]
    grid = {"maxDepth": [1, 2, 4]}
    builder = models.ParamGridBuilder().addGrid(estimator.maxDepth, grid["maxDepth"])
    want = models.CrossValidator(
        estimator=estimator, estimatorParamMaps=builder.build(), evaluator=models.RegressionEvaluator(metricName="r2"), numFolds=3, foldCol="fold"
    ).fit(train)
    fits = []
    fit = DecisionTreeRegressor.fit
    monkeypatch.setattr(DecisionTreeRegressor, "fit", lambda self, df, *a: fits.append(self.getMaxDepth()) or fit(self, df, *a))
    found = models.grid_search(estimator, grid, train)
    np.testing.assert_allclose(found.avgMetrics, want.avgMetrics, atol=1e-9)
    np.testing.assert_allclose(found.stdMetrics, want.stdMetrics, atol=1e-9)
    assert found.bestModel.toDebugString.splitlines()[1:] == want.bestModel.toDebugString.splitlines()[1:]
    assert fits == [4, 4, 4, grid["maxDepth"][int(np.argmax(want.avgMetrics))]]


def test_model_rows_are_written_once_without_derived_columns(spark, tmp_path, monkeypatch):
    trades = [(d, 1, 1 + d % 2, 1, 1.0 + d % 3, 10.0 + d % 7, dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for d in range(300)]
    names = "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(trades, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    written, own = [], model_queries.materialise
    monkeypatch.setattr(model_queries, "materialise", lambda df: written.append(df.columns) or own(df))
    rows, columns, *_ = model_queries.model_rows(spark, str(tmp_path))
    wide = [w for w in written if "sma_50" in w or "features" in w]
    derived = {*features.LEAN_DERIVED, *features.LEAN_DROPPED}
    assert len(wide) == 1 and not derived & set(wide[0]) and set(features.LEAN_DERIVED) < set(columns)
    whole = features.lean_feature_table(panels.stored_indicators(spark, str(tmp_path)))
    assert columns == features.feature_columns(whole, features.LEAN_DROPPED)
    means = whole.agg(*[F.avg(c) for c in columns]).first()
    stored = model_queries.lean(spark, str(tmp_path)).agg(*[F.avg(c) for c in columns]).first()
    assert rows.count() == whole.count() and tuple(stored) == pytest.approx(tuple(means))
