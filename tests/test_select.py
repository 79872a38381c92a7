"""Selection rules on constructed matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import audit, features, profile, select
from barline.operators.indicators import add_indicators


def frame(spark, columns):
    names = list(columns)
    rows = list(zip(*[map(float, columns[n]) for n in names]))
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


PAIRS = "feature_i string, feature_j string, pos_i int, pos_j int, r double"


def test_correlated_pairs_keep_the_best_and_earlier_of_ties(spark):
    pairs = [("a", "b", 0, 1, 0.99), ("a", "c", 0, 2, 0.5), ("b", "c", 1, 2, -0.97), ("c", "d", 2, 3, 0.1)]
    scores = [("a", 0.3), ("b", 0.3), ("c", 0.9), ("d", 0.0)]
    got = select.correlated_drops(
        spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(scores, "feature string, score double")
    )
    # b ties with a and goes; though gone, it still loses against c in the next group.
    assert {r["feature"] for r in got.collect()} == {"b"}


def test_a_dropped_feature_still_takes_part(spark):
    pairs = [("a", "b", 0, 1, 0.99), ("b", "c", 1, 2, 0.99), ("a", "c", 0, 2, 0.0)]
    scores = [("a", 0.9), ("b", 0.5), ("c", 0.1)]
    got = select.correlated_drops(
        spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(scores, "feature string, score double")
    )
    assert {r["feature"] for r in got.collect()} == {"b", "c"}


@pytest.fixture(scope="module")
def dependent(spark):
    rng = np.random.default_rng(1)
    a, b, d = rng.normal(size=(3, 200))
    return frame(spark, {"a": a, "b": b, "c": a + b, "d": d + 0.5 * a, "e": np.ones(200)})


def test_inflation_equals_the_regression_definition(spark, dependent):
    got = {r["feature"]: r["vif"] for r in select.vif_table(dependent, ["a", "b", "d"]).collect()}
    pdf = dependent.toPandas()
    for c in "abd":
        others = np.column_stack([pdf[[o for o in "abd" if o != c]], np.ones(len(pdf))])
        fitted = others @ np.linalg.lstsq(others, pdf[c], rcond=None)[0]
        r2 = 1 - ((pdf[c] - fitted) ** 2).sum() / ((pdf[c] - pdf[c].mean()) ** 2).sum()
        assert abs(got[c] - 1 / (1 - r2)) < 1e-8


def test_exact_dependency_drops_the_later_column(dependent):
    found = profile.moments(dependent, ["a", "b", "c", "d"])
    assert np.isinf(select.vifs(found)[:3]).all() and np.isfinite(select.vifs(found)[3])
    kept, steps = select.vif_steps(found, min_keep=1)
    assert steps[0][1] == "c" and "d" in kept


def test_inflation_stops_at_the_wanted_number(dependent):
    kept, steps = select.vif_steps(profile.moments(dependent, ["a", "b", "c", "d"]), min_keep=4)
    assert kept == ["a", "b", "c", "d"] and not steps


def test_profiles_of_constant_and_missing_columns(spark, dependent):
    df = dependent.withColumn("y", F.col("a")).withColumn("e", F.col("e"))
    scores = {r["feature"]: r["score"] for r in profile.target_corr(df, ["a", "e"], "y").collect()}
    assert abs(scores["a"] - 1) < 1e-12 and scores["e"] == 0
    kept = {r["feature"]: r["kept"] for r in profile.variance_filter(df, ["a", "e"]).collect()}
    assert kept == {"a": True, "e": False}
    r = profile.corr_matrix(df, ["a", "e"]).first()["r"]
    assert r is None


def test_ranks_are_averaged(spark):
    df = frame(spark, {"x": [1, 2, 2, 5, 9], "z": [3, 1, 1, 7, 7]}).withColumn("symbol", F.lit("A"))
    df = df.withColumn("date", F.monotonically_increasing_id())
    got = profile.corr_matrix(df, ["x", "z"], "spearman").first()["r"]
    import pandas as pd

    want = pd.DataFrame({"x": [1, 2, 2, 5, 9], "z": [3, 1, 1, 7, 7]}).corr("spearman").iloc[0, 1]
    assert abs(got - want) < 1e-12


def test_mutual_information_of_independent_and_equal_columns(spark):
    rng = np.random.default_rng(2)
    y = rng.uniform(size=4000)
    df = frame(spark, {"same": y, "noise": rng.uniform(size=4000), "y": y})
    got = {r["feature"]: r["mi"] for r in profile.mi_scores(df, ["same", "noise"], "y", 8).collect()}
    assert abs(got["same"] - np.log(8)) < 0.01 and got["noise"] < 0.02


def test_top_fraction_rounds_down(spark):
    scores = spark.createDataFrame([(f"f{i}", float(i)) for i in range(7)], "feature string, score double")
    assert [r["feature"] for r in select.top_fraction(scores, 0.5).orderBy("place").collect()] == ["f6", "f5", "f4"]


def test_cascade_shrinks_step_by_step(bars):
    df = features.feature_table(add_indicators(bars)).dropna("any", subset=["next_5day_return", "return_mean_60"])
    df = df.fillna(0)
    found = select.select_features(df, features.feature_columns(df))
    sizes = [len(kept) for _, kept in found.steps]
    assert sizes[0] == 156 and sizes[:5] == sorted(sizes[:5], reverse=True)
    assert len(found.tabular) == sizes[4] // 2 and len(found.sequence) == int(sizes[4] * 0.2)
    assert found.report(df).count() == 7


def test_cascade_pair_rule_equals_the_relational_one(spark, dependent):
    df = dependent.withColumn("f", F.col("a") * 2 + F.col("b") * 0.01).withColumn("next_5day_return", F.col("d"))
    columns = ["a", "b", "d", "f"]
    scores = profile.target_corr(df, columns)
    kept = {r["feature"] for r in select.correlation_filter(df, columns, scores).where("kept").collect()}
    assert kept == set(dict(select.select_features(df, columns, min_keep=1).steps)["correlation"])


def test_outliers_and_signals(spark):
    df = frame(spark, {"x": [1, 2, 3, 4, 100]}).withColumn("symbol", F.lit("A"))
    df = df.withColumn("date", F.monotonically_increasing_id())
    assert [r["value"] for r in audit.iqr_outliers(df, ["x"]).collect()] == [100.0]
