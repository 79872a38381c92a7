"""Ranks, scores and choices on hand-made tables, and published values."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions.names import model_family
from barline.operators import choose, ensemble, evaluate, ordered

# Published scores of the model registry, in falling order of R2.
ENTRIES = [
    ("Ensemble_R2³_3模型", 0.01481583495754124),
    ("Ensemble_R2³_2模型", 0.014747379790521986),
    ("GRU_R3_24_2", 0.012826275750847715),
    ("Ridge_500", 0.009105046469150224),
    ("Ridge_400", 0.008863560667704329),
    ("Ridge_750", 0.00885328501776983),
    ("GRU_32_3", 0.008633325440117634),
    ("Ridge_250", 0.007592056063007502),
    ("GRU_R3_16_3", 0.004873199654102933),
    ("GRU_R2_30_3", 0.0035487534765202833),
    ("Ridge", 0.0034737927511895306),
    ("LSTM_R3_8_2", 0.001973807008674333),
    ("GRU_R3_20_4", 0.0016873061947983992),
    ("LSTM_16_2", 0.0011203069626165574),
    ("RF_100_6", 0.0010765843161627542),
    ("LSTM_24_3", -0.000211753283801297),
    ("GRU_R3_32_3", -0.00036217784112690943),
    ("GRU_R3_64_2", -0.0014404457930643488),
    ("LGB_30_2_50", -0.0025659939799522746),
    ("GRU_R2_32_4", -0.0031752939670735003),
    ("LSTM_R3_32_3", -0.003408427562090699),
    ("LSTM_R3_20_3", -0.00463277798699524),
    ("LSTM_R2_16_3", -0.005129692580638112),
    ("LSTM_R3_24_4", -0.0062124840171238205),
    ("LSTM_R3_16_4", -0.006427547328528238),
    ("LGB_50_3_30", -0.007612114014457605),
    ("LGB_45_2_40", -0.007636391184540736),
    ("RF_100_7", -0.009639875786989993),
    ("Lasso", -0.010283878551437198),
    ("ElasticNet", -0.010283878551437198),
    ("DecisionTree", -0.010283878551437198),
    ("RF_100_8", -0.012578318634718366),
    ("LSTM_40_2", -0.029715011546418202),
    ("RF_200_8", -0.03148754507170737),
    ("RF_300_8", -0.033635475651615954),
    ("LSTM_R2_12_2", -0.05072782472393422),
    ("XGB_100_6_30", -0.14896667908262207),
    ("XGB_120_4_40", -0.15673049759158642),
    ("XGB_100_4_50", -0.1591482194443241),
    ("GradientBoosting", -0.4885597232215655),
    ("SVR", -0.5637120924424321),
]


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(ENTRIES, "model string, r2 double")


def names(df, order="place"):
    return [r["model"] for r in df.orderBy(order).collect()]


def test_leaderboard_keeps_the_published_order(registry):
    got = names(choose.leaderboard(registry))
    tied = {"Lasso", "ElasticNet", "DecisionTree"}
    assert [m for m in got if m not in tied] == [m for m, _ in ENTRIES if m not in tied]


def test_published_heterogeneous_pick(registry):
    singles = registry.where(~F.col("model").contains("Ensemble"))
    assert names(choose.pick_heterogeneous(singles), "pick") == ["GRU_R3_24_2", "Ridge_500", "LGB_30_2_50"]


def test_published_display_selection(registry):
    assert names(choose.display_models(registry)) == [
        "Ensemble_R2³_3模型", "GRU_R3_24_2", "Ridge_500", "Ridge_400", "Ridge_750", "GRU_32_3", "Ridge_250", "Ridge",
        "LSTM_R3_8_2", "LSTM_16_2", "RF_100_6", "LGB_30_2_50", "LGB_50_3_30", "RF_100_7",
    ]


def test_published_direction_candidates(registry):
    assert names(choose.classification_candidates(registry)) == [
        "Ensemble_R2³_3模型", "Ensemble_R2³_2模型", "GRU_R3_24_2", "Ridge_500", "Ridge_400",
    ]


def test_published_family_counts(registry):
    family = model_family(F.col("model"), ("Ensemble", "GRU", "LSTM", "Ridge", "XGB", "LGB", "RF"))
    got = {r["f"]: r["count"] for r in registry.groupBy(family.alias("f")).count().collect()}
    assert got == {"GRU": 8, "LSTM": 10, "Ridge": 5, "XGB": 3, "LGB": 3, "RF": 5, "Ensemble": 2, "Other": 5}


@pytest.mark.parametrize(
    "members,weights",
    [
        (["GRU_R3_24_2", "Ridge_500", "Ridge_400"], [0.5925, 0.2120, 0.1955]),
        (["GRU_R3_24_2", "Ridge_500", "LGB_30_2_50"], [0.7409, 0.2650, -0.0059]),
    ],
)
def test_published_weights(registry, members, weights):
    rows = registry.where(F.col("model").isin(members)).withColumn("ensemble", F.lit("e"))
    got = {r["model"]: r["weight"] for r in ensemble.power_weights(rows).collect()}
    np.testing.assert_allclose([got[m] for m in members], weights, atol=6e-5)
    assert abs(sum(got.values()) - 1) < 1e-12


def confusion_rows(spark, tn, fp, fn, tp):
    rows = [(-1.0, -1.0)] * tn + [(-1.0, 1.0)] * fp + [(1.0, -1.0)] * fn + [(1.0, 1.0)] * tp
    return spark.createDataFrame(rows, "y double, yhat double").withColumn("model", F.lit("m"))


@pytest.mark.parametrize(
    "counts,scores",
    [((16, 169, 14, 158), (0.4874, 0.4832, 0.9186, 0.6333)), ((15, 170, 12, 160), (0.4902, 0.4848, 0.9302, 0.6375))],
)
def test_published_class_metrics(spark, counts, scores):
    row = evaluate.class_metrics(evaluate.confusion(confusion_rows(spark, *counts))).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == counts
    got = [round(row[c], 4) for c in ("accuracy", "precision", "recall", "f1")]
    assert tuple(got) == scores


def test_report_lines(spark):
    rows = confusion_rows(spark, 16, 169, 14, 158)
    summary = evaluate.classification_summary(rows)
    block = evaluate.format_report(summary).first()["block"]
    assert "- Accuracy: 0.4874\n" in block and "实际跌            16       169\n" in block
    assert evaluate.check_metrics(summary, rows).count() == 0
    assert evaluate.check_metrics(summary.withColumn("accuracy", F.lit(0.6)), rows).count() == 1
    assert evaluate.check_metrics(summary, confusion_rows(spark, 169, 16, 14, 158)).count() == 1


def forecasts(spark, rows, model="m"):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame(
        [(model, "val", "A", day + dt.timedelta(days=i), float(y), float(s)) for i, (y, s) in enumerate(rows)],
        "model string, split string, symbol string, date date, y double, yhat double",
    )


def auc_by_pairs(rows):
    pos, neg = [s for y, s in rows if y > 0], [s for y, s in rows if y <= 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties_equals_all_pairs(spark):
    rows = [(1, 0.3), (1, 0.3), (-1, 0.3), (-1, 0.1), (1, 0.9), (-1, 0.9), (1, 0.5), (-1, 0.2), (1, 0.2), (-1, 0.7)]
    assert abs(evaluate.roc_auc(forecasts(spark, rows)).first()["roc_auc"] - auc_by_pairs(rows)) < 1e-12
    for bounded in (False, True):
        found = evaluate.roc_auc(forecasts(spark, rows), ["symbol"], bounded).first()["roc_auc"]
        assert abs(found - auc_by_pairs(rows)) < 1e-12


def test_auc_of_a_single_class_is_missing(spark):
    assert evaluate.roc_auc(forecasts(spark, [(1, 0.3), (2, 0.4)])).first()["roc_auc"] is None


@pytest.mark.parametrize("bucket_rows", [2, 7, 1000])
def test_running_totals_and_quantiles_over_buckets(spark, bucket_rows):
    rng = np.random.default_rng(5)
    # A third of all rows share one value, and one group holds most rows.
    values = [("a", v) for v in [1.0] * 300 + rng.normal(0, 3, 600).round(2).tolist()]
    values += [("b", v) for v in rng.normal(0, 1, 40).tolist()]
    df = spark.createDataFrame(values, "g string, v double")
    got = ordered.running_totals(df, ["g"], "v", {"n": F.count(F.lit(1))}, bucket_rows).collect()
    assert len(got) == len(set(values))
    for r in got:
        own = [v for g, v in values if g == r["g"]]
        assert (r["n"], r["n_before"], r["n_all"]) == (own.count(r["v"]), sum(v < r["v"] for v in own), len(own))
    q = {r["g"]: r for r in ordered.quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "hi": 1.0}, bucket_rows).collect()}
    for g in "ab":
        own = [v for h, v in values if h == g]
        np.testing.assert_allclose([q[g]["q1"], q[g]["q2"], q[g]["hi"]], np.quantile(own, [0.25, 0.5, 1.0]))


def test_few_borders_place_values_but_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(ordered, "MOST_BORDERS", 3)
    values = [1.0] * 400 + np.random.default_rng(6).normal(0, 3, 400).round(2).tolist()
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    placed, before = ordered._in_buckets(df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), ["g"], "v", ["n"], 2)
    assert 1 < before.count() <= 4
    for bounded in (False, True):
        q = ordered.quantiles(df, ["g"], "v", {"q1": 0.25, "q3": 0.75}, 2, bounded).first()
        np.testing.assert_allclose([q["q1"], q["q3"]], np.quantile(values, [0.25, 0.75]))
    ranks = {r["v"]: r["n_before"] for r in ordered.running_totals(df, ["g"], "v", {"n": F.count(F.lit(1))}, 2).collect()}
    assert all(ranks[v] == sum(x < v for x in values) for v in values[:40])


def test_regression_scores(spark):
    rows = [(1, 0.5), (2, 2.5), (-1, 0.0), (4, 3.0)]
    got = evaluate.regression_metrics(forecasts(spark, rows)).first()
    y, s = np.array(rows).T
    assert abs(got["r2"] - (1 - ((y - s) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-12
    assert got["r2"] <= 1 and abs(got["rmse"] - np.sqrt(((y - s) ** 2).mean())) < 1e-12
    assert abs(got["mae"] - np.abs(y - s).mean()) < 1e-12


def test_alignment_of_models_with_different_dates(spark):
    table = None
    for i in range(5):
        rows = forecasts(spark, [(d, d + i) for d in range(10)], f"m{i}").where(F.dayofmonth("date") > i)
        table = rows if table is None else table.unionByName(rows)
    got = ensemble.align(table, ["m0", "m2", "m4"])
    assert got.count() == 3 * 6
    weights = spark.createDataFrame([("m0", "e", 0.25), ("m4", "e", 0.75)], "model string, ensemble string, weight double")
    blended = ensemble.blend(table, weights).collect()
    assert len(blended) == 6 and all(abs(r["yhat"] - (r["y"] + 3)) < 1e-12 for r in blended)


def test_threshold_pick_tops_up_without_a_second_capped_model(spark):
    rows = [("GRU_1", 0.3), ("GRU_2", 0.29), ("LSTM_1", 0.1), ("Ridge", 0.02)]
    metrics = spark.createDataFrame(rows, "model string, r2 double")
    got = names(choose.pick_threshold(metrics, 0.13, {"GRU": 1}), "pick")
    assert got == ["GRU_1", "LSTM_1", "Ridge"]


def test_last_table_wins(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "model string, r2 double")
    b = spark.createDataFrame([("y", 3.0)], "model string, r2 double")
    assert {tuple(r) for r in choose.last_wins(a, b).collect()} == {("x", 1.0), ("y", 3.0)}
