"""Whole series as arrays: features without chains of windows, plans that are not made again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions.rows import Series, with_series
from barline.operators import features, fill, split
from barline.operators.indicators import add_indicators
from checks import forecasts, model_queries, profile_queries


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lags_stay_in_their_series():
    series = Series(np.array([3, 3, 5]))  # the second series is empty
    x = np.arange(5.0)
    np.testing.assert_array_equal(series.lag(x, 1), [np.nan, 0, 1, np.nan, 3])
    np.testing.assert_array_equal(series.lag(x, -2), [2, np.nan, np.nan, np.nan, np.nan])
    np.testing.assert_array_equal(series.lag(x, 9), [np.nan] * 5)


def test_missing_keys_values_and_shuffled_rows(spark):
    rows = [(None, 2, 5.0, 7), ("a", 3, None, 8), ("a", 1, 1.0, 9), (None, 1, 2.0, None), ("a", 2, 4.0, 1)]
    df = spark.createDataFrame(rows, "symbol string, date int, x double, n int")
    out = with_series(df, ["x", "n"], ["before", "m"], lambda s, c: {"before": s.lag(c["x"], 1), "m": c["n"]}, ["symbol"])
    got = {(r["symbol"], r["date"]): (r["x"], r["n"], r["before"], r["m"]) for r in out.collect()}
    assert out.columns == ["symbol", "date", "x", "n", "before", "m"]
    assert got == {
        (None, 1): (2.0, None, None, None), (None, 2): (5.0, 7, 2.0, 7.0), ("a", 1): (1.0, 9, None, 9.0),
        ("a", 2): (4.0, 1, 1.0, 1.0), ("a", 3): (None, 8, 4.0, 8.0),
    }


@pytest.mark.parametrize("table", [features.feature_table, features.lean_feature_table])
def test_feature_tables_need_no_chain_of_windows(bars, table):
    assert "Window" not in plan_of(table(add_indicators(bars)))


def test_values_are_computed_once_and_packed_once(bars):
    plan = features.feature_table(add_indicators(bars))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Generate") == 1


def lineitems(spark, folder):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 2).cast("int"))
    price = (F.col("id") * 7 % 31 + 10).cast("double")
    spark.range(400).select(
        F.col("id").alias("l_orderkey"), F.col("id").alias("l_partkey"), (F.col("id") % 2).alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        (F.col("id") % 5 + 1).cast("double").alias("l_quantity"), price.alias("l_extendedprice"), F.lit("N").alias("l_returnflag"),
        day.cast("timestamp").alias("l_shipdate"),
    ).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_plans_read_written_bars_once(spark, tmp_path):
    """The lean rows are one branch, and every plan starts at what was written, not at the trades."""
    sf = lineitems(spark, tmp_path)
    lean = plan_of(model_queries.lean(spark, sf))
    assert "Union" not in lean and "parquet" not in lean
    assert "parquet" not in plan_of(model_queries.two_features(spark, sf))
    panel = profile_queries.panel(spark, sf)
    assert "parquet" not in plan_of(panel) and "inline" in plan_of(panel)  # bars are written, features are not


def test_split_of_known_rows_in_one_pass(spark):
    """The rows and splits of drop_warmup and chrono_split, for rows in any order, whatever the size of a batch."""
    rows = [("a", d, None if d < 3 else d * 1.0, d) for d in range(30)] + [("b", d, float("nan") if d == 4 else 1.0, d) for d in range(9)]
    rows += [(None, d, 1.0, 1) for d in range(4)] + [("c", 1, 2.0, 3), ("d", 1, None, 3), ("e", 2, 1.0, None)]
    df = spark.createDataFrame(rows[::2] + rows[1::2], "symbol string, date int, x double, n int").repartition(3)
    want = split.chrono_split(fill.drop_warmup(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert sorted(split.known_split(df).collect()) == sorted(want.collect())
        assert sorted(split.known_split(df, only="train").collect()) == sorted(want.where("split = 'train'").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_training_rows_are_neither_sorted_nor_exchanged(spark, tmp_path):
    """Only the bars are packed by series; the columns made of them are not moved for the split."""
    sf = lineitems(spark, tmp_path)
    wide = [profile_queries.train(spark, sf), split.known_split(profile_queries.panel(spark, sf), in_order=True)]
    for df in wide:
        plan = df._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("ArrowEvalPython")]
        assert "Window" not in plan and "Exchange" not in above and "Sort" not in above


def test_forecasts_start_at_what_was_written(spark, tmp_path):
    """The rows behind the forecasts are made once; every reader starts at them, not at the trades."""
    sf = lineitems(spark, tmp_path)
    assert "parquet" not in plan_of(forecasts.common(spark, sf)) and "Window" not in plan_of(forecasts.predictions(spark, sf))
