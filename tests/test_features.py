"""Window and calendar features against pandas, and the properties they must have."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators import blocks, features, fill, split
from barline.operators.indicators import LOOKBACK, SEGMENT, add_indicators, exponential_means, windowed_indicators
from barline.plans import long_series
from tests.conftest import by_symbol, make_bars


def series_of(pdf, symbol):
    return pdf[pdf.symbol == symbol].sort_values("date").reset_index(drop=True)


def same(a, b, tolerance=1e-9):
    np.testing.assert_allclose(a, np.asarray(b, dtype=float), rtol=tolerance, atol=tolerance, equal_nan=True)


@pytest.mark.parametrize("stat", ["mean", "std", "max", "min", "skew", "kurt"])
def test_rolling_equals_pandas(bars, bars_pdf, stat):
    df = features.rolling(bars, "close", stat, [5, 20])
    for n in (5, 20):
        got = by_symbol(df, f"close_{stat}_{n}")
        for s in "AB":
            roll = series_of(bars_pdf, s)["close"].rolling(n)
            same(got[s], getattr(roll, stat)(), 1e-7)


def test_rolling_needs_a_full_window_without_gaps(bars, bars_pdf):
    holed = bars.withColumn("close", F.when(F.dayofmonth("date") != 15, F.col("close")))
    got = by_symbol(features.rolling(holed, "close", "mean", [5]), "close_mean_5")
    for s in "AB":
        pdf = series_of(bars_pdf, s)
        close = pdf["close"].where(pd.to_datetime(pdf["date"]).dt.day != 15)
        same(got[s], close.rolling(5).mean())


def test_moments_of_a_flat_window_are_missing(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), 0.1) for i in range(8)]
    df = features.rolling(spark.createDataFrame(rows, "symbol string, date date, close double"), "close", ("skew", "kurt"), [5])
    assert df.where(F.col("close_skew_5").isNotNull() | F.col("close_kurt_5").isNotNull()).count() == 0


def test_an_extreme_value_leaves_no_trace_in_later_windows(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(0, 1, 200)
    values[40] = 1e12
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "symbol string, date date, x double")
    df = features.rolling(frame, "x", ("mean", "std", "skew", "kurt", "max", "min"), [1, 7, 60])
    pdf = pd.Series(values[41:])  # windows that begin behind it
    for n in (7, 60):
        for stat in ("mean", "std", "skew", "kurt", "max", "min"):
            same(by_symbol(df, f"x_{stat}_{n}")["A"][41 + n - 1 :], getattr(pdf.rolling(n), stat)()[n - 1 :], 1e-9)
    same(by_symbol(df, "x_mean_1")["A"], values)
    assert "x_skew_1" not in df.columns and np.isnan(by_symbol(df, "x_std_1")["A"]).all()


def test_changes_lags_and_label(bars, bars_pdf):
    df = features.forward_return(features.returns(bars))
    df = features.momentum(features.lags(df, ["return"], [3]), [5])
    for s in "AB":
        pdf = series_of(bars_pdf, s)
        same(by_symbol(df, "return")[s], pdf["close"].pct_change())
        same(by_symbol(df, "return_lag3")[s], pdf["close"].pct_change().shift(3))
        same(by_symbol(df, "next_5day_return")[s], pdf["close"].shift(-5) / pdf["close"] - 1)
        same(by_symbol(df, "price_momentum_5")[s], pdf["close"] / pdf["close"].shift(5) - 1)
        change = pdf["volume"].pct_change().replace([np.inf, -np.inf], np.nan)  # division by zero is missing here
        same(by_symbol(df, "volume_change")[s], change)


@pytest.mark.parametrize("start,end", [("2023-12-29", "2024-03-04"), ("2024-12-30", "2025-01-02")])
def test_calendar_equals_pandas(spark, start, end):
    dates = pd.date_range(start, end)
    df = features.calendar_features(spark.createDataFrame([(d.date(),) for d in dates], "date date"))
    got = df.orderBy("date").toPandas()
    assert got["dayofweek"].tolist() == dates.dayofweek.tolist()
    assert got["week"].tolist() == dates.isocalendar().week.tolist()
    for name in ("month", "quarter", "day"):
        assert got[name].tolist() == getattr(dates, name).tolist()
    for name in ("is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end"):
        assert got[name].tolist() == getattr(dates, name).astype(int).tolist()


def test_feature_table_has_159_columns(bars):
    """20 input columns (next-day close among them, the symbol aside) and 139 added ones."""
    with_next = features.forward_value(add_indicators(bars), "close", 1, "next_day_close")
    df = features.feature_table(with_next)
    assert len(with_next.columns) - 1 == 20
    assert len(df.columns) - 1 == 159
    assert len(features.feature_columns(df)) == 156


def test_lean_table_has_42_features_counting_the_next_close(bars):
    with_next = features.forward_value(add_indicators(bars), "close", 1, "next_day_close")
    df = features.lean_feature_table(with_next)
    assert len(df.columns) - 1 == 49
    assert len(features.feature_columns(df, features.LEAN_DROPPED)) == 41  # the next close leaks and is left out


def test_feature_stage_needs_one_exchange_by_series(bars):
    plan = features.feature_table(add_indicators(bars))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_features_do_not_see_the_future(spark, bars_pdf):
    schema = "symbol string, date date, open double, high double, low double, close double, volume double"
    cut = sorted(bars_pdf.date.unique())[70]
    changed = bars_pdf.copy()
    later = changed.date > cut
    changed.loc[later, ["open", "high", "low", "close", "volume"]] *= 3

    def upto(pdf):
        df = features.feature_table(add_indicators(spark.createDataFrame(pdf, schema)))
        df = df.where(F.col("date") <= F.lit(cut)).drop("next_5day_return")
        return df.orderBy("symbol", "date").toPandas()

    pd.testing.assert_frame_equal(upto(bars_pdf), upto(changed))


def test_other_symbols_and_row_order_do_not_matter(spark, bars_pdf):
    schema = "symbol string, date date, open double, high double, low double, close double, volume double"

    def table(pdf):
        df = features.feature_table(add_indicators(spark.createDataFrame(pdf, schema)))
        return df.where(F.col("symbol") == "A").orderBy("date").toPandas()

    alone = bars_pdf[bars_pdf.symbol == "A"].sample(frac=1, random_state=1)
    pd.testing.assert_frame_equal(table(bars_pdf), table(alone))


def test_exponential_mean_over_several_segments(spark):
    n = SEGMENT * 2 + 100
    pdf = make_bars(n, ("A",), seed=3)
    got = by_symbol(exponential_means(spark.createDataFrame(pdf), "close", [12, 100]), "ema_12")["A"]
    same(got, series_of(pdf, "A")["close"].ewm(span=12).mean(), 1e-11)
    got = by_symbol(exponential_means(spark.createDataFrame(pdf), "close", [12, 100]), "ema_100")["A"]
    same(got, series_of(pdf, "A")["close"].ewm(span=100).mean(), 1e-11)


def test_blocks_equal_plain_windows(bars):
    def compute(df, by):
        df = features.forward_return(features.returns(df, by), 5, by)
        return features.rolling(df, "return", ("mean", "std"), [5, 20], by)

    plain = compute(bars, ("symbol",)).orderBy("symbol", "date").toPandas()
    cut = blocks.in_blocks(bars, compute, 21, 5, block_rows=25)
    pd.testing.assert_frame_equal(plain, cut.select(*plain.columns).orderBy("symbol", "date").toPandas())


@pytest.mark.parametrize("block_rows", [3, 7, 64])
def test_carried_values_equal_plain_windows(spark, block_rows):
    """Long gaps that reach over several blocks, a column without values, one known value only."""
    bars = spark.createDataFrame(make_bars(150, ("A", "B", "C"), seed=5), "symbol string, date date, open double, high double, low double, close double, volume double")
    holed = bars.withColumns(
        {
            "x": F.when((F.dayofyear("date") % 41 == 0) | (F.dayofyear("date") % 43 == 1), F.col("close")),
            "none": F.lit(None).cast("double"),
            "one": F.when((F.col("symbol") == "B") & (F.col("date") == "2024-01-20"), F.col("open")),
            "next_5day_return": F.when(F.dayofmonth("date") != 9, F.col("low")),
        }
    )
    order = lambda df: df.select(*sorted(df.columns)).orderBy("symbol", "date").toPandas()
    cut = blocks.Blocks(holed, block_rows)
    columns = ["x", "none", "one"]
    pd.testing.assert_frame_equal(order(cut.ffill(columns).rows()), order(fill.ffill(holed, columns)))
    pd.testing.assert_frame_equal(order(cut.bfill(columns).rows()), order(fill.bfill(holed, columns)))
    pd.testing.assert_frame_equal(order(cut.clean().rows()), order(fill.clean(holed)))
    spans = [2, 12, 100, 5000]
    pd.testing.assert_frame_equal(order(cut.exponential_means("close", spans).rows()), order(exponential_means(holed, "close", spans)), rtol=1e-12)
    assert blocks.Blocks(holed.limit(0), block_rows).clean().rows().count() == 0


def test_carried_values_never_bring_a_series_together(bars):
    """Every window of the long-series plan works inside a cell, a block, or on one row for each of these."""
    cut = blocks.Blocks(bars, 200).exponential_means("close", [12]).windowed(windowed_indicators, LOOKBACK, 0)
    plan = cut.ffill(["rsi_7"]).bfill(["cci_7"]).clean("close").rows()._jdf.queryExecution().optimizedPlan().toString()
    keys = [k for w in re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan) for k in [re.sub(r"#\d+L?", "", w)]]
    assert keys and set(keys) <= {"symbol, _cell", "symbol", "symbol, _home", "symbol, _home, _seg", "symbol, _block"}
    alone = [line for line in plan.splitlines() if re.search(r"Window \[.*\], \[symbol#\d+\], \[(_cell|_home)", line)]
    assert len(alone) == keys.count("symbol")  # over cells or blocks, one row each


def test_long_series_plan_equals_the_plain_one(bars):
    order = lambda df: df.select(*sorted(df.columns)).orderBy("symbol", "date").toPandas()
    plain = fill.clean(features.feature_table(add_indicators(bars)))
    pd.testing.assert_frame_equal(order(long_series.clean_features(bars, block_rows=101)), order(plain), rtol=1e-9, check_dtype=False)


def test_fills_equal_pandas(bars, bars_pdf):
    df = features.forward_return(features.returns(bars))
    df = features.rolling(df, "return", "std", [10])
    cleaned = fill.clean(df)
    got = by_symbol(cleaned, "return_std_10")
    for s in "AB":
        pdf = series_of(bars_pdf, s)
        want = pdf["close"].pct_change().rolling(10).std()[:-5].ffill().bfill().fillna(0)
        same(got[s], want)
    holed = bars.withColumn("close", F.when(F.dayofmonth("date") % 3 != 0, F.col("close")))
    for fn, name in ((fill.ffill, "ffill"), (fill.bfill, "bfill")):
        got = by_symbol(fn(holed, ["close"]), "close")
        for s in "AB":
            pdf = series_of(bars_pdf, s)
            close = pdf["close"].where(pd.to_datetime(pdf["date"]).dt.day % 3 != 0)
            same(got[s], getattr(close, name)())


def test_a_column_without_any_value_is_filled_with_zero(bars):
    empty = features.forward_return(bars).withColumn("x", F.lit(None).cast("double"))
    assert fill.clean(empty).where(F.col("x") != 0).count() == 0


def panel_of(spark, n, symbol="A"):
    return spark.range(n).select(
        F.lit(symbol).alias("symbol"), F.date_add(F.lit("2014-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        F.col("id").cast("double").alias("x"),
    )


def test_published_split_and_sequence_sizes(spark):
    df = split.chrono_split(panel_of(spark, 2511))
    sizes = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert sizes == {"train": 1757, "val": 376, "test": 378}
    found = split.sequences(df, ["x"], 20).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in found}["val"] == 357


def test_date_split_puts_each_date_in_one_part(spark):
    df = panel_of(spark, 100).unionByName(panel_of(spark, 60, "B"))
    parts = split.chrono_split(df, mode="date")
    assert parts.groupBy("date").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    ends = {r["split"]: (r["lo"], r["hi"]) for r in parts.groupBy("split").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).collect()}
    assert ends["train"][1] < ends["val"][0] and ends["val"][1] < ends["test"][0]


def test_folds_are_contiguous_and_even(spark):
    pdf = split.time_folds(panel_of(spark, 11), 3).orderBy("date").toPandas()
    assert pdf["fold"].tolist() == [0] * 4 + [1] * 4 + [2] * 3
