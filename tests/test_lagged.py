"""Regression on sequences against the sequences written out."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import lagged, models
from barline.operators.partials import of_rows


def side_by_side(x, y, length):
    ends = [t for t in range(length - 1, len(x)) if not np.isnan(y[t]) and not np.isnan(x[t - length + 1 : t + 1]).any()]
    return np.array([np.append(x[t - length + 1 : t + 1].ravel(), y[t]) for t in ends]).reshape(len(ends), length * x.shape[1] + 1)


@pytest.mark.parametrize("n,k,length", [(30, 3, 5), (5, 2, 5), (9, 1, 2), (7, 4, 1), (40, 2, 20)])
def test_window_sums_equal_windows_written_out(n, k, length):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=(n, k)), rng.normal(size=n)
    y[[n - 1, n // 2]] = np.nan if n > 5 else y[[n - 1, n // 2]]
    want, got = of_rows(side_by_side(x, y, length)), lagged.window_sums(x, y, length)
    assert got[0] == want[0]
    np.testing.assert_allclose(got[1], want[1], atol=1e-12)
    np.testing.assert_allclose(got[2], want[2], atol=1e-10)
    assert lagged.window_sums(x[: length - 1], y[: length - 1], length) is None


@pytest.mark.parametrize("block_rows", [7, 16, 4096])
def test_sequence_moments_of_a_panel(spark, monkeypatch, block_rows):
    rng = np.random.default_rng(3)
    length, rows, want = 5, [], []
    for s, n in (("A", 60), ("B", 4), ("C", 23), ("D", 5)):
        x, y = rng.normal(size=(n, 2)), rng.normal(size=n)
        if s == "A":
            x[17, 0], y[40] = np.nan, np.nan
        want.append(side_by_side(x, y, length))
        rows += [(s, t, *(None if np.isnan(v) else float(v) for v in (*x[t], y[t]))) for t in range(n)]
    df = spark.createDataFrame(rows, "symbol string, t int, a double, b double, y double").withColumn("date", F.date_add(F.lit("2024-01-20").cast("date"), F.col("t")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    found = lagged.sequence_moments(df, ["a", "b"], length, "y", block_rows=block_rows)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    flat = np.concatenate(want)
    assert found.n == len(flat)
    np.testing.assert_allclose(found.mean, flat.mean(axis=0), atol=1e-12)
    np.testing.assert_allclose(found.corr, np.corrcoef(flat.T), atol=1e-10)
    assert found.columns[:3] == ["a_4", "b_4", "a_3"]
    assert lagged.sequence_moments(df.where("symbol = 'B'"), ["a", "b"], length, "y") is None


def test_weights_equal_the_fit_on_sequence_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(s, t, *map(float, rng.normal(size=3))) for s in "AB" for t in range(80)]
    df = spark.createDataFrame(rows, "symbol string, t int, a double, b double, y double")
    df = df.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t"))).withColumn("split", F.lit("train"))
    fitted = models.fit_sequence_linear(models.sequence_rows(df, ["a", "b"], 4, "y"), 3.0)
    scaled = models.Standardizer(["a", "b"]).fit(df).transform(df)
    rows = models.sequence_rows(df, ["a", "b"], 4, "y")
    weights, intercept = lagged.sequence_ridge(lagged.sequence_moments(scaled, ["a", "b"], 4, "y", block_rows=32), 3.0)
    np.testing.assert_allclose(weights, fitted.coefficients.toArray(), atol=1e-8)
    assert intercept == pytest.approx(fitted.intercept, abs=1e-8)
    want = {(r["symbol"], r["date"]): r["yhat"] for r in models.predict(fitted, rows, "m").collect()}
    got = {(r["symbol"], r["date"]): r["yhat"] for r in lagged.sequence_forecasts(scaled, ["a", "b"], weights, intercept, "m", "y").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_rows_in_order_need_no_exchange(spark):
    """Moments and forecasts of rows that lie series by series equal those of numbered and spread rows."""
    rng = np.random.default_rng(4)
    data = []
    for s, n in (("A", 40), ("B", 3), ("C", 25)):
        for i in range(n):
            part = "train" if i < n * 0.7 else "test"
            a = None if s == "C" and i == 20 else float(rng.normal())
            data.append((s, dt.date(2024, 1, 1) + dt.timedelta(days=i), part, a, float(rng.normal()), None if i == 9 else float(rng.normal())))
    df = spark.createDataFrame(data, f"symbol string, date date, split string, a double, b double, {lagged.LABEL} double").coalesce(1)
    df = df.sortWithinPartitions("symbol", "date")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        train = df.where("split = 'train'")
        found, want = (lagged.sequence_moments(train, ["a", "b"], 4, in_order=x) for x in (True, False))
        assert found.n == want.n and found.columns == want.columns
        np.testing.assert_allclose(found.corr, want.corr, atol=1e-12)
        np.testing.assert_allclose(found.mean, want.mean, atol=1e-12)
        fitted = lagged.sequence_ridge(want, 0.5)
        mine, theirs = (lagged.sequence_forecasts(df, ["a", "b"], *fitted, "M", in_order=x) for x in (True, False))
        assert mine.columns == theirs.columns and "Exchange" not in mine._jdf.queryExecution().executedPlan().toString()
        key = ["symbol", "date"]
        left, right = (x.toPandas().sort_values(key).reset_index(drop=True) for x in (mine, theirs))
        assert len(left) == len(right) > 20 and (left[["model", "split", *key]] == right[["model", "split", *key]]).all(axis=None)
        np.testing.assert_allclose(left[["y", "yhat"]].astype(float), right[["y", "yhat"]].astype(float), atol=1e-12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
