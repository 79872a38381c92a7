"""From trades to scored forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.windows import by_series
from barline.operators import evaluate, features, fill, split
from barline.operators.features import LABEL


def naive_forecasts(bars: DataFrame, window: int = 5) -> DataFrame:
    """Forecast the next five-row return by the mean return of the last ``window`` rows."""
    df = features.forward_return(features.returns(by_series(bars)))
    df = features.lags(df, ["return"], [1])
    for stat in ("mean", "std"):
        df = features.rolling(df, "return", stat, [window])
    rows = split.chrono_split(fill.drop_warmup(df))
    return rows.select(
        F.lit("Naive").alias("model"), "split", "symbol", "date",
        F.col(LABEL).alias("y"), F.col(f"return_mean_{window}").alias("yhat"),
    )


def naive_forecast_scores(bars: DataFrame, window: int = 5) -> DataFrame:
    """Scores of the naive forecast per symbol and split."""
    return evaluate.regression_metrics(naive_forecasts(bars, window), by=["symbol"])
