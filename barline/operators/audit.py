"""Data audit and exploration of a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.windows import SERIES, series
from barline.operators.columns import column_quantiles
from barline.operators.features import LABEL
from barline.operators.profile import bin_counts, corr_matrix, label_correlations, per_feature, shapes_and_first_digits

# Levels of the oscillator and the outlier fence.
OVERBOUGHT, OVERSOLD, FENCE, HIGH_CORRELATION = 70, 30, 1.5, 0.95


def quality_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs and value range per column."""
    return per_feature(
        df,
        columns,
        {
            "n_rows": lambda c: F.count(F.lit(1)),
            "n_null": lambda c: F.count_if(F.col(c).isNull()),
            "low": lambda c: F.min(F.col(c).cast("double")),
            "high": lambda c: F.max(F.col(c).cast("double")),
        },
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def date_gaps(df: DataFrame, longer_than: int = 1, by: Sequence[str] = SERIES) -> DataFrame:
    """Steps between consecutive dates of a series longer than a number of days."""
    previous = F.lag("date", 1).over(series(by))
    gaps = df.select(*by, "date", previous.alias("previous"), F.date_diff("date", previous).alias("days"))
    return gaps.where(F.col("days") > longer_than)


def iqr_bounds(df: DataFrame, columns: Sequence[str], fence: float = FENCE, written: bool = False) -> DataFrame:
    """Outlier bounds of each feature from its exact quartiles; ``written`` as in :func:`column_quantiles`."""
    found = column_quantiles(df, columns, {"q1": 0.25, "q3": 0.75}, written)
    reach = (F.col("q3") - F.col("q1")) * fence
    return found.select("feature", "q1", "q3", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def iqr_outliers(df: DataFrame, columns: Sequence[str], fence: float = FENCE, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Values outside their feature's bounds.

    The bounds, two numbers for each feature, are part of the plan, and a row is repeated only for its own outliers. The
    rows are read four times and not written: many columns made of few take more disk than the time to make them again.
    """
    rows = df.select(*keys, *columns)
    bounds = {r["feature"]: (r["low"], r["high"]) for r in iqr_bounds(rows, columns, fence, written=True).collect() if r["low"] is not None}

    def flagged(c: str) -> Column:
        value, (low, high) = F.col(c).cast("double"), bounds[c]
        side = F.when(value < F.lit(low), "low").when(value > F.lit(high), "high")
        return F.when(side.isNotNull(), F.struct(F.lit(c).alias("feature"), value.alias("value"), side.alias("side")))

    if not bounds:
        return rows.limit(0).select(*keys, F.lit("").alias("feature"), F.lit(0.0).alias("value"), F.lit("").alias("side"))
    found = F.explode(F.array_compact(F.array(*[flagged(c) for c in columns if c in bounds])))
    return rows.select(*keys, found.alias("_found")).select(*keys, "_found.*")


def correlated_groups(df: DataFrame, columns: Sequence[str], limit: float = HIGH_CORRELATION) -> DataFrame:
    """Pairs of features with an absolute correlation above ``limit``."""
    return corr_matrix(df, columns).where(F.abs("r") > limit)


def label_ranking(df: DataFrame, columns: Sequence[str], label: str = LABEL) -> DataFrame:
    """Signed correlation of each feature with the label, strongest first."""
    rows = label_correlations(df, columns, label)
    return rows.withColumn(
        "place", F.row_number().over(Window.orderBy(F.abs("r").desc_nulls_last(), "feature"))
    )


def signals(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Overbought and oversold rows, and rows where MACD crosses zero."""
    before = F.lag("macd", 1).over(series(by))
    return df.withColumns(
        {
            "rsi_signal": F.when(F.col("rsi_14") > OVERBOUGHT, "overbought").when(F.col("rsi_14") < OVERSOLD, "oversold"),
            "macd_cross": F.when((before <= 0) & (F.col("macd") > 0), "up").when(
                (before >= 0) & (F.col("macd") < 0), "down"
            ),
        }
    )


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, skewness and exact quartiles per feature.

    The rows are read three times and not written, as in :func:`iqr_outliers`.
    """
    found, first = shapes_and_first_digits(df, columns)
    quarts = column_quantiles(df, columns, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}, True, first)
    return found.join(F.broadcast(quarts.drop("n")), "feature")  # one row per feature


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bin counts per feature."""
    return bin_counts(df, columns, bins).select("feature", F.col("bx").alias("bin"), "n")
