"""The feature table of series that outgrow a task: every stage works on time blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.windows import SERIES
from barline.operators import features, indicators
from barline.operators.blocks import Blocks


def indicator_blocks(bars: DataFrame, block_rows: int = 4096, by: Sequence[str] = SERIES, order: str = "date", grain: str = "month") -> Blocks:
    """Bars with the columns of :func:`indicators.add_indicators`: exponential means are carried, the rest has halos."""
    cut = Blocks(bars, block_rows, by, order, grain).stored().exponential_means("close", indicators.SPANS)
    cut = cut.then(lambda df: df.withColumn("macd", F.col("ema_12") - F.col("ema_26")).drop("ema_12", "ema_26"))
    return cut.windowed(indicators.windowed_indicators, indicators.LOOKBACK, 0)


def clean_features(bars: DataFrame, block_rows: int = 4096, by: Sequence[str] = SERIES, order: str = "date", grain: str = "month") -> DataFrame:
    """The rich feature table, labelled and filled, as ``fill.clean(features.feature_table(add_indicators(bars)))`` gives it."""
    cut = indicator_blocks(bars, block_rows, by, order, grain)
    return cut.windowed(features.feature_table, features.LOOKBACK, features.LOOKAHEAD).stored().clean().rows()
