"""Daily bars: declared schema, file scan, and aggregation of trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_COLUMNS = ("open", "high", "low", "close", "volume")
INDICATOR_COLUMNS = (
    "rsi_7", "rsi_14", "cci_7", "cci_14", "sma_50", "ema_50", "sma_100", "ema_100",
    "macd", "bollinger", "atr_7", "atr_14", "true_range",
)


def bar_schema(indicators: bool = False) -> T.StructType:
    """Schema of a bar file; ``indicators`` adds the indicator columns."""
    schema = T.StructType().add("symbol", T.StringType()).add("date", T.DateType())
    for name in PRICE_COLUMNS + (INDICATOR_COLUMNS if indicators else ()):
        schema = schema.add(name, T.DoubleType())
    return schema


def without_nan(df: DataFrame) -> DataFrame:
    """NaN read from a file becomes NULL: a panel knows one kind of missing value."""
    cleaned = {
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(cleaned) if cleaned else df


def read_bars(spark: SparkSession, path: str, fmt: str = "csv", indicators: bool = False) -> DataFrame:
    """Scan bars with a declared schema (no inference pass).  Order is not part of the result."""
    reader = spark.read.schema(bar_schema(indicators))
    if fmt == "csv":
        reader = reader.option("header", True).option("dateFormat", "yyyy-MM-dd").option("mode", "FAILFAST")
    return without_nan(reader.format(fmt).load(path))


def bars_from_trades(
    trades: DataFrame,
    symbol: Column,
    ts: Column,
    price: Column,
    quantity: Column,
    tiebreak: Sequence[Column],
    partitions: int | None = None,
) -> DataFrame:
    """Daily open/high/low/close/volume per symbol.

    First and last trade of a day are taken by ``(ts, *tiebreak)``; the tie-break has to make
    that order total.  All five aggregates combine map-side, so a symbol holding a large part
    of the trades still shuffles at most one row per date and input partition.

    Many symbols with hardly more than a trade a day gain nothing from that.  With ``partitions`` their trades are
    spread by symbol as they are, in the only exchange that bars and windows by series need; a symbol's trades are
    sorted in one task.
    """
    if partitions:
        trades = trades.repartition(partitions, symbol.cast("string"))
    order = F.struct(ts.alias("ts"), *[c.alias(f"t{i}") for i, c in enumerate(tiebreak)])
    rows = trades.select(
        symbol.cast("string").alias("symbol"),
        ts.cast("date").alias("date"),
        price.cast("double").alias("price"),
        quantity.cast("double").alias("quantity"),
        order.alias("at"),
    )
    return rows.groupBy("symbol", "date").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum("quantity").alias("volume"),
    )


def write_sorted(df: DataFrame, path: str) -> None:
    """Write a panel as Parquet, each series in one file and in time order."""
    df.repartition("symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").parquet(path)
