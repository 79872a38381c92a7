"""Panels built from the driver's tables, in Spark and in SQL.

``supplier`` panels have one series per supplier and grow with the data; ``flag`` panels have
three dense series, each holding a third of all trades.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.windows import by_series
from barline.operators import features, fill, split
from barline.operators.features import MOMENTUM_PERIODS, VOLATILITY_WINDOWS, WINDOWS
from barline.operators.indicators import add_indicators
from barline.session import materialise
from barline.sources.bars import bars_from_trades

TIEBREAK = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
SYMBOLS = {"supplier": "l_suppkey", "flag": "l_returnflag"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_STORED: dict[tuple[str, str, str], object] = {}


def once(spark, sf, name, make):
    """What several queries of a session read is made and written once."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def bars(spark: SparkSession, sf: str, panel: str = "supplier") -> DataFrame:
    """Bars spread by series, ready for window stages.

    A supplier has about one trade a day, so its trades are spread once; a flag's, a third of all, are summed first.
    """
    trades = table(spark, sf, "lineitem")
    if panel == "supplier":
        return lineitem_bars(trades, SYMBOLS[panel], int(spark.conf.get("spark.sql.shuffle.partitions")))
    return by_series(lineitem_bars(trades, SYMBOLS[panel]))


def lineitem_bars(trades: DataFrame, symbol: str, partitions: int | None = None) -> DataFrame:
    return bars_from_trades(
        trades,
        F.col(symbol),
        F.col("l_shipdate"),
        F.try_divide("l_extendedprice", "l_quantity"),
        F.col("l_quantity"),
        [F.col(c) for c in TIEBREAK],
        partitions,
    )


def indicators(spark: SparkSession, sf: str, panel: str = "supplier") -> DataFrame:
    return add_indicators(bars(spark, sf, panel))


def feature_panel(spark: SparkSession, sf: str, panel: str = "supplier") -> DataFrame:
    return features.feature_table(indicators(spark, sf, panel))


def stored_indicators(spark: SparkSession, sf: str, panel: str = "supplier") -> DataFrame:
    """Indicators of bars that are written once, for plans that are run more than once."""
    return add_indicators(materialise(bars(spark, sf, panel)))


def split_panel(spark: SparkSession, sf: str, panel: str = "supplier", mode: str = "position") -> DataFrame:
    """Cleaned features with a split column."""
    return split.chrono_split(fill.clean(feature_panel(spark, sf, panel)), mode=mode)


# --- SQL ----------------------------------------------------------------------------------


def bars_sql(symbol: str = "l_suppkey", source: str = "lineitem") -> str:
    order = ", ".join(("l_shipdate", *TIEBREAK))
    return f"""bars AS (
  SELECT CAST({symbol} AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
         first(price ORDER BY {order}) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY {order}) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / nullif(l_quantity, 0) AS price FROM {source})
  GROUP BY 1, 2)"""


def rows(n: int, partition: str = "symbol") -> str:
    return f"(PARTITION BY {partition} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


SERIES = "(PARTITION BY symbol ORDER BY date)"
SQL_STATS = {
    "mean": "avg", "std": "stddev_samp", "max": "max", "min": "min", "skew": "skewness", "kurt": "kurtosis",
    "sum": "sum",
}


def rolling_sql(x: str, stat: str, n: int, partition: str = "symbol") -> str:
    w = rows(n, partition)
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {SQL_STATS[stat]}({x}) OVER {w} END"


def change_sql(x: str, k: int) -> str:
    return f"{x} / nullif(lag({x}, {k}) OVER {SERIES}, 0) - 1"


def _ema_sql(n: int) -> str:
    q = f"(CAST({n - 1} AS DOUBLE) / {n + 1})"
    so_far = "(PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)"
    return f"sum(close * pow({q}, -i)) OVER {so_far} / sum(pow({q}, -i)) OVER {so_far}"


def indicators_sql() -> str:
    """CTEs ``i1``..``ind``: bars with indicators."""
    return f"""i1 AS (
  SELECT *, row_number() OVER {SERIES} - 1 AS i, close - lag(close) OVER {SERIES} AS move,
         (high + low + close) / 3 AS tp,
         greatest(high - low, abs(high - lag(close) OVER {SERIES}), abs(low - lag(close) OVER {SERIES})) AS true_range
  FROM bars),
i2 AS (
  SELECT *, CASE WHEN move IS NOT NULL THEN greatest(move, 0) END AS gain, abs(move) AS size,
         {_ema_sql(12)} AS ema_12, {_ema_sql(26)} AS ema_26, {_ema_sql(50)} AS ema_50, {_ema_sql(100)} AS ema_100,
         {rolling_sql('tp', 'mean', 7)} AS mid_7, {rolling_sql('tp', 'mean', 14)} AS mid_14,
         list(tp) OVER {rows(7)} AS tps_7, list(tp) OVER {rows(14)} AS tps_14
  FROM i1),
ind AS (
  SELECT symbol, date, open, high, low, close, volume, true_range, ema_50, ema_100, ema_12 - ema_26 AS macd,
         100 * ({rolling_sql('gain', 'sum', 7)}) / nullif({rolling_sql('size', 'sum', 7)}, 0) AS rsi_7,
         100 * ({rolling_sql('gain', 'sum', 14)}) / nullif({rolling_sql('size', 'sum', 14)}, 0) AS rsi_14,
         (tp - mid_7) / nullif(0.015 * list_sum([abs(x - mid_7) FOR x IN tps_7]) / 7, 0) AS cci_7,
         (tp - mid_14) / nullif(0.015 * list_sum([abs(x - mid_14) FOR x IN tps_14]) / 14, 0) AS cci_14,
         {rolling_sql('close', 'mean', 50)} AS sma_50, {rolling_sql('close', 'mean', 100)} AS sma_100,
         ({rolling_sql('close', 'mean', 20)}) + 2 * ({rolling_sql('close', 'std', 20)}) AS bollinger,
         {rolling_sql('true_range', 'mean', 7)} AS atr_7, {rolling_sql('true_range', 'mean', 14)} AS atr_14
  FROM i2)"""


PRICE_SHAPE_SQL = {
    "daily_range": "(high - low) / nullif(close, 0)",
    "open_close_ratio": "close / nullif(open, 0)",
    "high_close_ratio": "high / nullif(close, 0)",
    "low_close_ratio": "low / nullif(close, 0)",
}
MA_DISTANCE_SQL = {
    **{f"close_to_{m.replace('_', '')}": f"(close - {m}) / nullif({m}, 0)" for m in features.MOVING_AVERAGES},
    "sma_cross": "(sma_50 - sma_100) / nullif(sma_100, 0)",
}
BOLLINGER_SQL = {
    "bollinger_position": "(close - bollinger) / nullif(bollinger, 0)",
    "bollinger_width": "bollinger / nullif(close, 0)",
}
SPREAD_SQL = {"rsi_diff": "rsi_14 - rsi_7", "cci_diff": "cci_14 - cci_7", "atr_diff": "atr_14 - atr_7"}
MOTION_SQL = {
    **{f"{n.split('_')[0]}_momentum": f"{n} - lag({n}) OVER {SERIES}" for n in ("rsi_14", "cci_14", "macd", "atr_14")},
    "rsi_ma5": rolling_sql("rsi_14", "mean", 5),
    "macd_ma5": rolling_sql("macd", "mean", 5),
}
CALENDAR_SQL = {
    "month": "month(date)",
    "dayofweek": "isodow(date) - 1",
    "quarter": "quarter(date)",
    "day": "day(date)",
    "week": "weekofyear(date)",
    "is_month_start": "(date = date_trunc('month', date))::INT",
    "is_month_end": "(date = last_day(date))::INT",
    "is_quarter_start": "(date = date_trunc('quarter', date))::INT",
    "is_quarter_end": "(date + 1 = date_trunc('quarter', date + 1))::INT",
}
RETURN_SQL = {
    "return": change_sql("close", 1),
    "log_return": f"ln(nullif(close / nullif(lag(close) OVER {SERIES}, 0), 0))",
    "volume_change": change_sql("volume", 1),
}
LABEL_SQL = {"next_5day_return": f"lead(close, 5) OVER {SERIES} / nullif(close, 0) - 1"}
MOMENTUM_SQL = {
    **{f"price_momentum_{k}": change_sql("close", k) for k in MOMENTUM_PERIODS},
    **{f"volume_momentum_{k}": change_sql("volume", k) for k in MOMENTUM_PERIODS},
}
RATIO_SQL = {
    f"volatility_ratio_{n}": f"volatility_{n} / nullif(volatility_20, 0)" for n in VOLATILITY_WINDOWS if n != 20
}
CROSS_SQL = {
    "price_volume_corr": "close * volume",
    "volatility_volume": "volatility_20 * volume",
    "rsi_volume": "rsi_14 * volume",
}


def lag_sql(x: str, ks=features.LAGS) -> dict[str, str]:
    return {f"{x}_lag{k}": f'lag("{x}", {k}) OVER {SERIES}' for k in ks}


def rolling_columns_sql(x: str, stat: str, windows=WINDOWS) -> dict[str, str]:
    return {f"{x}_{stat}_{n}": rolling_sql(f'"{x}"', stat, n) for n in windows}


def added(cte: str, source: str, columns: dict[str, str]) -> str:
    """A CTE that adds columns to another."""
    listed = ",\n         ".join(f'{e} AS "{n}"' for n, e in columns.items())
    return f"{cte} AS (\n  SELECT *, {listed}\n  FROM {source})"


def features_sql() -> str:
    """CTEs ``f1``..``feat``: the rich feature table on ``ind``."""
    first = {
        **LABEL_SQL, **PRICE_SHAPE_SQL, **RETURN_SQL, **lag_sql("close"), **MOMENTUM_SQL, **MA_DISTANCE_SQL,
        **BOLLINGER_SQL, **SPREAD_SQL, **MOTION_SQL, **CALENDAR_SQL,
    }
    for stat in ("max", "min", "mean"):
        first.update(rolling_columns_sql("close", stat))
    first.update(rolling_columns_sql("volume", "mean"))
    second = lag_sql("return")
    for stat in ("mean", "std"):
        second.update(rolling_columns_sql("return", stat))
    for stat in ("skew", "kurt"):
        second.update(rolling_columns_sql("return", stat, [n for n in WINDOWS if n >= 5]))
    second.update({f"volatility_{n}": rolling_sql('"return"', "std", n) for n in VOLATILITY_WINDOWS})
    return ",\n".join(
        [added("f1", "ind", first), added("f2", "f1", second), added("feat", "f2", {**RATIO_SQL, **CROSS_SQL})]
    )


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
