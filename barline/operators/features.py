"""Feature columns of a panel.

Each group of features is a mapping ``name -> Column``; a public operator adds one group and
:func:`feature_table` adds all of them in a few projections over one shared window order, so a
panel is exchanged and sorted once.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.rows import Series, divided, with_series
from barline.functions.windows import SERIES, rolled, rolled_names, rolling_stat, rolling_windows, series

LABEL = "next_5day_return"
KEYS = ("symbol", "date")

# Look-back lengths of the feature set.
LAGS = (1, 2, 3, 5, 7, 10, 15, 20, 30)
WINDOWS = (3, 5, 7, 10, 15, 20, 30, 60)
VOLATILITY_WINDOWS = (3, 5, 10, 20, 30)
MOMENTUM_PERIODS = (3, 5, 7, 10, 15, 20, 30)
MOVING_AVERAGES = ("sma_50", "sma_100", "ema_50", "ema_100")
# The lean feature set.
LEAN_LAGS = (5, 10, 15, 20)
LEAN_WINDOWS = (5, 10, 20, 30)
LEAN_VOLATILITY = (5, 10, 20)
LEAN_MOMENTUM = (5, 10, 20)
LEAN_INDICATORS = ("rsi_14", "macd", "cci_14", "atr_14")
LEAN_AVERAGES = ("sma_50", "sma_100")
LEAN_CALENDAR = ("month", "dayofweek", "quarter")
LEAN_DROPPED = ("open", "high", "low", "close", "return")
LEAN_DERIVED = (*LEAN_CALENDAR, *[f"volatility_{n}" for n in LEAN_VOLATILITY])  # what a stored lean table need not hold

# Rows a feature looks back (60 returns, each from two closes) and the label looks ahead.
LOOKBACK, LOOKAHEAD = max(WINDOWS), 5

Columns = Mapping[str, Column]


def _over(numerator: str, denominator: str) -> Column:
    return F.try_divide(F.col(numerator), F.col(denominator))


def _gap(value: str, base: str) -> Column:
    return F.try_divide(F.col(value) - F.col(base), F.col(base))


def _change(column: str, k: int, by: Sequence[str]) -> Column:
    return F.try_divide(F.col(column), F.lag(column, k).over(series(by))) - 1


def price_shape_columns() -> Columns:
    return {
        "daily_range": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
        "open_close_ratio": _over("close", "open"),
        "high_close_ratio": _over("high", "close"),
        "low_close_ratio": _over("low", "close"),
    }


def ma_distance_columns(averages: Iterable[str] = MOVING_AVERAGES) -> Columns:
    return {f"close_to_{name.replace('_', '')}": _gap("close", name) for name in averages}


def sma_cross_columns() -> Columns:
    return {"sma_cross": _gap("sma_50", "sma_100")}


def bollinger_columns() -> Columns:
    return {"bollinger_position": _gap("close", "bollinger"), "bollinger_width": _over("bollinger", "close")}


def spread_columns() -> Columns:
    return {
        "rsi_diff": F.col("rsi_14") - F.col("rsi_7"),
        "cci_diff": F.col("cci_14") - F.col("cci_7"),
        "atr_diff": F.col("atr_14") - F.col("atr_7"),
    }


def cross_columns() -> Columns:
    return {
        "price_volume_corr": F.col("close") * F.col("volume"),
        "volatility_volume": F.col("volatility_20") * F.col("volume"),
        "rsi_volume": F.col("rsi_14") * F.col("volume"),
    }


def volatility_ratio_columns(windows: Iterable[int] = VOLATILITY_WINDOWS) -> Columns:
    return {f"volatility_ratio_{n}": _over(f"volatility_{n}", "volatility_20") for n in windows if n != 20}


def calendar_columns() -> Columns:
    date = F.col("date")
    return {
        "month": F.month(date),
        "dayofweek": F.weekday(date),
        "quarter": F.quarter(date),
        "day": F.dayofmonth(date),
        "week": F.weekofyear(date),
        "is_month_start": (date == F.trunc(date, "month")).cast("int"),
        "is_month_end": (date == F.last_day(date)).cast("int"),
        "is_quarter_start": (date == F.trunc(date, "quarter")).cast("int"),
        "is_quarter_end": (F.date_add(date, 1) == F.trunc(F.date_add(date, 1), "quarter")).cast("int"),
    }


def label_columns(horizon: int = 5, by: Sequence[str] = SERIES) -> Columns:
    return {f"next_{horizon}day_return": F.try_divide(F.lead("close", horizon).over(series(by)), F.col("close")) - 1}


def return_columns(by: Sequence[str] = SERIES) -> Columns:
    previous = F.lag("close", 1).over(series(by))
    return {
        "return": _change("close", 1, by),
        "log_return": F.log(F.try_divide(F.col("close"), previous)),
        "volume_change": _change("volume", 1, by),
    }


def lag_columns(column: str, ks: Iterable[int] = LAGS, by: Sequence[str] = SERIES) -> Columns:
    w = series(by)
    return {f"{column}_lag{k}": F.lag(column, k).over(w) for k in ks}


def indicator_motion_columns(names: Iterable[str], by: Sequence[str] = SERIES) -> Columns:
    """First differences; ``rsi_14`` gives ``rsi_momentum``."""
    return {f"{n.split('_')[0]}_momentum": F.col(n) - F.lag(n, 1).over(series(by)) for n in names}


def indicator_mean_columns(by: Sequence[str] = SERIES) -> Columns:
    return {
        "rsi_ma5": rolling_stat(F.col("rsi_14"), "mean", 5, by),
        "macd_ma5": rolling_stat(F.col("macd"), "mean", 5, by),
    }


def momentum_columns(periods: Iterable[int] = MOMENTUM_PERIODS, by: Sequence[str] = SERIES) -> Columns:
    price = {f"price_momentum_{k}": _change("close", k, by) for k in periods}
    return price | {f"volume_momentum_{k}": _change("volume", k, by) for k in periods}


def volatility_columns(windows: Iterable[int] = VOLATILITY_WINDOWS, by: Sequence[str] = SERIES) -> Columns:
    return {f"volatility_{n}": rolling_stat(F.col("return"), "std", n, by) for n in windows}


# --- one group at a time ------------------------------------------------------------------


def price_shape(df: DataFrame) -> DataFrame:
    """Intraday range and close/open, high/close, low/close ratios."""
    return df.withColumns(dict(price_shape_columns()))


def ma_distance(df: DataFrame, averages: Iterable[str] = MOVING_AVERAGES) -> DataFrame:
    """Relative distance of the close to each moving average, and of the two simple ones to each other."""
    return df.withColumns({**ma_distance_columns(averages), **sma_cross_columns()})


def bollinger_features(df: DataFrame) -> DataFrame:
    """Close relative to the band, and band relative to the close."""
    return df.withColumns(dict(bollinger_columns()))


def indicator_spread(df: DataFrame) -> DataFrame:
    """Long minus short version of RSI, CCI and ATR."""
    return df.withColumns(dict(spread_columns()))


def calendar_features(df: DataFrame) -> DataFrame:
    """Calendar parts (Monday = 0) and calendar-day flags."""
    return df.withColumns(dict(calendar_columns()))


def forward_value(df: DataFrame, column: str, steps: int, name: str, by: Sequence[str] = SERIES) -> DataFrame:
    """Value of ``column`` a number of rows ahead; NULL at the end of a series."""
    return df.withColumn(name, F.lead(column, steps).over(series(by)))


def forward_return(df: DataFrame, horizon: int = 5, by: Sequence[str] = SERIES) -> DataFrame:
    """Return over the next ``horizon`` rows, the label of every model."""
    return df.withColumns(dict(label_columns(horizon, by)))


def returns(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """One-row return, log return and volume change."""
    return df.withColumns(dict(return_columns(by)))


def lags(df: DataFrame, columns: Iterable[str], ks: Iterable[int] = LAGS, by: Sequence[str] = SERIES) -> DataFrame:
    """Values a number of rows back."""
    ks = tuple(ks)
    return df.withColumns({n: c for col in columns for n, c in lag_columns(col, ks, by).items()})


def rolling(
    df: DataFrame,
    column: str,
    stats: str | Sequence[str],
    windows: Iterable[int] = WINDOWS,
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Trailing ``mean``, ``std``, ``max``, ``min``, ``skew`` or ``kurt``; NULL unless the window is full.

    Skewness and kurtosis need four rows or more.
    """
    stats = (stats,) if isinstance(stats, str) else tuple(stats)
    return rolling_windows(df, {column: (stats, tuple(windows))}, by)


def indicator_motion(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """First differences and five-row means of the indicators."""
    names = ("rsi_14", "cci_14", "macd", "atr_14")
    return df.withColumns({**indicator_motion_columns(names, by), **indicator_mean_columns(by)})


def momentum(df: DataFrame, periods: Iterable[int] = MOMENTUM_PERIODS, by: Sequence[str] = SERIES) -> DataFrame:
    """Relative change of close and volume over several periods."""
    return df.withColumns(dict(momentum_columns(tuple(periods), by)))


def volatility(df: DataFrame, windows: Iterable[int] = VOLATILITY_WINDOWS, by: Sequence[str] = SERIES) -> DataFrame:
    """Trailing standard deviation of the return and its ratio to the 20-row one."""
    windows = tuple(windows)
    return df.withColumns(dict(volatility_columns(windows, by))).withColumns(dict(volatility_ratio_columns(windows)))


def cross_features(df: DataFrame) -> DataFrame:
    """Products of price, volatility and RSI with volume."""
    return df.withColumns(dict(cross_columns()))


# --- the whole table ----------------------------------------------------------------------


MOTIONS = ("rsi_14", "cci_14", "macd", "atr_14")
ROLLED = {"close": ("max", "min", "mean"), "volume": ("mean",), "return": ("mean", "std", "skew", "kurt")}


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return divided(a, b) - 1


def table_values(series: Series, columns: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The columns of the rich feature table that look along a series."""
    close, volume = columns["close"], columns["volume"]
    lagged = {k: series.lag(close, k) for k in {*LAGS, *MOMENTUM_PERIODS}}
    moved = divided(close, lagged[1])
    back = moved - 1
    means = rolled(series, columns, {"rsi_14": (("mean",), (5,)), "macd": (("mean",), (5,))})
    return {
        LABEL: _ratio(series.lag(close, -LOOKAHEAD), close),
        "return": back,
        "log_return": np.log(np.where(moved > 0, moved, np.nan)),
        "volume_change": _ratio(volume, series.lag(volume, 1)),
        **{f"close_lag{k}": lagged[k] for k in LAGS},
        **{f"{n.split('_')[0]}_momentum": columns[n] - series.lag(columns[n], 1) for n in MOTIONS},
        "rsi_ma5": means["rsi_14_mean_5"],
        "macd_ma5": means["macd_mean_5"],
        **{f"price_momentum_{k}": _ratio(close, lagged[k]) for k in MOMENTUM_PERIODS},
        **{f"volume_momentum_{k}": _ratio(volume, series.lag(volume, k)) for k in MOMENTUM_PERIODS},
        **{f"return_lag{k}": series.lag(back, k) for k in LAGS},
        **rolled(series, {"close": close, "volume": volume, "return": back}, {c: (stats, WINDOWS) for c, stats in ROLLED.items()}),
    }


def feature_table(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """The rich feature set: 139 columns, the label among them, on bars with indicators.

    The columns that look along a series come from one pass over it, the others are projections of these.
    """
    first = {
        **price_shape_columns(), **ma_distance_columns(), **sma_cross_columns(), **bollinger_columns(), **spread_columns(), **calendar_columns(),
    }
    momenta = [*[f"price_momentum_{k}" for k in MOMENTUM_PERIODS], *[f"volume_momentum_{k}" for k in MOMENTUM_PERIODS]]
    motions = [*[f"{n.split('_')[0]}_momentum" for n in MOTIONS], "rsi_ma5", "macd_ma5"]
    windows = rolled_names({c: (stats, WINDOWS) for c, stats in ROLLED.items()})
    # The volatility of a window is the rolling deviation already computed.
    volatility = {f"volatility_{n}": F.col(f"return_std_{n}") for n in VOLATILITY_WINDOWS}
    last = {**volatility_ratio_columns(), **cross_columns()}
    names = [
        LABEL, *price_shape_columns(), "return", "log_return", "volume_change", *[f"close_lag{k}" for k in LAGS], *ma_distance_columns(),
        *sma_cross_columns(), *bollinger_columns(), *spread_columns(), *motions, *calendar_columns(), *momenta,
        *[f"return_lag{k}" for k in LAGS], *windows, *volatility, *last,
    ]
    along = [n for n in names if n not in {*first, *volatility, *last}]
    columns = list(dict.fromkeys([*df.columns, *names]))
    found = with_series(df, ("close", "volume", *MOTIONS), along, table_values, by)
    return found.withColumns({**first, **volatility}).withColumns(last).select(*columns)


def lean_feature_table(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """The lean feature set; indicators missing from the input are left out.  Rows with a NULL go."""
    present = [n for n in LEAN_INDICATORS if n in df.columns]
    wanted = {"return": (("mean", "std"), LEAN_WINDOWS)}

    def values(series: Series, columns: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
        close = columns["close"]
        back = _ratio(close, series.lag(close, 1))
        return {
            LABEL: _ratio(series.lag(close, -LOOKAHEAD), close),
            "return": back,
            **{f"{n}_momentum": columns[n] - series.lag(columns[n], 1) for n in present},
            **{f"price_momentum_{k}": _ratio(close, series.lag(close, k)) for k in LEAN_MOMENTUM},
            **{f"return_lag{k}": series.lag(back, k) for k in LEAN_LAGS},
            **rolled(series, {"return": back}, wanted),
        }

    averages = ma_distance_columns([n for n in LEAN_AVERAGES if n in df.columns])
    momenta = [f"price_momentum_{k}" for k in LEAN_MOMENTUM]
    names = [
        LABEL, "return", *[f"{n}_momentum" for n in present], *averages, *momenta, *LEAN_CALENDAR,
        *[f"return_lag{k}" for k in LEAN_LAGS], *rolled_names(wanted), *[f"volatility_{n}" for n in LEAN_VOLATILITY],
    ]
    along = [n for n in names if n not in {*averages, *LEAN_DERIVED}]
    columns = list(dict.fromkeys([*df.columns, *names]))
    found = with_series(df, ("close", *present), along, values, by)
    return with_lean_derived(found.withColumns(averages)).select(*columns).dropna("any")


def with_lean_derived(df: DataFrame) -> DataFrame:
    """Adds ``LEAN_DERIVED``: parts of the date, and the volatility of a window, which is the rolling deviation already computed."""
    calendar = {n: c for n, c in calendar_columns().items() if n in LEAN_CALENDAR}
    return df.withColumns({**calendar, **{f"volatility_{n}": F.col(f"return_std_{n}") for n in LEAN_VOLATILITY}})


def feature_columns(df: DataFrame, dropped: Iterable[str] = ()) -> list[str]:
    """Model inputs: every column but keys, split, whatever is dropped, and anything forward-looking."""
    excluded = {*KEYS, "split", "fold", *dropped}
    return [c for c in df.columns if c not in excluded and not c.startswith("next_")]
