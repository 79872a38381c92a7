"""Bars, indicators, feature columns, fills and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.operators import blocks, features, fill, split
from barline.operators.features import LAGS, MOMENTUM_PERIODS, VOLATILITY_WINDOWS, WINDOWS
from barline.plans import long_series
from barline.sources.bars import INDICATOR_COLUMNS, PRICE_COLUMNS, bars_from_trades
from checks import panels as p
from checks.registry import fixed, fixed_sql, query, shaped, shaped_sql

KEYS = ("symbol", "date")
SUPPLIER = p.bars_sql("l_suppkey")
FLAG = p.bars_sql("l_returnflag")
MOMENTS = [n for n in WINDOWS if n >= 5]


def over_bars(columns: dict, digits, integers=()) -> str:
    return p.with_sql(SUPPLIER, p.added("x", "bars", columns)) + shaped_sql("x", KEYS, digits, integers)


def over_indicators(columns: dict, digits) -> str:
    return p.with_sql(SUPPLIER, p.indicators_sql(), p.added("x", "ind", columns)) + shaped_sql("x", KEYS, digits)


def over_returns(columns: dict, digits) -> str:
    steps = (SUPPLIER, p.added("r", "bars", p.RETURN_SQL), p.added("x", "r", columns))
    return p.with_sql(*steps) + shaped_sql("x", KEYS, digits)


# --- sources ------------------------------------------------------------------------------


@query(p.with_sql(SUPPLIER) + shaped_sql("bars", KEYS, PRICE_COLUMNS))
def bars_by_supplier(spark, sf):
    return shaped(p.lineitem_bars(p.table(spark, sf, "lineitem"), "l_suppkey"), KEYS, PRICE_COLUMNS)


@query(p.with_sql(FLAG) + shaped_sql("bars", KEYS, PRICE_COLUMNS))
def bars_by_return_flag(spark, sf):
    return shaped(p.lineitem_bars(p.table(spark, sf, "lineitem"), "l_returnflag"), KEYS, PRICE_COLUMNS)


@query(
    p.with_sql(p.bars_sql("p_brand", "lineitem JOIN part ON l_partkey = p_partkey"))
    + shaped_sql("bars", KEYS, PRICE_COLUMNS)
)
def bars_by_brand(spark, sf):
    part = p.table(spark, sf, "part").select("p_partkey", "p_brand")
    trades = p.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return shaped(p.lineitem_bars(trades, "p_brand"), KEYS, PRICE_COLUMNS)


@query(
    """WITH bars AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date,
         first(o_totalprice ORDER BY o_orderdate, o_orderkey, o_custkey, o_totalprice) AS open,
         max(o_totalprice) AS high, min(o_totalprice) AS low,
         last(o_totalprice ORDER BY o_orderdate, o_orderkey, o_custkey, o_totalprice) AS close, count(*) AS volume
  FROM orders GROUP BY 1, 2)
"""
    + shaped_sql("bars", KEYS, PRICE_COLUMNS)
)
def bars_by_order_priority(spark, sf):
    bars = bars_from_trades(
        p.table(spark, sf, "orders"),
        F.col("o_orderpriority"),
        F.col("o_orderdate"),
        F.col("o_totalprice"),
        F.lit(1),
        [F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")],
    )
    return shaped(bars, KEYS, PRICE_COLUMNS)


@query(
    """WITH bars AS (
  SELECT event_type AS symbol, CAST(ts AS DATE) AS date, first("value" ORDER BY ts, event_id, "value") AS open,
         max("value") AS high, min("value") AS low, last("value" ORDER BY ts, event_id, "value") AS close,
         count(*) AS volume
  FROM events GROUP BY 1, 2)
"""
    + shaped_sql("bars", KEYS, PRICE_COLUMNS)
)
def bars_by_event_type(spark, sf):
    bars = bars_from_trades(
        p.table(spark, sf, "events"),
        F.col("event_type"),
        F.col("ts"),
        F.col("value"),
        F.lit(1),
        [F.col("event_id"), F.col("value")],
    )
    return shaped(bars, KEYS, PRICE_COLUMNS)


INDICATOR_DIGITS = dict.fromkeys(INDICATOR_COLUMNS, 4)


@query(p.with_sql(SUPPLIER, p.indicators_sql()) + shaped_sql("ind", KEYS, INDICATOR_DIGITS))
def indicators(spark, sf):
    return shaped(p.indicators(spark, sf), KEYS, INDICATOR_DIGITS)


@query(p.with_sql(FLAG, p.indicators_sql()) + shaped_sql("ind", KEYS, INDICATOR_DIGITS))
def indicators_dense(spark, sf):
    return shaped(p.indicators(spark, sf, "flag"), KEYS, INDICATOR_DIGITS)


# --- projections --------------------------------------------------------------------------


@query(over_bars(p.PRICE_SHAPE_SQL, list(p.PRICE_SHAPE_SQL)))
def price_shape(spark, sf):
    return shaped(features.price_shape(p.bars(spark, sf)), KEYS, list(p.PRICE_SHAPE_SQL))


@query(over_indicators(p.MA_DISTANCE_SQL, list(p.MA_DISTANCE_SQL)))
def ma_distance(spark, sf):
    return shaped(features.ma_distance(p.indicators(spark, sf)), KEYS, list(p.MA_DISTANCE_SQL))


@query(over_indicators(p.BOLLINGER_SQL, list(p.BOLLINGER_SQL)))
def bollinger_features(spark, sf):
    return shaped(features.bollinger_features(p.indicators(spark, sf)), KEYS, list(p.BOLLINGER_SQL))


SPREAD_DIGITS = dict.fromkeys(p.SPREAD_SQL, 4)


@query(over_indicators(p.SPREAD_SQL, SPREAD_DIGITS))
def indicator_spread(spark, sf):
    return shaped(features.indicator_spread(p.indicators(spark, sf)), KEYS, SPREAD_DIGITS)


CROSS_DIGITS = dict.fromkeys(p.CROSS_SQL, 3)


@query(
    p.with_sql(
        SUPPLIER,
        p.indicators_sql(),
        p.added("r", "ind", p.RETURN_SQL),
        p.added("v", "r", {"volatility_20": p.rolling_sql('"return"', "std", 20)}),
        p.added("x", "v", p.CROSS_SQL),
    )
    + shaped_sql("x", KEYS, CROSS_DIGITS)
)
def cross_features(spark, sf):
    df = features.volatility(features.returns(p.indicators(spark, sf)))
    return shaped(features.cross_features(df), KEYS, CROSS_DIGITS)


@query(over_bars(p.CALENDAR_SQL, (), list(p.CALENDAR_SQL)))
def calendar_features(spark, sf):
    return shaped(features.calendar_features(p.bars(spark, sf)), KEYS, (), list(p.CALENDAR_SQL))


KEPT = ("open", "high", "low", "volume")


@query(p.with_sql(SUPPLIER) + shaped_sql("bars", (), KEPT))
def selected_feature_columns(spark, sf):
    df = features.forward_value(p.bars(spark, sf), "close", 1, "next_day_close")
    return shaped(df.select(features.feature_columns(df, dropped=("close",))), (), KEPT)


# --- windows ------------------------------------------------------------------------------


@query(over_bars(p.LABEL_SQL, list(p.LABEL_SQL)))
def forward_return(spark, sf):
    return shaped(features.forward_return(p.bars(spark, sf)), KEYS, list(p.LABEL_SQL))


@query(over_bars({"next_day_close": f"lead(close, 1) OVER {p.SERIES}"}, ["next_day_close"]))
def next_day_close(spark, sf):
    df = features.forward_value(p.bars(spark, sf), "close", 1, "next_day_close")
    return shaped(df, KEYS, ["next_day_close"])


@query(over_bars(p.RETURN_SQL, list(p.RETURN_SQL)))
def returns(spark, sf):
    return shaped(features.returns(p.bars(spark, sf)), KEYS, list(p.RETURN_SQL))


LAGGED = {**p.lag_sql("return"), **p.lag_sql("close")}


@query(over_returns(LAGGED, list(LAGGED)))
def lags(spark, sf):
    df = features.lags(features.returns(p.bars(spark, sf)), ("return", "close"), LAGS)
    return shaped(df, KEYS, list(LAGGED))


MEANS = {**p.rolling_columns_sql("return", "mean"), **p.rolling_columns_sql("close", "mean"),
         **p.rolling_columns_sql("volume", "mean")}
MEAN_DIGITS = dict.fromkeys(MEANS, 3)


@query(over_returns(MEANS, MEAN_DIGITS))
def rolling_means(spark, sf):
    df = features.returns(p.bars(spark, sf))
    for column in ("return", "close", "volume"):
        df = features.rolling(df, column, "mean", WINDOWS)
    return shaped(df, KEYS, MEAN_DIGITS)


DEVIATIONS = p.rolling_columns_sql("return", "std")
DEVIATION_DIGITS = dict.fromkeys(DEVIATIONS, 4)


@query(over_returns(DEVIATIONS, DEVIATION_DIGITS))
def rolling_deviations(spark, sf):
    df = features.rolling(features.returns(p.bars(spark, sf)), "return", "std", WINDOWS)
    return shaped(df, KEYS, DEVIATION_DIGITS)


SKEWS = p.rolling_columns_sql("return", "skew", MOMENTS)


@query(over_returns(SKEWS, dict.fromkeys(SKEWS, 4)))
def rolling_skewness(spark, sf):
    df = features.rolling(features.returns(p.bars(spark, sf)), "return", "skew", MOMENTS)
    return shaped(df, KEYS, dict.fromkeys(SKEWS, 4))


KURTS = p.rolling_columns_sql("return", "kurt", MOMENTS)


@query(over_returns(KURTS, dict.fromkeys(KURTS, 3)))
def rolling_kurtosis(spark, sf):
    df = features.rolling(features.returns(p.bars(spark, sf)), "return", "kurt", MOMENTS)
    return shaped(df, KEYS, dict.fromkeys(KURTS, 3))


EXTREMES = {**p.rolling_columns_sql("close", "max"), **p.rolling_columns_sql("close", "min")}


@query(over_bars(EXTREMES, list(EXTREMES)))
def rolling_extremes(spark, sf):
    df = features.rolling(p.bars(spark, sf), "close", "max", WINDOWS)
    return shaped(features.rolling(df, "close", "min", WINDOWS), KEYS, list(EXTREMES))


MOTION_DIGITS = dict.fromkeys(p.MOTION_SQL, 4)


@query(over_indicators(p.MOTION_SQL, MOTION_DIGITS))
def indicator_motion(spark, sf):
    return shaped(features.indicator_motion(p.indicators(spark, sf)), KEYS, MOTION_DIGITS)


VOLATILITY = {f"volatility_{n}": p.rolling_sql('"return"', "std", n) for n in VOLATILITY_WINDOWS}
VOLATILITY_DIGITS = dict.fromkeys([*VOLATILITY, *p.RATIO_SQL], 4)


@query(
    p.with_sql(SUPPLIER, p.added("r", "bars", p.RETURN_SQL), p.added("v", "r", VOLATILITY),
               p.added("x", "v", p.RATIO_SQL))
    + shaped_sql("x", KEYS, VOLATILITY_DIGITS)
)
def volatility(spark, sf):
    return shaped(features.volatility(features.returns(p.bars(spark, sf))), KEYS, VOLATILITY_DIGITS)


@query(over_bars(p.MOMENTUM_SQL, list(p.MOMENTUM_SQL)))
def momentum(spark, sf):
    return shaped(features.momentum(p.bars(spark, sf), MOMENTUM_PERIODS), KEYS, list(p.MOMENTUM_SQL))


# --- the feature tables -------------------------------------------------------------------


def digits_of(name: str) -> int:
    """Digits that survive a different order of summation at the column's magnitude."""
    if name in p.CALENDAR_SQL:
        return 0
    if "kurt" in name or name in p.CROSS_SQL or "_mean_" in name:
        return 3
    steady = ("lag", "max_", "min_", "range", "change", "momentum_", "next_", "log_", "close_to", "open_close", "high_close")
    return 6 if any(part in name for part in steady) else 4


FEATURES = [
    *INDICATOR_COLUMNS, *p.LABEL_SQL, *p.PRICE_SHAPE_SQL, *p.RETURN_SQL, *p.lag_sql("close"), *p.lag_sql("return"),
    *MEANS, *DEVIATIONS, *SKEWS, *KURTS, *EXTREMES, *p.MOTION_SQL, *p.SPREAD_SQL, *p.MA_DISTANCE_SQL,
    *p.BOLLINGER_SQL, *VOLATILITY, *p.RATIO_SQL, *p.MOMENTUM_SQL, *p.CROSS_SQL, *p.CALENDAR_SQL,
]
FEATURE_DIGITS = {n: digits_of(n) for n in FEATURES}


@query(p.with_sql(SUPPLIER, p.indicators_sql(), p.features_sql()) + shaped_sql("feat", KEYS, FEATURE_DIGITS))
def feature_table(spark, sf):
    return shaped(p.feature_panel(spark, sf), KEYS, FEATURE_DIGITS)


LEAN = {
    **p.lag_sql("return", features.LEAN_LAGS),
    **p.rolling_columns_sql("return", "mean", features.LEAN_WINDOWS),
    **p.rolling_columns_sql("return", "std", features.LEAN_WINDOWS),
}
LEAN_FIRST = {
    **p.LABEL_SQL,
    "return": p.RETURN_SQL["return"],
    **{f"{n}_momentum": f"{n} - lag({n}) OVER {p.SERIES}" for n in features.LEAN_INDICATORS},
    **{n: p.MA_DISTANCE_SQL[n] for n in ("close_to_sma50", "close_to_sma100")},
    **{f"price_momentum_{k}": p.change_sql("close", k) for k in features.LEAN_MOMENTUM},
    **{n: p.CALENDAR_SQL[n] for n in features.LEAN_CALENDAR},
}
LEAN_DIGITS = {n: digits_of(n) for n in (*LEAN_FIRST, *LEAN)}
NOT_NULL = " AND ".join(f'"{n}" IS NOT NULL' for n in (*INDICATOR_COLUMNS, *LEAN_FIRST, *LEAN))


@query(
    p.with_sql(SUPPLIER, p.indicators_sql(), p.added("a", "ind", LEAN_FIRST), p.added("x", "a", LEAN))
    + shaped_sql("x", KEYS, LEAN_DIGITS)
    + f" WHERE {NOT_NULL}"
)
def lean_feature_table(spark, sf):
    return shaped(features.lean_feature_table(p.indicators(spark, sf)), KEYS, LEAN_DIGITS)


NO_RSI = {n: e for n, e in LEAN_FIRST.items() if n != "rsi_14_momentum"}
NO_RSI_NOT_NULL = " AND ".join(
    f'"{n}" IS NOT NULL' for n in (*INDICATOR_COLUMNS, *NO_RSI, *LEAN) if n != "rsi_14"
)


@query(
    p.with_sql(SUPPLIER, p.indicators_sql(), p.added("a", "ind", NO_RSI), p.added("x", "a", LEAN))
    + shaped_sql("x", KEYS, {n: digits_of(n) for n in (*NO_RSI, *LEAN)})
    + f" WHERE {NO_RSI_NOT_NULL}"
)
def lean_features_without_rsi(spark, sf):
    """An indicator the input lacks is left out of the lean set."""
    df = features.lean_feature_table(p.indicators(spark, sf).drop("rsi_14"))
    return shaped(df, KEYS, {n: digits_of(n) for n in (*NO_RSI, *LEAN)})


BLOCK = 512


def flag_bars(spark, sf):
    """Three long series, as the aggregation leaves them: not spread by series."""
    return p.lineitem_bars(p.table(spark, sf, "lineitem"), "l_returnflag")


def cleaned_sql(c: str) -> str:
    up = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    down = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return (f'coalesce(last_value("{c}" IGNORE NULLS) OVER {up}, first_value("{c}" IGNORE NULLS) OVER {down}, 0) '
            f'AS "{c}"')


BLOCKED = {**p.LABEL_SQL, **p.RETURN_SQL, **p.lag_sql("close"), **p.MOMENTUM_SQL}
BLOCKED_LATE = {**p.lag_sql("return"), **DEVIATIONS}
BLOCKED_DIGITS = {n: digits_of(n) for n in (*BLOCKED, *BLOCKED_LATE)}


def _bounded(df, by):
    df = features.momentum(features.lags(features.returns(features.forward_return(df, 5, by), by), ["close"], LAGS, by),
                           MOMENTUM_PERIODS, by)
    df = features.lags(df, ["return"], LAGS, by)
    return features.rolling(df, "return", "std", WINDOWS, by)


@query(
    p.with_sql(FLAG, p.added("a", "bars", BLOCKED), p.added("x", "a", BLOCKED_LATE))
    + shaped_sql("x", KEYS, BLOCKED_DIGITS)
)
def features_in_blocks(spark, sf):
    """Bounded windows over time blocks with a halo; equal to the plain windows."""
    df = blocks.in_blocks(flag_bars(spark, sf), _bounded, features.LOOKBACK, features.LOOKAHEAD, block_rows=BLOCK)
    return shaped(df, KEYS, BLOCKED_DIGITS)


@query(p.with_sql(FLAG, p.indicators_sql()) + shaped_sql("ind", KEYS, INDICATOR_DIGITS))
def indicators_in_blocks(spark, sf):
    """Exponential means handed from block to block, the other indicators with a halo."""
    return shaped(long_series.indicator_blocks(flag_bars(spark, sf), BLOCK).rows(), KEYS, INDICATOR_DIGITS)


@query(
    p.with_sql(FLAG, p.indicators_sql(), p.features_sql(), "cleaned AS (SELECT symbol, date, next_5day_return, "
               + ", ".join(cleaned_sql(c) for c in FEATURES if c != "next_5day_return")
               + " FROM feat WHERE next_5day_return IS NOT NULL)")
    + shaped_sql("cleaned", KEYS, FEATURE_DIGITS)
)
def feature_table_in_blocks(spark, sf):
    """The whole cleaned feature table without bringing a series together."""
    return shaped(long_series.clean_features(flag_bars(spark, sf), BLOCK), KEYS, FEATURE_DIGITS)


# --- missing values -----------------------------------------------------------------------

SOME = {"return_lag5": 6, "return_std_10": 4, "close_max_20": 6, "volume_change": 6}
SOME_SQL = (
    SUPPLIER,
    p.added("r", "bars", {**p.LABEL_SQL, **p.RETURN_SQL}),
    p.added("x", "r", {"return_lag5": p.lag_sql("return")["return_lag5"],
                       "return_std_10": p.rolling_sql('"return"', "std", 10),
                       "close_max_20": p.rolling_sql("close", "max", 20)}),
)


def some_features(spark, sf):
    df = features.forward_return(features.returns(p.bars(spark, sf)))
    df = features.lags(df, ["return"], [5])
    df = features.rolling(df, "return", "std", [10])
    return features.rolling(df, "close", "max", [20])


@query(p.with_sql(*SOME_SQL) + shaped_sql("x", KEYS, {**SOME, "next_5day_return": 6})
       + " WHERE next_5day_return IS NOT NULL")
def labelled_rows(spark, sf):
    return shaped(fill.labelled(some_features(spark, sf)), KEYS, {**SOME, "next_5day_return": 6})


@query(p.with_sql(*SOME_SQL) + shaped_sql("x", KEYS, SOME)
       + ' WHERE next_5day_return IS NOT NULL AND "return" IS NOT NULL AND log_return IS NOT NULL '
       + "".join(f" AND {n} IS NOT NULL" for n in SOME))
def rows_after_warmup(spark, sf):
    return shaped(fill.drop_warmup(some_features(spark, sf)), KEYS, SOME)


def _gaps(df):
    """Every seventh day of the month goes missing, so fills have something to do."""
    return df.withColumns({c: F.when(F.dayofmonth("date") % 7 != 0, F.col(c)) for c in ("close", "volume")})


def gaps_sql(panel: str) -> tuple[str, str]:
    return (panel, "g AS (SELECT symbol, date, CASE WHEN day(date) % 7 <> 0 THEN close END AS close, "
            "CASE WHEN day(date) % 7 <> 0 THEN volume END AS volume FROM bars)")


def filled_sql(panel: str, pick: str, frame: str) -> str:
    filled = (fixed_sql(f"{pick}({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {frame})") + f" AS {c}"
              for c in ("close", "volume"))
    return p.with_sql(*gaps_sql(panel)) + "SELECT symbol, CAST(date AS VARCHAR) AS date, " + ", ".join(filled) + " FROM g"


FORWARD, BACKWARD = ("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"), ("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")


@query(filled_sql(SUPPLIER, *FORWARD))
def forward_filled(spark, sf):
    return shaped(fill.ffill(_gaps(p.bars(spark, sf)), ["close", "volume"]), KEYS, ["close", "volume"])


@query(filled_sql(SUPPLIER, *BACKWARD))
def backward_filled(spark, sf):
    return shaped(fill.bfill(_gaps(p.bars(spark, sf)), ["close", "volume"]), KEYS, ["close", "volume"])


@query(filled_sql(FLAG, *FORWARD))
def forward_filled_in_blocks(spark, sf):
    """The last known value is handed from block to block."""
    cut = blocks.Blocks(_gaps(flag_bars(spark, sf)), block_rows=5)
    return shaped(cut.ffill(["close", "volume"]).rows(), KEYS, ["close", "volume"])


@query(filled_sql(FLAG, *BACKWARD))
def backward_filled_in_blocks(spark, sf):
    cut = blocks.Blocks(_gaps(flag_bars(spark, sf)), block_rows=5)
    return shaped(cut.bfill(["close", "volume"]).rows(), KEYS, ["close", "volume"])


CLEAN_SQL = "cleaned AS (SELECT symbol, date, next_5day_return, " + ", ".join(
    cleaned_sql(c) for c in SOME) + " FROM x WHERE next_5day_return IS NOT NULL)"


@query(p.with_sql(*SOME_SQL, CLEAN_SQL) + shaped_sql("cleaned", KEYS, SOME))
def cleaned_features(spark, sf):
    return shaped(fill.clean(some_features(spark, sf)), KEYS, SOME)


# --- splits and sequences -----------------------------------------------------------------


def split_sql(source: str, cte: str = "parted") -> str:
    return f"""{cte} AS (
  SELECT *, CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
                 WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val'
                 ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
               count(*) OVER (PARTITION BY symbol) AS n FROM {source}))"""


def date_split_sql(source: str, cte: str = "parted") -> str:
    return f"""{cte} AS (
  SELECT s.*, c.split FROM {source} s JOIN (
    SELECT date, CASE WHEN upto <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
                      WHEN upto <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val'
                      ELSE 'test' END AS split
    FROM (SELECT date, sum(count(*)) OVER (ORDER BY date) AS upto, sum(count(*)) OVER () AS n
          FROM {source} GROUP BY date)) c ON s.date = c.date)"""


LABELLED_SQL = (SUPPLIER, p.added("r", "bars", {**p.LABEL_SQL, **p.RETURN_SQL}),
                "lab AS (SELECT * FROM r WHERE next_5day_return IS NOT NULL)")


def labelled_returns(spark, sf):
    return fill.labelled(features.forward_return(features.returns(p.bars(spark, sf))))


@query(p.with_sql(*LABELLED_SQL, split_sql("lab")) + shaped_sql("parted", KEYS, (), (), ("split",)))
def split_by_position(spark, sf):
    return shaped(split.chrono_split(labelled_returns(spark, sf)), KEYS, (), (), ("split",))


@query(p.with_sql(*LABELLED_SQL, date_split_sql("lab")) + shaped_sql("parted", KEYS, (), (), ("split",)))
def split_by_date(spark, sf):
    return shaped(split.chrono_split(labelled_returns(spark, sf), mode="date"), KEYS, (), (), ("split",))


@query(
    p.with_sql(*LABELLED_SQL, """folded AS (
  SELECT symbol, date, CASE WHEN i < (n % 3) * (n // 3 + 1) THEN i // (n // 3 + 1)
                            ELSE n % 3 + (i - (n % 3) * (n // 3 + 1)) // nullif(n // 3, 0) END AS fold
  FROM (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i,
               count(*) OVER (PARTITION BY symbol) AS n FROM lab))""")
    + shaped_sql("folded", KEYS, (), ("fold",))
)
def time_folds(spark, sf):
    return shaped(split.time_folds(labelled_returns(spark, sf), 3), KEYS, (), ("fold",))


@query(
    p.with_sql(*LABELLED_SQL, """days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT date FROM lab))""", """cut AS (
  SELECT date, CASE WHEN i < (n % 3) * (n // 3 + 1) THEN i // (n // 3 + 1)
                    ELSE n % 3 + (i - (n % 3) * (n // 3 + 1)) // nullif(n // 3, 0) END AS fold FROM days)""",
               "folded AS (SELECT symbol, lab.date, fold FROM lab JOIN cut ON lab.date = cut.date)")
    + shaped_sql("folded", KEYS, (), ("fold",))
)
def time_folds_by_date(spark, sf):
    return shaped(split.time_folds(labelled_returns(spark, sf), 3, mode="date"), KEYS, (), ("fold",))


SEQUENCED = ("return", "volume_change")


def sequence_sql(length: int) -> str:
    w = f"(PARTITION BY symbol, split ORDER BY date ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"
    first, last = f"list({fixed_sql(chr(34) + 'return' + chr(34))}) OVER {w}", f"list({fixed_sql('volume_change')}) OVER {w}"
    return (f"seq AS (SELECT symbol, date, split, next_5day_return, {first} AS a, {last} AS b, "
            f"count(*) OVER {w} AS n FROM parted)")


@query(
    p.with_sql(*LABELLED_SQL, "known AS (SELECT * FROM lab WHERE \"return\" IS NOT NULL)", split_sql("known"),
               sequence_sql(20))
    + f"SELECT symbol, CAST(date AS VARCHAR) AS date, split, {fixed_sql('next_5day_return')} AS next_5day_return, "
    + ", ".join(f"a[{i + 1}] AS r{i}, b[{i + 1}] AS v{i}" for i in (0, 7, 19))
    + ", CAST(len(a) AS BIGINT) AS length FROM seq WHERE n = 20"
)
def sequences(spark, sf):
    rows = labelled_returns(spark, sf).where(F.col("return").isNotNull())
    df = split.sequences(split.chrono_split(rows), SEQUENCED, 20)
    item = F.col("sequence")
    return df.select(
        "symbol", F.col("date").cast("string").alias("date"), "split",
        fixed("next_5day_return").alias("next_5day_return"),
        *[fixed(item[i][0]).alias(f"r{i}") for i in (0, 7, 19)],
        *[fixed(item[i][1]).alias(f"v{i}") for i in (0, 7, 19)],
        F.size("sequence").cast("bigint").alias("length"),
    )


@query(
    p.with_sql(*LABELLED_SQL, "known AS (SELECT * FROM lab WHERE \"return\" IS NOT NULL)", split_sql("known"))
    + """SELECT symbol, split, count(*) AS n_rows, CAST(greatest(count(*) - 19, 0) AS BIGINT) AS n_sequences
FROM parted GROUP BY 1, 2"""
)
def sequence_counts(spark, sf):
    """A split of n rows holds n - 19 sequences of 20."""
    rows = split.chrono_split(labelled_returns(spark, sf).where(F.col("return").isNotNull()))
    found = split.sequences(rows, SEQUENCED, 20).groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("_found"))
    return (
        rows.groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("n_rows"))
        .join(found, ["symbol", "split"], "left")
        .select("symbol", "split", "n_rows", F.coalesce("_found", F.lit(0)).cast("bigint").alias("n_sequences"))
    )


@query(
    p.with_sql(SUPPLIER)
    + shaped_sql("(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars)",
                 KEYS, ("close",))
    + " WHERE back <= 50"
)
def series_tail(spark, sf):
    return shaped(split.tail(p.bars(spark, sf), 50), KEYS, ("close",))
