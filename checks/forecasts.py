"""A predictions table that SQL can rebuild: closed-form forecasts over window features.

The names follow the grammar of trial names, so that family, size and round rules apply to
them; they say nothing about how the forecast is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.names import SEQUENCE_FAMILIES
from barline.operators import evaluate, features, fill, split
from barline.session import materialise
from checks import panels as p
from checks.feature_queries import split_sql

FORECASTS = {
    "Ridge_500": "0.8 * (c60 / close - 1)",
    "Ridge_100": "0.5 * (c20 / close - 1)",
    "Lasso": "0.25",
    "DecisionTree": "CASE WHEN r > 0 THEN -0.5 ELSE 1.5 END",
    "RF_100_6": "0.7 * (c10 / close - 1)",
    "RF_100_7": "0.2 * m20",
    "XGB_100_4_50": "c20 / close - 1",
    "LGB_30_2_50": "0.6 * (c60 / close - 1) - 0.1",
    "GRU_R3_24_2": "0.9 * (c60 / close - 1) + 0.05",
    "GRU_32_3": "m5",
    "LSTM_R2_16_2": "0.9 * (c20 / close - 1)",
    "SVR": "-0.5 * r",
}
LENGTH = 20


def recurrent(name: str) -> bool:
    return name.startswith(SEQUENCE_FAMILIES)


def base(spark, sf, panel: str = "supplier") -> DataFrame:
    """Written once, so that no reader of any query makes the columns again."""
    return p.once(spark, sf, f"forecasts of {panel}", lambda: materialise(base_rows(spark, sf, panel)))


def base_rows(spark, sf, panel: str) -> DataFrame:
    df = features.forward_return(features.returns(p.bars(spark, sf, panel)))
    df = features.rolling(df, "return", "mean", [5, 20])
    df = features.rolling(df, "close", "mean", [10, 20, 60])
    df = split.chrono_split(fill.drop_warmup(df))
    in_split = Window.partitionBy("symbol", "split").orderBy("date")
    return df.select(
        "symbol", "date", "split", "close", F.col("return").alias("r"), F.col("next_5day_return").alias("y"),
        F.col("return_mean_5").alias("m5"), F.col("return_mean_20").alias("m20"),
        *[F.col(f"close_mean_{n}").alias(f"c{n}") for n in (10, 20, 60)],
        F.row_number().over(in_split).alias("place"),
    )


def predictions(spark, sf, panel: str = "supplier") -> DataFrame:
    """Recurrent names cover only rows with a full sequence in their split."""
    columns = []
    for name, expression in FORECASTS.items():
        value = F.expr(expression).cast("double")
        columns.append((F.when(F.col("place") >= LENGTH, value) if recurrent(name) else value).alias(name))
    rows = base(spark, sf, panel).select("split", "symbol", "date", "y", *columns)
    # Unpivot hides from Spark that a series is together: on unions of tables that kept this, counts by series were wrong.
    long = rows.unpivot(["split", "symbol", "date", "y"], list(FORECASTS), "model", "yhat")
    return long.where(F.col("yhat").isNotNull())


def metrics(spark, sf, by=("symbol",), panel: str = "supplier") -> DataFrame:
    return evaluate.regression_metrics(predictions(spark, sf, panel), by)


def test_metrics(spark, sf, by=("symbol",)) -> DataFrame:
    return metrics(spark, sf, by).where(F.col("split") == "test")


def common(spark, sf) -> DataFrame:
    """Predictions on the rows that every model covers."""
    return evaluate.common_rows(predictions(spark, sf))


def selection_metrics(spark, sf, by=("symbol",), split: str = "val") -> DataFrame:
    """What models are chosen by: scores on the validation rows common to all of them."""
    return evaluate.regression_metrics(common(spark, sf).where(F.col("split") == split), by)


def predictions_sql(symbol: str = "l_suppkey") -> str:
    """CTEs up to ``preds``."""
    stats = {
        "m5": p.rolling_sql('"return"', "mean", 5), "m20": p.rolling_sql('"return"', "mean", 20),
        **{f"c{n}": p.rolling_sql("close", "mean", n) for n in (10, 20, 60)},
    }
    known = " AND ".join(f'"{c}" IS NOT NULL' for c in (*p.RETURN_SQL, "next_5day_return", *stats))
    union = "\n  UNION ALL ".join(
        f"SELECT '{n}' AS model, split, symbol, date, y, CAST({e} AS DOUBLE) AS yhat FROM base"
        + (f" WHERE place >= {LENGTH}" if recurrent(n) else "")
        for n, e in FORECASTS.items()
    )
    return ",\n".join([
        p.bars_sql(symbol),
        p.added("p0", "bars", {**p.LABEL_SQL, **p.RETURN_SQL}),
        p.added("p1", "p0", stats),
        f"p2 AS (SELECT * FROM p1 WHERE {known})",
        split_sql("p2", "p3"),
        'base AS (SELECT symbol, date, split, close, "return" AS r, next_5day_return AS y, m5, m20, c10, c20, c60, '
        "row_number() OVER (PARTITION BY symbol, split ORDER BY date) AS place FROM p3)",
        f"preds AS (\n  {union})",
    ])


def metrics_sql(by: tuple[str, ...] = ("symbol",), source: str = "preds", cte: str = "met") -> str:
    keys = ", ".join((*by, "model", "split"))
    return f"""{cte} AS (
  SELECT {keys}, count(*) AS n, 1 - sum((y - yhat) * (y - yhat)) / nullif(var_pop(y) * count(*), 0) AS r2,
         sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat)) AS mae,
         avg(abs((y - yhat) / nullif(y, 0))) AS mape
  FROM {source} GROUP BY {keys})"""


def test_metrics_sql(by: tuple[str, ...] = ("symbol",)) -> str:
    """CTEs up to ``tm``, the metrics of the test split."""
    return f"{predictions_sql()},\n{metrics_sql(by)},\ntm AS (SELECT * FROM met WHERE split = 'test')"


COMMON_SQL = """common AS (SELECT * FROM preds WHERE (split, symbol, date) IN (SELECT (split, symbol, date) FROM preds
  GROUP BY split, symbol, date HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM preds)))"""


def selection_sql(by: tuple[str, ...] = ("symbol",), split: str = "val") -> str:
    """CTEs up to ``tm``, the metrics that models are chosen by; ``met`` has those of all splits."""
    return f"{predictions_sql()},\n{COMMON_SQL},\n{metrics_sql(by, 'common')},\ntm AS (SELECT * FROM met WHERE split = '{split}')"


FAMILY_SQL = """CASE WHEN contains(model, 'GRU') THEN 'GRU' WHEN contains(model, 'LSTM') THEN 'LSTM'
  WHEN contains(model, 'Ridge') THEN 'Ridge' WHEN contains(model, 'XGB') THEN 'XGB'
  WHEN contains(model, 'LGB') THEN 'LGB' WHEN contains(model, 'RF') THEN 'RF' ELSE 'Other' END"""
ROUND_SQL = "CASE WHEN contains(model, 'R2') THEN 2 WHEN contains(model, 'R3') THEN 3 ELSE 1 END"
SIZES_SQL = "[CAST(x AS INT) FOR x IN string_split(model, '_') IF regexp_full_match(x, '[0-9]+')]"
