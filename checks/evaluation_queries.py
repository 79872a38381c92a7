"""Scores of forecasts and the tables behind the charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.operators import evaluate, split
from barline.plans import scores
from barline.session import shared_folder
from barline.sources import sinks
from checks import forecasts as fc
from checks import panels as p
from checks.feature_queries import split_sql
from checks.registry import fixed_sql, query, shaped, shaped_sql

PREDS = fc.predictions_sql()
BOTH = fc.metrics_sql(())
SYMBOL = ("symbol",)
SCORES = {"r2": 5, "rmse": 5, "mae": 5, "mape": 2}


@query(
    p.with_sql(
        p.bars_sql("l_returnflag"),
        p.added("a", "bars", {**p.LABEL_SQL, **p.RETURN_SQL}),
        p.added("b", "a", {"return_lag1": p.lag_sql("return")["return_lag1"], "m5": p.rolling_sql('"return"', "mean", 5),
                           "s5": p.rolling_sql('"return"', "std", 5)}),
        'c AS (SELECT * FROM b WHERE next_5day_return IS NOT NULL AND return_lag1 IS NOT NULL AND m5 IS NOT NULL '
        "AND volume_change IS NOT NULL AND log_return IS NOT NULL)",
        split_sql("c", "d"),
        "preds AS (SELECT 'Naive' AS model, symbol, split, date, next_5day_return AS y, m5 AS yhat FROM d)",
        fc.metrics_sql(),
    )
    + shaped_sql("met", ("symbol", "model", "split"), SCORES, ("n",))
)
def naive_forecast_scores(spark, sf):
    bars = p.lineitem_bars(p.table(spark, sf, "lineitem"), "l_returnflag")
    return shaped(scores.naive_forecast_scores(bars), ("symbol", "model", "split"), SCORES, ("n",))


@query(p.with_sql(PREDS, BOTH) + shaped_sql("met", ("model", "split"), SCORES, ("n",)))
def regression_metrics(spark, sf):
    return shaped(fc.metrics(spark, sf, ()), ("model", "split"), SCORES, ("n",))


@query(p.with_sql(PREDS, fc.metrics_sql(SYMBOL)) + shaped_sql("met", ("symbol", "model", "split"), SCORES, ("n",)))
def regression_metrics_by_symbol(spark, sf):
    return shaped(fc.metrics(spark, sf), ("symbol", "model", "split"), SCORES, ("n",))


@query(
    p.with_sql(PREDS, "d AS (SELECT *, (y > 0)::INT AS up, (yhat > 0)::INT AS up_hat FROM preds)")
    + shaped_sql("d", ("model", "split", "symbol", "date"), (), ("up", "up_hat"))
)
def direction_labels(spark, sf):
    df = evaluate.to_direction(fc.predictions(spark, sf))
    return shaped(df, ("model", "split", "symbol", "date"), (), ("up", "up_hat"))


def val(spark, sf):
    return fc.predictions(spark, sf).where(F.col("split") == "val")


VAL = "v AS (SELECT * FROM preds WHERE split = 'val')"


def confusion_sql(by: str = "") -> str:
    return f"""conf AS (
  SELECT *, 100.0 * tn / total AS tn_pct, 100.0 * fp / total AS fp_pct, 100.0 * fn / total AS fn_pct,
         100.0 * tp / total AS tp_pct,
         coalesce(CAST(tp + tn AS DOUBLE) / nullif(total, 0), 0) AS accuracy,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
         coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1
  FROM (SELECT {by} model, count(*) AS total,
               count(*) FILTER (y <= 0 AND yhat <= 0) AS tn, count(*) FILTER (y <= 0 AND yhat > 0) AS fp,
               count(*) FILTER (y > 0 AND yhat <= 0) AS fn, count(*) FILTER (y > 0 AND yhat > 0) AS tp
        FROM v GROUP BY {by} model))"""


def auc_sql(by: str = "") -> str:
    return f"""auc AS (
  SELECT {by} model, (sum(CASE WHEN y > 0 THEN mid END) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2.0)
         / nullif(CAST(count(*) FILTER (y > 0) AS DOUBLE) * count(*) FILTER (y <= 0), 0) AS roc_auc
  FROM (SELECT {by} model, y, rank() OVER (PARTITION BY {by} model ORDER BY yhat)
               + (count(*) OVER (PARTITION BY {by} model, yhat) - 1) / 2.0 AS mid FROM v)
  GROUP BY {by} model)"""


CELLS = ("tn", "fp", "fn", "tp")
PCT = tuple(f"{c}_pct" for c in CELLS)
CLASS = ("accuracy", "precision", "recall", "f1")


@query(p.with_sql(PREDS, VAL, confusion_sql()) + shaped_sql("conf", ("model",), PCT, CELLS))
def confusion_counts(spark, sf):
    return shaped(evaluate.confusion(val(spark, sf)), ("model",), PCT, CELLS)


@query(p.with_sql(PREDS, VAL, confusion_sql("symbol,")) + shaped_sql("conf", ("symbol", "model"), CLASS, CELLS))
def class_metrics_by_symbol(spark, sf):
    df = evaluate.class_metrics(evaluate.confusion(val(spark, sf), SYMBOL))
    return shaped(df, ("symbol", "model"), CLASS, CELLS)


@query(
    p.with_sql(PREDS, VAL, "b AS (SELECT model, (y > 0)::INT AS up, count(*) AS n, "
               "100.0 * count(*) / sum(count(*)) OVER (PARTITION BY model) AS pct FROM v GROUP BY 1, 2)")
    + shaped_sql("b", ("model",), ("pct",), ("up", "n"))
)
def class_balance(spark, sf):
    return shaped(evaluate.class_balance(val(spark, sf)), ("model",), ("pct",), ("up", "n"))


@query(p.with_sql(PREDS, VAL, auc_sql()) + shaped_sql("auc", ("model",), ("roc_auc",)))
def roc_auc(spark, sf):
    return shaped(evaluate.roc_auc(val(spark, sf)), ("model",), ("roc_auc",))


@query(p.with_sql(PREDS, VAL, auc_sql("symbol,")) + shaped_sql("auc", ("symbol", "model"), ("roc_auc",)))
def roc_auc_by_symbol(spark, sf):
    return shaped(evaluate.roc_auc(val(spark, sf), SYMBOL, bounded=True), ("symbol", "model"), ("roc_auc",))


@query(
    p.with_sql(PREDS, VAL, """g AS (SELECT model, yhat, count(*) FILTER (y > 0) AS pos, count(*) FILTER (y <= 0) AS neg
  FROM v GROUP BY 1, 2)""", """pts AS (
  SELECT model, yhat AS threshold,
         CAST(sum(neg) OVER down AS DOUBLE) / nullif(sum(neg) OVER (PARTITION BY model), 0) AS fpr,
         CAST(sum(pos) OVER down AS DOUBLE) / nullif(sum(pos) OVER (PARTITION BY model), 0) AS tpr
  FROM g WINDOW down AS (PARTITION BY model ORDER BY yhat DESC)
  UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM v)""")
    + shaped_sql("pts", ("model",), ("threshold", "fpr", "tpr"))
)
def roc_points(spark, sf):
    return shaped(evaluate.roc_points(val(spark, sf)), ("model",), ("threshold", "fpr", "tpr"))


@query(
    p.with_sql(PREDS, VAL, "s AS (SELECT *, (yhat - min(yhat) OVER m) / (max(yhat) OVER m - min(yhat) OVER m + 1e-8) "
               "AS yhat_scaled FROM v WINDOW m AS (PARTITION BY model))")
    + shaped_sql("s", ("model", "symbol", "date"), ("yhat_scaled",))
)
def score_scaling(spark, sf):
    return shaped(evaluate.score_scaling(val(spark, sf)), ("model", "symbol", "date"), ("yhat_scaled",))


SUMMARY = (PREDS, VAL, confusion_sql(), auc_sql(), "summary AS (SELECT * FROM conf LEFT JOIN auc USING (model))")


@query(p.with_sql(*SUMMARY) + shaped_sql("summary", ("model",), dict.fromkeys((*CLASS, "roc_auc"), 4), CELLS))
def classification_summary(spark, sf):
    df = evaluate.classification_summary(val(spark, sf))
    return shaped(df, ("model",), dict.fromkeys((*CLASS, "roc_auc"), 4), CELLS)


@query(
    p.with_sql(*SUMMARY)
    + "SELECT model, CAST(abs(accuracy - CAST(tp + tn AS DOUBLE) / total) > 0.01 AS BIGINT) AS wrong FROM summary"
)
def metric_consistency(spark, sf):
    """Which summary rows contradict their own counts or the forecasts; none should."""
    rows = val(spark, sf)
    summary = evaluate.classification_summary(rows)
    wrong = evaluate.check_metrics(summary, rows).select("model", F.lit(1).alias("_wrong"))
    marked = summary.select("model").join(wrong, "model", "left")
    return marked.select("model", F.coalesce("_wrong", F.lit(0)).cast("bigint").alias("wrong"))


def _line(label: str, column: str) -> str:
    return f"'- {label}: ' || printf('%.4f', {column}) || chr(10)"


def _counts(label: str, a: str, b: str) -> str:
    return f"'{label}        ' || lpad({a}::VARCHAR, 6, ' ') || '    ' || lpad({b}::VARCHAR, 6, ' ') || chr(10)"


BLOCK_SQL = (
    "SELECT model, '## ' || model || chr(10) || chr(10) || '**整体指标：**' || chr(10) || "
    + " || ".join([_line("Accuracy", "accuracy"), _line("Precision", "precision"), _line("Recall", "recall"),
                   _line("F1-Score", "f1"), f"CASE WHEN roc_auc <> 0 THEN {_line('ROC-AUC', 'roc_auc')} ELSE '' END"])
    + " || chr(10) || '**混淆矩阵：**' || chr(10) || '```' || chr(10) || '                预测跌    预测涨' || chr(10) || "
    + " || ".join([_counts("实际跌", "tn", "fp"), _counts("实际涨", "fn", "tp")])
    + " || '```' || chr(10) || chr(10) || repeat('-', 80) || chr(10) AS block FROM summary"
)


@query(p.with_sql(*SUMMARY) + BLOCK_SQL)
def classification_report(spark, sf):
    return evaluate.format_report(evaluate.classification_summary(val(spark, sf)))


@query(
    p.with_sql(*SUMMARY, f"r AS ({BLOCK_SQL})", f"""l AS (SELECT unnest(string_split(block, chr(10))) AS value FROM r
  UNION ALL SELECT unnest(['{sinks.REPORT_TITLE}', '', '{sinks.TITLE_RULE}', '']))""")
    + "SELECT value, count(*) AS n FROM l GROUP BY 1"
)
def report_file(spark, sf):
    """The report as written, read back line by line."""
    path = shared_folder(spark, "report")
    sinks.write_report(classification_report(spark, sf), path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


TEXTS = {"Accuracy": "accuracy", "Precision": "precision", "Recall": "recall", "F1-Score": "f1"}


@query(
    p.with_sql(*SUMMARY)
    + "SELECT model, " + ", ".join(f"printf('%.4f', {c}) AS \"{n}\"" for n, c in TEXTS.items())
    + ", CASE WHEN coalesce(roc_auc, 0) <> 0 THEN printf('%.4f', roc_auc) ELSE 'N/A' END AS \"ROC-AUC\", "
    + ", ".join(f"{c}::VARCHAR AS {c.upper()}" for c in ("tn", "fp", "fn", "tp")) + " FROM summary"
)
def summary_csv(spark, sf):
    """The formatted summary with a byte order mark, read back."""
    path = shared_folder(spark, "summary-csv")
    sinks.write_csv(evaluate.format_summary(evaluate.classification_summary(val(spark, sf))), path, mark=True)
    found = spark.read.option("header", True).csv(path)
    return found.toDF("model", *found.columns[1:])


# --- tables behind the charts -------------------------------------------------------------

TM = fc.test_metrics_sql()
CLASS_SQL = "CASE WHEN contains(model, 'GRU') OR contains(model, 'LSTM') THEN 'sequence' ELSE 'tabular' END"


@query(
    p.with_sql(TM) + f"""SELECT symbol, {CLASS_SQL} AS class, count(*) AS n, {fixed_sql('avg(r2)')} AS mean_r2,
{fixed_sql('max(r2)')} AS max_r2, {fixed_sql('min(r2)')} AS min_r2 FROM tm GROUP BY 1, 2"""
)
def family_summary(spark, sf):
    df = evaluate.family_summary(fc.test_metrics(spark, sf), SYMBOL)
    return shaped(df, ("symbol", "class"), ("mean_r2", "max_r2", "min_r2"), ("n",))


@query(
    p.with_sql(TM, f"t AS (SELECT *, {CLASS_SQL} AS class FROM tm)", """q AS (
  SELECT class, count(*) AS n, quantile_cont(r2, 0.25) AS q1, quantile_cont(r2, 0.5) AS median,
         quantile_cont(r2, 0.75) AS q3 FROM t GROUP BY 1)""", """b AS (
  SELECT q.class, n, q1, median, q3, min(r2) FILTER (ok) AS low, max(r2) FILTER (ok) AS high,
         count(*) FILTER (NOT ok) AS n_outliers
  FROM (SELECT t.class, r2, r2 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM t JOIN q USING (class)) o
  JOIN q USING (class) GROUP BY ALL)""")
    + shaped_sql("b", ("class",), ("q1", "median", "q3", "low", "high"), ("n", "n_outliers"))
)
def box_stats(spark, sf):
    df = evaluate.box_stats(fc.test_metrics(spark, sf))
    return shaped(df, ("class",), ("q1", "median", "q3", "low", "high"), ("n", "n_outliers"))


@query(
    p.with_sql(PREDS, "r AS (SELECT model, y - yhat AS e FROM preds WHERE split = 'test')", """h AS (
  SELECT model, CAST(least(39, floor(coalesce((e - lo) / nullif(hi - lo, 0), 0) * 40)) AS BIGINT) AS bin, count(*) AS n
  FROM (SELECT *, min(e) OVER (PARTITION BY model) AS lo, max(e) OVER (PARTITION BY model) AS hi FROM r) GROUP BY 1, 2)""")
    + shaped_sql("h", ("model",), (), ("bin", "n"))
)
def residual_histogram(spark, sf):
    df = evaluate.residual_histogram(fc.predictions(spark, sf).where(F.col("split") == "test"), 40)
    return shaped(df, ("model",), (), ("bin", "n"))


@query(
    p.with_sql(PREDS, BOTH, """best AS (SELECT model FROM met WHERE split = 'test' ORDER BY r2 DESC, model LIMIT 1)""",
               """t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back
  FROM preds WHERE split = 'test' AND model IN (SELECT model FROM best))""")
    + shaped_sql("t", ("model", "symbol", "date"), ("y", "yhat")) + " WHERE back <= 50"
)
def predicted_and_actual_tail(spark, sf):
    """The last 50 rows of every series under the best model."""
    preds = fc.predictions(spark, sf).where(F.col("split") == "test")
    metrics = evaluate.regression_metrics(preds)
    best = metrics.orderBy(F.col("r2").desc(), "model").limit(1).select("model")
    rows = split.tail(preds.join(best, "model", "left_semi"), 50)
    return shaped(rows, ("model", "symbol", "date"), ("y", "yhat"))


@query(
    p.with_sql(TM, """long AS (SELECT symbol, model, 'R2' AS metric, r2 AS value FROM tm
  UNION ALL SELECT symbol, model, 'RMSE', -rmse FROM tm UNION ALL SELECT symbol, model, 'MAE', -mae FROM tm)""",
               """h AS (SELECT *, (value - min(value) OVER g) / nullif(max(value) OVER g - min(value) OVER g, 0)
  AS value_scaled FROM long WINDOW g AS (PARTITION BY symbol, metric))""")
    + shaped_sql("h", ("symbol", "model", "metric"), ("value", "value_scaled"))
)
def metric_heatmap(spark, sf):
    df = evaluate.metric_heatmap(fc.test_metrics(spark, sf), SYMBOL)
    return shaped(df, ("symbol", "model", "metric"), ("value", "value_scaled"))


PARAMS_SQL = f"""e AS (SELECT *, CASE WHEN {fc.FAMILY_SQL} IN ('GRU', 'LSTM')
  THEN coalesce(CAST(sizes[1] AS BIGINT) * sizes[1] * sizes[2] * 3, 1000) ELSE 270 END AS n_params, 1.0 AS time
  FROM (SELECT *, {fc.SIZES_SQL} AS sizes FROM tm))"""


@query(p.with_sql(TM, PARAMS_SQL) + shaped_sql("e", ("symbol", "model"), ("r2", "time"), ("n_params",)))
def efficiency(spark, sf):
    df = evaluate.efficiency(fc.test_metrics(spark, sf), 27)
    return shaped(df, ("symbol", "model"), ("r2", "time"), ("n_params",))


@query(
    p.with_sql(PREDS, fc.metrics_sql(SYMBOL), """w AS (SELECT symbol, model, max(r2) FILTER (split = 'train') AS train_r2,
  max(r2) FILTER (split = 'test') AS test_r2 FROM met GROUP BY 1, 2)""",
               """g AS (SELECT *, train_r2 - test_r2 AS gap, CASE WHEN train_r2 - test_r2 < 0.05 THEN 'low'
  WHEN train_r2 - test_r2 < 0.10 THEN 'moderate' WHEN train_r2 - test_r2 < 0.30 THEN 'high'
  WHEN train_r2 - test_r2 >= 0.30 THEN 'severe' END AS category FROM w)""")
    + shaped_sql("g", ("symbol", "model"), ("train_r2", "test_r2", "gap"), (), ("category",))
)
def overfit_gap(spark, sf):
    df = evaluate.overfit_gap(fc.metrics(spark, sf), SYMBOL)
    return shaped(df, ("symbol", "model"), ("train_r2", "test_r2", "gap"), (), ("category",))
