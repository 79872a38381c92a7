"""Scores of forecasts.

``predictions`` has one row per ``(model, split, symbol, date)`` with ``y`` and ``yhat``.  ``by``
adds grouping columns (typically ``symbol``) to any score; without it a score covers all series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.names import SEQUENCE_FAMILIES, model_family, sizes_in_name
from barline.functions.windows import few_groups
from barline.operators.ordered import quantiles, running_totals
from barline.operators.profile import bin_of, minmax

By = Sequence[str]


def regression_metrics(predictions: DataFrame, by: By = ()) -> DataFrame:
    """R2, RMSE, MAE and MAPE per model and split."""
    error = F.col("y") - F.col("yhat")
    return (
        predictions.groupBy(*by, "model", "split")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(error * error).alias("_sse"),
            F.avg(F.abs(error)).alias("mae"),
            F.avg(F.abs(F.try_divide(error, F.col("y")))).alias("mape"),
            (F.var_pop("y") * F.count("y")).alias("_sst"),
        )
        .select(
            *by, "model", "split", "n",
            (F.lit(1.0) - F.try_divide("_sse", "_sst")).alias("r2"),
            F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
            "mae", "mape",
        )
    )


def common_rows(predictions: DataFrame, row: By = ("split", "symbol", "date")) -> DataFrame:
    """The predictions on the rows that every model of the table covers.

    Scores on these rows compare models fairly: a model that has no forecast for the first rows of a
    split (a sequence model) is otherwise scored on an easier or harder set than the rest.
    """
    models = predictions.agg(F.countDistinct("model").alias("_models"))  # one row
    covered = F.size(F.collect_set("model").over(Window.partitionBy(*row)))
    marked = predictions.withColumn("_covered", covered).join(F.broadcast(models))
    return marked.where(F.col("_covered") == F.col("_models")).drop("_covered", "_models")


def direction(value: Column) -> Column:
    """1 for a positive value, else 0."""
    return (value > 0).cast("int")


def to_direction(predictions: DataFrame) -> DataFrame:
    """Adds the actual and the forecast direction."""
    return predictions.withColumns({"up": direction(F.col("y")), "up_hat": direction(F.col("yhat"))})


def confusion(predictions: DataFrame, by: By = ()) -> DataFrame:
    """Confusion counts of the direction, and each as a share of all."""
    up, up_hat = F.col("y") > 0, F.col("yhat") > 0
    counts = predictions.groupBy(*by, "model").agg(
        F.count_if(~up & ~up_hat).alias("tn"),
        F.count_if(~up & up_hat).alias("fp"),
        F.count_if(up & ~up_hat).alias("fn"),
        F.count_if(up & up_hat).alias("tp"),
    )
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return counts.withColumns({f"{c}_pct": F.try_divide(F.col(c) * 100.0, total) for c in ("tn", "fp", "fn", "tp")})


def class_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from confusion counts; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    return counts.withColumns(
        {
            "accuracy": share(tp + tn, tn + fp + fn + tp),
            "precision": share(tp, tp + fp),
            "recall": share(tp, tp + fn),
            "f1": share(2 * tp, 2 * tp + fp + fn),
        }
    )


def class_balance(predictions: DataFrame, by: By = ()) -> DataFrame:
    """Rows per model and direction, with their share of the model's rows."""
    counts = predictions.groupBy(*by, "model", direction(F.col("y")).alias("up")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by, "model"))
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def _by_score(predictions: DataFrame, by: By, bounded: bool) -> DataFrame:
    """Ups and downs per distinct forecast of a model, with those of all smaller forecasts."""
    up = F.col("y") > 0
    counts = {"pos": F.count_if(up), "neg": F.count_if(~up)}
    return running_totals(predictions, [*by, "model"], "yhat", counts, bounded=bounded)


def roc_auc(predictions: DataFrame, by: By = (), bounded: bool = False) -> DataFrame:
    """Area under the ROC curve of the direction, ties counted half; NULL for a single class.

    ``bounded`` states that no group outgrows a task, as with ``by`` series and their calendar.
    """
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    pairs = F.max("pos_all").cast("double") * F.max("neg_all")
    return _by_score(predictions, by, bounded).groupBy(*by, "model").agg(F.try_divide(F.sum(wins), pairs).alias("roc_auc"))


def roc_points(predictions: DataFrame, by: By = (), bounded: bool = False) -> DataFrame:
    """False and true positive rate for each distinct threshold, and the origin (threshold NULL)."""
    scores = _by_score(predictions, by, bounded)
    points = scores.select(
        *by, "model", F.col("yhat").alias("threshold"),
        F.try_divide((F.col("neg_all") - F.col("neg_before")).cast("double"), "neg_all").alias("fpr"),
        F.try_divide((F.col("pos_all") - F.col("pos_before")).cast("double"), "pos_all").alias("tpr"),
    )
    origin = predictions.select(*by, "model").distinct().select(
        *by, "model", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def score_scaling(predictions: DataFrame, by: By = ()) -> DataFrame:
    """Forecasts scaled to [0, 1] per model, which keeps their order."""
    return minmax(predictions, ["yhat"], [*by, "model"], epsilon=1e-8, few=not by)  # fixed value: 1e-8


def classification_summary(predictions: DataFrame, by: By = (), bounded: bool = False) -> DataFrame:
    """Confusion counts, class metrics and AUC of each model."""
    scored = class_metrics(confusion(predictions, by))
    return scored.join(roc_auc(predictions, by, bounded), [*by, "model"], "left")


def check_metrics(summary: DataFrame, predictions: DataFrame, tolerance: float = 0.01, by: By = ()) -> DataFrame:
    """Models whose accuracy contradicts their confusion counts or their forecasts; empty when all is well.

    The accuracy of the summary is held against its own counts and against the share of ``predictions``
    whose direction is right, counted from the rows.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    by_hand = F.coalesce(F.try_divide((tp + tn).cast("double"), tn + fp + fn + tp), F.lit(0.0))
    right = predictions.groupBy(*by, "model").agg(F.avg(((F.col("y") > 0) == (F.col("yhat") > 0)).cast("int")).alias("_right"))
    joined = summary.join(right, [*by, "model"], "left")
    wrong = (F.abs(F.col("accuracy") - by_hand) > tolerance) | (F.abs(F.col("accuracy") - F.coalesce("_right", F.lit(0.0))) > tolerance)
    return joined.where(wrong).drop("_right")


def format_summary(summary: DataFrame) -> DataFrame:
    """The summary table as published: four digits, ``N/A`` for a missing AUC, counts as they are."""

    def digits(column: str) -> Column:
        return F.format_string("%.4f", F.col(column))

    # The column names of the table.
    return summary.select(
        F.col("model").alias("模型"),
        digits("accuracy").alias("Accuracy"),
        digits("precision").alias("Precision"),
        digits("recall").alias("Recall"),
        digits("f1").alias("F1-Score"),
        F.when(F.coalesce("roc_auc", F.lit(0.0)) != 0, digits("roc_auc")).otherwise("N/A").alias("ROC-AUC"),
        *[F.col(c).alias(c.upper()) for c in ("tn", "fp", "fn", "tp")],
    )


def format_report(summary: DataFrame) -> DataFrame:
    """One text block per model, ready for a text file."""

    def line(label: str, column: str) -> Column:
        return F.format_string(f"- {label}: %.4f", F.col(column))

    def counts(label: str, first: str, second: str) -> Column:
        return F.format_string(f"{label}        %6d    %6d", F.col(first), F.col(second))

    # Wording and layout of the report.
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("## "), F.col("model")),
        F.lit(""),
        F.lit("**整体指标：**"),
        line("Accuracy", "accuracy"),
        line("Precision", "precision"),
        line("Recall", "recall"),
        line("F1-Score", "f1"),
        F.when(F.col("roc_auc") != 0, line("ROC-AUC", "roc_auc")),
        F.lit(""),
        F.lit("**混淆矩阵：**"),
        F.lit("```"),
        F.lit("                预测跌    预测涨"),
        counts("实际跌", "tn", "fp"),
        counts("实际涨", "fn", "tp"),
        F.lit("```"),
        F.lit(""),
        F.lit("-" * 80),
        F.lit(""),
    )
    return summary.select("model", block.alias("block"))


# --- tables behind the charts -------------------------------------------------------------


def model_class(name: Column) -> Column:
    """``sequence`` for recurrent models, ``tabular`` for all others."""
    return F.when(model_family(name).isin(*SEQUENCE_FAMILIES), "sequence").otherwise("tabular")


def family_summary(metrics: DataFrame, by: By = ()) -> DataFrame:
    """Mean, best and worst R2 per class of models."""
    return metrics.groupBy(*by, model_class(F.col("model")).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("r2").alias("mean_r2"), F.max("r2").alias("max_r2"), F.min("r2").alias("min_r2")
    )


def box_stats(metrics: DataFrame, by: By = ()) -> DataFrame:
    """Quartiles of R2 per class, whisker ends (furthest value within 1.5 IQR) and outlier count."""
    classed = metrics.withColumn("class", model_class(F.col("model")))
    keys = [*by, "class"]
    found = quantiles(classed, keys, "r2", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))  # fixed value: 1.5
    inside = F.col("r2").between(F.col("q1") - reach, F.col("q3") + reach)
    ends = classed.join(found, keys).groupBy(*keys).agg(
        F.min(F.when(inside, F.col("r2"))).alias("low"),
        F.max(F.when(inside, F.col("r2"))).alias("high"),
        F.count_if(~inside).alias("n_outliers"),
    )
    return found.join(ends, keys)


def residual_histogram(predictions: DataFrame, bins: int = 40, by: By = ()) -> DataFrame:
    """Residuals of each model counted in equal-width bins; empty bins have no row."""
    keys = [*by, "model"]
    residuals = predictions.select(*keys, (F.col("y") - F.col("yhat")).alias("residual"))
    spans = residuals.groupBy(*keys).agg(F.min("residual").alias("low"), F.max("residual").alias("high"))
    binned = residuals.join(few_groups(spans, not by), keys).withColumn(
        "bin", bin_of(F.col("residual"), F.col("low"), F.col("high"), bins)
    )
    return binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def metric_heatmap(metrics: DataFrame, by: By = ()) -> DataFrame:
    """R2, -RMSE and -MAE of each model, each scaled to [0, 1] over the models, in long form."""
    rows = metrics.select(
        *by, "model", F.col("r2").alias("R2"), (-F.col("rmse")).alias("RMSE"), (-F.col("mae")).alias("MAE")
    ).unpivot([*by, "model"], ["R2", "RMSE", "MAE"], "metric", "value")
    return minmax(rows, ["value"], [*by, "metric"], few=not by)


def estimate_params(metrics: DataFrame, n_features: int) -> DataFrame:
    """Rough parameter count from the sizes in a model's name."""
    sizes = sizes_in_name(F.col("model"))
    recurrent = model_family(F.col("model")).isin(*SEQUENCE_FAMILIES)
    hidden, layers = F.get(sizes, F.lit(0)).cast("bigint"), F.get(sizes, F.lit(1)).cast("bigint")
    # 3 gates, 10 per tabular feature, 1000 when the name carries no sizes.
    count = F.when(recurrent, F.coalesce(hidden * hidden * layers * 3, F.lit(1000))).otherwise(n_features * 10)
    return metrics.withColumn("n_params", count.cast("bigint"))


def efficiency(metrics: DataFrame, n_features: int) -> DataFrame:
    """Parameter estimate, training time (1.0 when unknown) and R2 of each model."""
    time = F.coalesce(F.col("time"), F.lit(1.0)) if "time" in metrics.columns else F.lit(1.0)
    return estimate_params(metrics, n_features).withColumn("time", time)


def overfit_gap(metrics: DataFrame, by: By = ()) -> DataFrame:
    """R2 on train minus R2 on test, with a category."""
    wide = metrics.groupBy(*by, "model").agg(
        F.max(F.when(F.col("split") == "train", F.col("r2"))).alias("train_r2"),
        F.max(F.when(F.col("split") == "test", F.col("r2"))).alias("test_r2"),
    )
    gap = F.col("gap")
    # Borders of the categories.
    category = F.when(gap < 0.05, "low").when(gap < 0.10, "moderate").when(gap < 0.30, "high").when(gap >= 0.30, "severe")
    return wide.withColumn("gap", F.col("train_r2") - F.col("test_r2")).withColumn("category", category)


# --- attribution of linear models ---------------------------------------------------------


def linear_attribution(
    rows: DataFrame, coefficients: dict[str, float], means: dict[str, float], keys: By = ("symbol", "date"),
    n: int | None = None,
) -> DataFrame:
    """Contribution ``coefficient * (x - mean)`` of each feature to each row.

    ``n`` takes the first rows of every series only, as a report does.
    """
    if n is not None:
        first = Window.partitionBy(*keys[:-1]).orderBy(keys[-1])
        rows = rows.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= n)
    parts = rows.select(
        *keys, *[((F.col(c) - F.lit(means[c])) * F.lit(b)).alias(c) for c, b in coefficients.items()]
    )
    return parts.unpivot(list(keys), list(coefficients), "feature", "attribution")


def attribution_rank(attributions: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` features with the largest mean absolute attribution."""
    scores = attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
    place = F.row_number().over(Window.orderBy(F.col("mean_abs").desc(), "feature"))
    return scores.withColumn("place", place).where(F.col("place") <= n)
