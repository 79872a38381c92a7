"""Files: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.windows import series
from barline.operators import features, models
from barline.session import shared_folder
from barline.sources import bars as bar_source
from barline.sources import sinks
from checks import forecasts as fc
from checks import panels as p
from checks.feature_queries import FLAG, KEYS, SUPPLIER
from checks.model_queries import TWO, two_features
from checks.registry import query, shaped, shaped_sql

PRICES = bar_source.PRICE_COLUMNS


@query(p.with_sql(SUPPLIER) + shaped_sql("bars", KEYS, PRICES))
def bars_from_csv(spark, sf):
    """Bars written as CSV and scanned with the declared schema."""
    path = shared_folder(spark, "bars-csv")
    sinks.write_csv(p.lineitem_bars(p.table(spark, sf, "lineitem"), "l_suppkey"), path)
    return shaped(bar_source.read_bars(spark, path), KEYS, PRICES)


@query(p.with_sql(FLAG) + shaped_sql("bars", KEYS, PRICES))
def bars_from_sorted_parquet(spark, sf):
    """Bars written by series in time order."""
    path = shared_folder(spark, "bars-parquet")
    bar_source.write_sorted(p.lineitem_bars(p.table(spark, sf, "lineitem"), "l_returnflag"), path)
    return shaped(bar_source.read_bars(spark, path, "parquet"), KEYS, PRICES)


@query(
    p.with_sql(SUPPLIER, f"x AS (SELECT *, row_number() OVER {p.SERIES} AS place FROM bars)")
    + shaped_sql("x", KEYS, ("close",), ("place",))
)
def rows_in_date_order(spark, sf):
    """The order every window works in, made visible as a row number."""
    df = p.bars(spark, sf).withColumn("place", F.row_number().over(series()))
    return shaped(df, KEYS, ("close",), ("place",))


@query(p.with_sql(SUPPLIER, p.added("x", "bars", p.RETURN_SQL)) + shaped_sql("x", KEYS, list(p.RETURN_SQL)))
def feature_snapshot(spark, sf):
    """Computed and written at the first call, read at the second; the key is that of the trades' files."""
    path, key = shared_folder(spark, "snapshot"), sinks.fingerprint("returns", sinks.file_key(spark, f"{sf}/lineitem.parquet"))
    sinks.snapshot(spark, lambda: features.returns(p.bars(spark, sf)), path, key)

    def not_again():
        raise AssertionError("the snapshot should have been read")

    return shaped(sinks.snapshot(spark, not_again, path, key), KEYS, list(p.RETURN_SQL))


@query(p.with_sql(fc.test_metrics_sql()) + shaped_sql("tm", ("model",), {"r2": 5, "rmse": 5, "mae": 5}))
def metrics_json(spark, sf):
    path = shared_folder(spark, "metrics-json")
    sinks.write_metrics_json(fc.test_metrics(spark, sf), path)
    schema = "model string, scores struct<r2:double,rmse:double,mae:double>"
    return shaped(
        spark.read.schema(schema).json(path).select("model", "scores.*"), ("model",), {"r2": 5, "rmse": 5, "mae": 5}
    )


@query()
def stored_model_scores(spark, sf):
    """A model fitted and saved at the first call, loaded at the second; both forecast the same."""
    from pyspark.ml.regression import LinearRegression

    rows, _ = models.model_rows(two_features(spark, sf), TWO)
    path = shared_folder(spark, "model")
    estimator = LinearRegression(regParam=0.1)
    fitted = sinks.fit_or_load(estimator, models.part(rows, "train"), path)
    loaded = sinks.fit_or_load(estimator, models.part(rows, "train"), path)
    test = models.part(rows, "test")
    both = models.predict(fitted, test, "fitted").unionByName(models.predict(loaded, test, "loaded"))
    return both.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("yhat").alias("mean_yhat"))
