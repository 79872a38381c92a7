"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barline.operators import choose, ensemble, evaluate, features, models, ordered, profile, select  # noqa: E402
from barline.operators import fill, split  # noqa: E402
from barline.session import local_session, materialise  # noqa: E402
from checks import forecasts as fc  # noqa: E402
from checks import panels as p  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def run(df) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "barline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, work):
        started = time.time()
        out = work()
        seconds[name] = round(time.time() - started, 3)
        return out

    run(p.bars(spark, "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf))  # JVM warm-up

    # From the files to bars and to the whole feature table.
    timed("bars_flag", lambda: run(p.bars(spark, sf, "flag")))
    timed("bars_supplier", lambda: run(p.bars(spark, sf)))
    bars = p.bars(spark, sf).persist()
    bars.count()
    timed("returns_and_lags", lambda: run(features.lags(features.returns(bars), ["return", "close"])))
    timed("rolling_return", lambda: run(features.rolling(features.returns(bars), "return", ("mean", "std"))))
    timed("feature_table_flag", lambda: run(p.feature_panel(spark, sf, "flag")))
    table = timed("feature_table_supplier", lambda: materialise(split.chrono_split(fill.clean(p.feature_panel(spark, sf)))))

    # Selection and one linear model on the feature table.
    train = table.where(F.col("split") == "train")
    columns = features.feature_columns(table)
    found = timed("correlation_156", lambda: profile.moments(train, [*columns, features.LABEL]))
    timed("inflation_filter", lambda: select.vif_steps(found.only(columns)))
    timed("mutual_information", lambda: profile.mi_scores(train, columns).collect())
    small = columns[:27]

    def ridge():
        rows, _ = models.model_rows(table, small)
        return models.fit_ridge(models.part(rows, "train"), 500.0)

    timed("ridge_27", ridge)

    # Evaluation on a stored predictions table.
    preds = materialise(fc.predictions(spark, sf))
    timed("regression_metrics", lambda: run(evaluate.regression_metrics(preds)))
    metrics = timed("metrics_by_symbol", lambda: materialise(evaluate.regression_metrics(preds, ["symbol"])))
    timed("classification_summary", lambda: run(evaluate.classification_summary(preds.where(F.col("split") == "val"))))
    test = preds.where(F.col("split") == "test")

    def blend():
        picks = choose.pick_heterogeneous(metrics.where(F.col("split") == "test"), by=["symbol"])
        weights = ensemble.power_weights(ensemble.ensemble_sizes(picks, ["symbol"]), by=["symbol"])
        run(ensemble.blend(test, weights, ["symbol"]))

    timed("blend_by_symbol", blend)
    timed("exact_quartiles", lambda: run(ordered.quantiles(preds, ["model"], "yhat", {"q1": 0.25, "q3": 0.75})))

    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
