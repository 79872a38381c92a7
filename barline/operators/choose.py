"""Choosing models from a metrics table.

A metrics table has one row per model (and per ``by`` group); windows over it see the models of
one group only, a number set by the trial list and not by the data.  Ties in R2 go by name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barline.functions.names import (
    ENSEMBLE_MARK,
    SEQUENCE_FAMILIES,
    TREE_FAMILIES,
    family_kind,
    model_family,
    round_in_name,
    sizes_in_name,
)

By = Sequence[str]

# R2 floors per family in a sweep, and of the later stages.
SWEEP_FLOORS = {"XGB": -0.2, "LGB": -0.2, "RF": -0.2, "GRU": -0.5, "LSTM": -0.5, "Ridge": -0.1}
DISPLAY_FLOOR = CANDIDATE_FLOOR = -0.05
HETEROGENEOUS_FLOOR = -0.1
# How many models of a family a display shows (None: all), tested in this order.
DISPLAY_CAPS = {"Ensemble": 1, "XGB": 2, "LGB": 2, "RF": 2, "GRU": 2, "LSTM": 2, "Ridge": None}
DISPLAY_LIMIT, CANDIDATE_LIMIT = 15, 5
# Order of preference inside a kind.
PREFERENCE = {"GRU": 1, "LSTM": 2, "Ridge": 1, "LGB": 1, "XGB": 2, "RF": 3}


def best_first(*by: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(F.col("r2").desc(), "model")


def metric_floor(metrics: DataFrame, floors: Mapping[str, float]) -> DataFrame:
    """Models above the R2 floor of their family; families without a floor go."""
    table = metrics.sparkSession.createDataFrame(list(floors.items()), "family string, floor double")
    named = metrics.withColumn("family", model_family(F.col("model")))
    return named.join(F.broadcast(table), "family").where(F.col("r2") > F.col("floor")).drop("floor")


def top_per_family(metrics: DataFrame, k: int = 3, by: By = ()) -> DataFrame:
    """The ``k`` best models of each family and search round."""
    named = metrics.withColumns({"family": model_family(F.col("model")), "round": round_in_name(F.col("model"))})
    ranked = named.withColumn("place", F.row_number().over(best_first(*by, "family", "round")))
    return ranked.where(F.col("place") <= k)


def parse_trial_name(metrics: DataFrame) -> DataFrame:
    """Sizes and search round carried by a model's name."""
    sizes = sizes_in_name(F.col("model"))
    return metrics.withColumns(
        {
            "family": model_family(F.col("model")),
            "size_1": F.get(sizes, F.lit(0)),
            "size_2": F.get(sizes, F.lit(1)),
            "round": round_in_name(F.col("model")),
        }
    )


def leaderboard(metrics: DataFrame, by: By = ()) -> DataFrame:
    """Models by falling R2; the first is the best."""
    place = F.row_number().over(best_first(*by))
    return metrics.withColumns({"place": place, "best": place == 1})


def display_models(metrics: DataFrame, by: By = ()) -> DataFrame:
    """A mixed selection for display: a cap per family, an R2 floor and an overall limit."""
    named = metrics.where(F.col("r2") >= DISPLAY_FLOOR).withColumn(
        "family", model_family(F.col("model"), tuple(DISPLAY_CAPS))
    )
    in_family = named.withColumn("_nth", F.row_number().over(best_first(*by, "family")))
    allowed = F.lit(False)
    for family, cap in DISPLAY_CAPS.items():
        own = F.col("family") == family
        allowed = allowed | (own if cap is None else own & (F.col("_nth") <= cap))
    shown = in_family.where(allowed).withColumn("place", F.row_number().over(best_first(*by)))
    return shown.where(F.col("place") <= DISPLAY_LIMIT).drop("_nth")


def classification_candidates(metrics: DataFrame, by: By = ()) -> DataFrame:
    """All blends, then the best others above the floor until there are five in total."""
    blend = F.col("model").contains(ENSEMBLE_MARK)
    counted = metrics.withColumn("_blends", F.count_if(blend).over(Window.partitionBy(*by)))
    blends = counted.where(blend).withColumn("stage", F.lit(1))
    others = (
        counted.where(~blend & (F.col("r2") >= CANDIDATE_FLOOR))
        .withColumn("_nth", F.row_number().over(best_first(*by)))
        .where(F.col("_nth") <= CANDIDATE_LIMIT - F.col("_blends"))
        .drop("_nth")
        .withColumn("stage", F.lit(2))
    )
    order = Window.partitionBy(*by).orderBy("stage", F.col("r2").desc(), "model")
    return blends.unionByName(others).withColumn("place", F.row_number().over(order)).drop("_blends")


def pick_threshold(
    metrics: DataFrame,
    threshold: float,
    caps: Mapping[str, int],
    floor: float | None = None,
    most: int = 5,
    least: int = 3,
    by: By = (),
) -> DataFrame:
    """Models above ``threshold``, families capped, at most ``most``.

    With fewer than ``least`` the next best fill up, except from a capped family that already
    has a pick.  ``floor`` excludes models from both steps.
    """
    rows = metrics.withColumn("family", model_family(F.col("model")))
    if floor is not None:
        rows = rows.where(F.col("r2") > floor)
    capped = F.col("family").isin(*caps) if caps else F.lit(False)
    room = F.lit(True)
    for family, cap in caps.items():
        room = room & ((F.col("family") != family) | (F.col("_in_family") <= cap))
    rows = rows.withColumn("_in_family", F.row_number().over(best_first(*by, "family")))
    rows = rows.withColumn("_able", (F.col("r2") > threshold) & room)
    rows = rows.withColumn("_rank", F.row_number().over(best_first(*by, "_able")))
    rows = rows.withColumn("_first", F.col("_able") & (F.col("_rank") <= most))
    rows = rows.withColumns(
        {
            "_picked": F.count_if("_first").over(Window.partitionBy(*by)),
            "_family_picked": F.count_if("_first").over(Window.partitionBy(*by, "family")),
        }
    )
    rows = rows.withColumn("_spare", ~F.col("_first") & ~(capped & (F.col("_family_picked") > 0)))
    rows = rows.withColumn("_spare_rank", F.row_number().over(best_first(*by, "_spare")))
    chosen = rows.where(F.col("_first") | (F.col("_spare") & (F.col("_spare_rank") <= least - F.col("_picked"))))
    order = Window.partitionBy(*by).orderBy(F.col("_first").desc(), F.col("r2").desc(), "model")
    return chosen.withColumn("pick", F.row_number().over(order)).select(*metrics.columns, "family", "pick")


def pick_heterogeneous(metrics: DataFrame, floor: float = HETEROGENEOUS_FLOOR, by: By = ()) -> DataFrame:
    """One model of each kind: recurrent, ridge, tree.

    Inside a kind the preferred family with a model above ``floor`` wins.  A kind without such a
    model is filled up with its best model, whatever its score.
    """
    rows = metrics.withColumn("family", model_family(F.col("model"))).where(F.col("family") != "Other")
    rows = rows.withColumn("kind", family_kind(F.col("family")))
    preference = F.coalesce(*[F.when(F.col("family") == f, F.lit(p)) for f, p in PREFERENCE.items()])
    in_kind = Window.partitionBy(*by, "kind").orderBy(F.col("_good").desc(), "_preference", F.col("r2").desc(), "model")
    rows = rows.withColumn("_good", F.col("r2") > floor)
    rows = rows.withColumn("_preference", F.when(F.col("_good"), preference).otherwise(0))
    chosen = rows.withColumn("_nth", F.row_number().over(in_kind)).where(F.col("_nth") == 1)
    slot = F.when(F.col("kind") == "DL", 1).when(F.col("kind") == "Ridge", 2).otherwise(3)
    order = Window.partitionBy(*by).orderBy(
        F.col("_good").desc(), F.when(F.col("_good"), slot).otherwise(0), F.col("r2").desc(), "model"
    )
    return chosen.withColumn("pick", F.row_number().over(order)).select(*metrics.columns, "family", "kind", "pick")


def pick_validation_bases(metrics: DataFrame, by: By = ()) -> DataFrame:
    """Best model of each kind with a positive R2, blends excluded, best first."""
    name = F.col("model")
    recurrent = F.lit(False)
    for mark in SEQUENCE_FAMILIES:
        recurrent = recurrent | name.startswith(mark)
    tree = F.lit(False)
    for mark in TREE_FAMILIES:
        tree = tree | name.contains(mark)
    kind: Column = F.when(recurrent, "DL").when(name.contains("Ridge"), "Ridge").when(tree, "Tree").otherwise("Other")
    rows = metrics.where(~name.startswith(ENSEMBLE_MARK) & (F.col("r2") > 0)).withColumn("kind", kind)
    best = rows.withColumn("_nth", F.row_number().over(best_first(*by, "kind"))).where(F.col("_nth") == 1)
    return best.withColumn("pick", F.row_number().over(best_first(*by))).drop("_nth")


def last_wins(*tables: DataFrame, key: Sequence[str] = ("model",)) -> DataFrame:
    """Union in which a later table replaces the rows of an earlier one with the same key."""
    stacked = None
    for i, t in enumerate(tables):
        t = t.withColumn("_from", F.lit(i))
        stacked = t if stacked is None else stacked.unionByName(t)
    latest = Window.partitionBy(*key).orderBy(F.col("_from").desc())
    return stacked.withColumn("_nth", F.row_number().over(latest)).where(F.col("_nth") == 1).drop("_from", "_nth")


