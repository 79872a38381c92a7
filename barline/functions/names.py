"""Expressions over model and trial names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name fragments that decide a model's family, first match wins.
FAMILIES = ("GRU", "LSTM", "Ridge", "XGB", "LGB", "RF")
SEQUENCE_FAMILIES = ("GRU", "LSTM")
TREE_FAMILIES = ("XGB", "LGB", "RF")
ENSEMBLE_MARK = "Ensemble"


def model_family(name: Column, marks: tuple[str, ...] = FAMILIES) -> Column:
    """The first of ``marks`` found in the name; ``Other`` if there is none."""
    return F.coalesce(*[F.when(name.contains(m), F.lit(m)) for m in marks], F.lit("Other"))


def family_kind(family: Column) -> Column:
    """Coarse kind of a family: ``DL``, ``Ridge``, ``Tree`` or ``Other``."""
    return (
        F.when(family.isin(*SEQUENCE_FAMILIES), "DL")
        .when(family == "Ridge", "Ridge")
        .when(family.isin(*TREE_FAMILIES), "Tree")
        .otherwise("Other")
    )


def sizes_in_name(name: Column) -> Column:
    """The all-digit parts of an underscore-separated name, as integers."""
    parts = F.filter(F.split(name, "_"), lambda p: p.rlike("^[0-9]+$"))
    return F.transform(parts, lambda p: p.cast("int"))


def round_in_name(name: Column) -> Column:
    """Search round tagged in the name (``R2`` or ``R3``), else 1."""
    return F.when(name.contains("R2"), 2).when(name.contains("R3"), 3).otherwise(1)


def trial_name(family: Column, trees: Column, depth: Column, rate: Column | None = None) -> Column:
    """Name composed of the parameters, the rate in whole thousandths."""
    if rate is None:
        return F.format_string("%s_%d_%d", family, trees.cast("int"), depth.cast("int"))
    return F.format_string(
        "%s_%d_%d_%d", family, trees.cast("int"), depth.cast("int"), (rate * 1000).cast("int")
    )
