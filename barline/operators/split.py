"""Chronological splits, folds, sequences and tails."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.rows import known_in_order
from barline.functions.windows import SERIES, by_series, series
from barline.session import materialise


def _split_of(position: Column, n: Column, train: float, val: float) -> Column:
    n_train = F.floor(n * F.lit(train))
    n_val = F.floor(n * F.lit(val))
    return F.when(position <= n_train, "train").when(position <= n_train + n_val, "val").otherwise("test")


def chrono_split(
    df: DataFrame, train: float = 0.70, val: float = 0.15, mode: str = "position", by: Sequence[str] = SERIES
) -> DataFrame:
    """Adds ``split``: the first rows train, the next validate, the rest test.

    ``position`` cuts every series by its own row count.  ``date`` cuts all series at the same
    two dates, found from the row counts per date, so that a pooled fit never trains on days
    another series is tested on.
    """
    if mode == "position":
        n = F.count(F.lit(1)).over(Window.partitionBy(*by))
        return df.withColumn("split", _split_of(F.row_number().over(series(by)), n, train, val))
    # One row per date: a calendar, however large the panel. It is written, as every later job would count again.
    per_date = df.groupBy("date").agg(F.count(F.lit(1)).alias("_rows"))
    ordered = Window.orderBy("date")
    cuts = per_date.select(
        "date",
        _split_of(
            F.sum("_rows").over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
            F.sum("_rows").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            train,
            val,
        ).alias("split"),
    )
    return df.join(F.broadcast(materialise(cuts)), "date")


def known_split(
    df: DataFrame, train: float = 0.70, val: float = 0.15, by: Sequence[str] = SERIES, only: str | None = None, in_order: bool = False
) -> DataFrame:
    """Rows without any missing value, with their ``split`` by position: ``fill.drop_warmup`` and :func:`chrono_split` in one pass.

    ``in_order`` states that the rows of a series lie one behind the other by date, as in a feature table; wide rows
    are then neither exchanged nor sorted.  ``only`` keeps the rows of one split.
    """

    def part(place: np.ndarray, n: np.ndarray) -> np.ndarray:
        n_train, n_val = np.floor(n * train), np.floor(n * val)
        return np.where(place <= n_train, "train", np.where(place <= n_train + n_val, "val", "test"))

    rows = df if in_order else by_series(df, by).sortWithinPartitions(*by, "date")
    return known_in_order(rows, by, "split", part, only)


def time_folds(df: DataFrame, k: int = 3, by: Sequence[str] = SERIES, mode: str = "position") -> DataFrame:
    """Adds ``fold`` 0..k-1: contiguous runs of rows, the first ``n mod k`` of them one row longer.

    ``position`` cuts every series by its own rows.  ``date`` cuts the calendar, so that no fold of a
    pooled fit holds dates that another fold trains on.
    """
    if mode == "date":
        dates = time_folds(df.select("date").distinct().withColumn("_all", F.lit(0)), k, ("_all",))
        return df.join(F.broadcast(dates.drop("_all")), "date")
    position = F.row_number().over(series(by)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    size, extra = F.floor(n / k), n % k
    longer = extra * (size + 1)
    fold = F.when(position < longer, F.floor(position / (size + 1))).otherwise(
        extra + F.floor(F.try_divide(position - longer, size))
    )
    return df.withColumn("fold", fold.cast("int"))


def sequences(df: DataFrame, columns: Sequence[str], length: int = 20, by: Sequence[str] = SERIES) -> DataFrame:
    """The last ``length`` feature rows as one array per row; a sequence never crosses a split."""
    w = series((*by, "split")).rowsBetween(-(length - 1), 0)
    rows = df.withColumn("sequence", F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w))
    return rows.where(F.size("sequence") == length)


def tail(df: DataFrame, n: int = 50, by: Sequence[str] = SERIES) -> DataFrame:
    """The last ``n`` rows of every series."""
    recent = Window.partitionBy(*by).orderBy(F.col("date").desc())
    return df.withColumn("_back", F.row_number().over(recent)).where(F.col("_back") <= n).drop("_back")
