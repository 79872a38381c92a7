"""Missing values: filters and fills.  For series that outgrow a task ``blocks.Blocks`` has the same fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barline.functions.windows import SERIES, series
from barline.operators.features import KEYS, LABEL


def labelled(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows whose label is known."""
    return df.where(F.col(label).isNotNull())


def drop_warmup(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without any NULL, in all or in the given columns."""
    return df.dropna("any", subset=list(columns) if columns else None)


def _so_far(by: Sequence[str]) -> WindowSpec:
    return series(by).rowsBetween(Window.unboundedPreceding, 0)


def ffill(df: DataFrame, columns: Sequence[str], by: Sequence[str] = SERIES) -> DataFrame:
    """NULLs take the last known value of their series."""
    so_far = _so_far(by)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})


def bfill(df: DataFrame, columns: Sequence[str], by: Sequence[str] = SERIES) -> DataFrame:
    """NULLs take the next known value of their series.

    The order is reversed so that the frame grows row by row; a frame open to the following
    side would be evaluated anew for each row.
    """
    reverse = Window.partitionBy(*by).orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(reverse) for c in columns})


def clean(df: DataFrame, label: str = LABEL, by: Sequence[str] = SERIES) -> DataFrame:
    """Labelled rows with features filled forward, then back, then with zero.

    After the forward fill only the head of a series can be NULL, so the back fill is the first
    known value of the series: both come from one pass over one window order.
    """
    rows = labelled(df, label)
    columns = [c for c in rows.columns if c not in {*KEYS, *by, label}]
    so_far, whole = _so_far(by), series(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.first(c, ignorenulls=True).over(whole), F.lit(0)) for c in columns}
    )
