"""Window specifications and trailing statistics of a series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barline.functions.rows import Series, divided, with_series

SERIES = ("symbol",)


def series(by: Sequence[str] = SERIES, order: str = "date") -> WindowSpec:
    """Rows of one series in time order.

    A daily panel holds at most one row per date in each series, so a window partition is
    bounded by the length of the calendar however many trades a symbol has.  For finer
    grains use :mod:`barline.operators.blocks`.
    """
    return Window.partitionBy(*by).orderBy(order)


def trailing(n: int, by: Sequence[str] = SERIES, order: str = "date") -> WindowSpec:
    """The last ``n`` rows up to and including the current one."""
    return series(by, order).rowsBetween(-(n - 1), 0)


def by_series(df: DataFrame, by: Sequence[str] = SERIES, partitions: int | None = None) -> DataFrame:
    """Spread the series over ``partitions``, by default the session's shuffle partitions.

    Window stages cost far more time per byte than a shuffle expects, so the number of
    partitions is stated and adaptive execution does not merge them by size.  Every later window
    by series reuses this exchange.
    """
    return df.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def few_groups(groups: DataFrame, few: bool) -> DataFrame:
    """Marks a table with one row per group for broadcast if the caller states that groups are ``few``.

    Groups of models, splits or features are: their number is set by a trial or column list.  Groups by
    any other key can be any number, and are left to the optimiser.
    """
    return F.broadcast(groups) if few else groups


STATISTICS = {"mean": F.avg, "std": F.stddev_samp}


def rolling_stat(x: Column, stat: str, n: int, by: Sequence[str] = SERIES, order: str = "date") -> Column:
    """``mean`` or ``std`` over the last ``n`` rows, NULL unless all ``n`` values are present; for short windows."""
    w = trailing(n, by, order)
    return F.when(F.count(x).over(w) == n, STATISTICS[stat](x).over(w))


# What a window keeps of its values, and the part of it each statistic needs.
POWERS = ("mean", "m2", "m3", "m4")  # the mean and the sums of powers of the deviations from it
KEPT = {"std": 2, "skew": 3, "kurt": 4}  # the mean comes from the plain sum, which is exact for whole numbers

Kept = dict[str, np.ndarray]


def _joined(a: Kept, na: int, b: Kept, nb: int) -> Kept:
    """What is kept of ``na + nb`` values, from what is kept of either part; NaN if a part is."""
    n, out = na + nb, {}
    for name, pick in (("max", np.maximum), ("min", np.minimum)):
        if name in a:
            out[name] = pick(a[name], b[name])
    if "sum" in a:
        out["sum"] = a["sum"] + b["sum"]
    if "mean" not in a:
        return out
    d = b["mean"] - a["mean"]
    out["mean"] = a["mean"] + d * (nb / n)
    d2 = d * d
    if "m2" in a:
        out["m2"] = a["m2"] + b["m2"] + d2 * (na * nb / n)
    if "m3" in a:
        out["m3"] = a["m3"] + b["m3"] + d2 * d * (na * nb * (na - nb) / n**2) + d * (b["m2"] * (3 * na / n) - a["m2"] * (3 * nb / n))
    if "m4" in a:
        out["m4"] = (
            a["m4"] + b["m4"] + d2 * d * d * (na * nb * (na * na - na * nb + nb * nb) / n**3)
            + d2 * (b["m2"] * (6 * na * na / n**2) + a["m2"] * (6 * nb * nb / n**2))
            + d * (b["m3"] * (4 * na / n) - a["m3"] * (4 * nb / n))
        )
    return out


Wanted = Mapping[str, tuple[Sequence[str], Sequence[int]]]


def rolled_names(wanted: Wanted) -> list[str]:
    """The columns of :func:`rolled`: skewness and kurtosis need four rows or more."""
    return [f"{c}_{s}_{n}" for c, (stats, windows) in wanted.items() for s in stats for n in windows if s not in ("skew", "kurt") or n > 3]


def rolled(series: Series, columns: Mapping[str, np.ndarray], wanted: Wanted) -> dict[str, np.ndarray]:
    """``<column>_<stat>_<n>`` over the last ``n`` rows of whole series.

    A window of n rows is its later half joined with the half before it, which a lag of that many rows brings
    up. So each halving (six for 60 rows) takes a fixed number of operations a row, and nothing is ever subtracted:
    an extreme value leaves no trace in the windows behind it.
    """
    out = {}
    for c, (stats, windows) in wanted.items():
        x = columns[c]
        zero = np.where(np.isnan(x), np.nan, 0.0)
        keep = [*POWERS[: max((KEPT[s] for s in stats if s in KEPT), default=0)], *[k for k, s in (("max", "max"), ("min", "min"), ("sum", "mean")) if s in stats]]
        pieces = {1: {k: zero if k in POWERS[1:] else x for k in keep}}

        def piece(n: int) -> Kept:
            if n not in pieces:
                near, far = n - n // 2, n // 2
                was = {k: series.lag(v, near) for k, v in piece(far).items()}
                pieces[n] = _joined(piece(near), near, was, far)
            return pieces[n]

        for s in stats:
            for n in windows:
                p = piece(n)
                if s == "mean":
                    out[f"{c}_{s}_{n}"] = p["sum"] / n
                elif s in p:
                    out[f"{c}_{s}_{n}"] = p[s]
                elif s == "std":
                    out[f"{c}_{s}_{n}"] = np.sqrt(p["m2"] / (n - 1)) if n > 1 else np.full_like(x, np.nan)
                elif n > 3:
                    out[f"{c}_{s}_{n}"] = skew_of(p, n) if s == "skew" else kurt_of(p, n)
    return out


def rolling_windows(df: DataFrame, wanted: Wanted, by: Sequence[str] = SERIES, order: str = "date") -> DataFrame:
    """Adds ``<column>_<stat>_<n>`` over the last ``n`` rows: ``mean, std, max, min, skew, kurt`` of several columns at once.

    A statistic is NULL unless all n values are present; skewness and kurtosis need four rows or more and are NULL
    in a flat window.
    """
    added = rolled_names(wanted)
    kinds = dict(df.dtypes)
    kind = {f"{c}_{s}_{n}": kinds[c] for c, (stats, windows) in wanted.items() for s in stats for n in windows if s in ("max", "min")}
    found = with_series(df, list(wanted), added, lambda series, columns: rolled(series, columns, wanted), by, order)
    return found.withColumns({n: F.col(n).cast(k) for n, k in kind.items() if k != "double"})


def skew_of(sums: Kept, n: int) -> np.ndarray:
    """Bias-corrected skewness of ``n`` values; NaN if all are equal."""
    scale = (n * (n - 1)) ** 0.5 / (n - 2)
    return divided(sums["m3"] / n, np.power(sums["m2"] / n, 1.5)) * scale


def kurt_of(sums: Kept, n: int) -> np.ndarray:
    """Bias-corrected excess kurtosis of ``n`` values; NaN if all are equal."""
    excess = divided(sums["m4"] * n, sums["m2"] * sums["m2"]) - 3
    return (excess * (n + 1) + 6.0) * ((n - 1) / ((n - 2) * (n - 3)))
