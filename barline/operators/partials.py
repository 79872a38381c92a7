"""Counts, means and products of deviations of parts of the rows, merged in a tree."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

Partial = tuple[int, np.ndarray, np.ndarray]  # rows, means, sums of products of deviations
TREE = 32
SCHEMA = "part int, tree int, n bigint, mean binary, products binary"


def joined(a: Partial | None, b: Partial) -> Partial:
    """Moments of two disjoint sets of rows, from those of each."""
    if a is None or not a[0]:
        return b
    if not b[0]:
        return a
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def of_rows(x: np.ndarray) -> Partial:
    """Moments of the rows of a matrix."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    return len(x), mean, (x - mean).T @ (x - mean)


def as_batch(part: int, tree: int, found: Partial) -> pa.RecordBatch:
    n, mean, products = found
    columns = [pa.array([part], pa.int32()), pa.array([tree % TREE], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([products.tobytes()], pa.binary())], ["part", "tree", "n", "mean", "products"])


def _read(n: int, mean: bytes, products: bytes) -> Partial:
    means = np.frombuffer(mean)
    return int(n), means, np.frombuffer(products).reshape(len(means), len(means))


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    total = None
    for row in group.itertuples():
        total = joined(total, _read(row.n, row.mean, row.products))
    first = group.iloc[0]
    return pd.DataFrame([(first["part"], first["tree"], total[0], total[1].tobytes(), total[2].tobytes())], columns=list(group.columns))


def collected(partials: DataFrame) -> dict[int, Partial]:
    """Moments per ``part``; they are merged in ``TREE`` tasks before the driver sees them."""
    found: dict[int, Partial] = {}
    for r in partials.groupBy("part", "tree").applyInPandas(_merge, SCHEMA).orderBy("part", "tree").collect():  # at most TREE rows per part
        found[r["part"]] = joined(found.get(r["part"]), _read(r["n"], r["mean"], r["products"]))
    return found


# ---- many columns beside one ----------------------------------------------------------------------------

BESIDE = "tree int, found binary"


def beside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Six rows for the columns of ``x``: count, both means, both sums of squares and the sum of products with ``y``.

    Each column counts the rows where it and ``y`` are known.
    """
    known = ~np.isnan(x) & ~np.isnan(y)[:, None]
    n = known.sum(axis=0)
    some = np.maximum(n, 1)
    mx, my = np.where(known, x, 0).sum(axis=0) / some, np.where(known, y[:, None], 0).sum(axis=0) / some
    dx, dy = np.where(known, x - mx, 0), np.where(known, y[:, None] - my, 0)
    return np.stack([n, mx, my, (dx * dx).sum(axis=0), (dy * dy).sum(axis=0), (dx * dy).sum(axis=0)])


def beside_joined(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    if a is None:
        return b
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    dx, dy = b[1] - a[1], b[2] - a[2]
    weight = a[0] * share
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight])


def _tree_collected(found: DataFrame, size: int, join: Callable[[np.ndarray | None, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Arrays of ``size`` rows merged in ``TREE`` tasks and then on the driver."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for raw in group["found"]:
            total = join(total, np.frombuffer(raw).reshape(size, -1))
        return pd.DataFrame([(group["tree"].iloc[0], total.tobytes())], columns=["tree", "found"])

    total = None
    for r in found.groupBy("tree").applyInPandas(merge, BESIDE).orderBy("tree").collect():  # at most TREE rows
        total = join(total, np.frombuffer(r["found"]).reshape(size, -1))
    return total


def beside_collected(found: DataFrame) -> np.ndarray | None:
    return _tree_collected(found, 6, beside_joined)


# ---- shape of many columns -----------------------------------------------------------------------------


def shape(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Four rows for the columns of ``x``: count, mean and sums of squares and cubes of deviations of the known values.

    Values are taken from the first known one of their column, so a column of equal values has deviations of exactly zero.
    """
    n = known.sum(axis=0)
    some = np.maximum(n, 1)
    first = np.where(n > 0, x[known.argmax(axis=0), np.arange(x.shape[1])], 0.0)
    off = np.where(known, x - first, 0.0)
    mean = off.sum(axis=0) / some
    off = np.where(known, off - mean, 0.0)
    square = off * off
    return np.stack([n, first + mean, square.sum(axis=0), (square * off).sum(axis=0)])


def shape_joined(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """:func:`shape` of two disjoint sets of rows, from those of each."""
    if a is None:
        return b
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    d = b[1] - a[1]
    both = np.stack([
        n, a[1] + d * (b[0] / some), a[2] + b[2] + d * d * (a[0] * b[0] / some),
        a[3] + b[3] + d * d * d * (a[0] * b[0] * (a[0] - b[0]) / some**2) + 3 * d * ((a[0] * b[2] - b[0] * a[2]) / some),
    ])
    return np.where(a[0] == 0, b, np.where(b[0] == 0, a, both))


def shape_collected(found: DataFrame) -> np.ndarray | None:
    return _tree_collected(found, 4, shape_joined)
