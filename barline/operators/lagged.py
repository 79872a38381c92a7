"""Regression on sequences of rows without writing the sequences.

The products of all pairs of places in a window differ between places only at the ends of a run of rows:
moving both places back by one drops the last product and adds one before the first. So the table of all
products of ``length`` rows of k columns needs the products of a row with the ``length`` rows up to it, made
in one pass, and corrections at both ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.windows import SERIES, series
from barline.operators.blocks import Blocks
from barline.operators.features import LABEL
from barline.operators.models import ridge_solution
from barline.operators.partials import SCHEMA, Partial, as_batch, collected, joined
from barline.operators.profile import Moments, moments_from
from barline.session import importable


def window_sums(x: np.ndarray, y: np.ndarray, length: int) -> Partial | None:
    """Moments of ``length`` consecutive rows of ``x`` side by side, oldest first, and of ``y`` of the last of them.

    Windows whose ``y`` is missing are left out; ``x`` has no missing value.
    """
    n, k = len(x) - length + 1, x.shape[1]
    if n < 1:
        return None
    size = length * k
    products, sums = np.zeros((size + 1, size + 1)), np.zeros(size + 1)
    ends = y[length - 1 :]
    known = ~np.isnan(ends)
    label = np.where(known, ends, 0.0)
    newest = x[length - 1 :]
    for j in range(length):
        rows = x[j : j + n]
        at = slice(j * k, j * k + k)
        sums[at], products[-1, at] = rows.sum(axis=0), label @ rows
        products[size - k : size, at] = newest.T @ rows
    head, tail = x[: length - 1].ravel(), x[n:].ravel()
    for j in range(length - 1, 0, -1):
        before, upto = slice(j * k - k, j * k), j * k
        products[before, :upto] = (
            products[j * k : j * k + k, k : upto + k] + np.outer(head[before], head[:upto]) - np.outer(tail[before], tail[:upto])
        )
    products = np.tril(products) + np.tril(products, -1).T
    sums[-1], products[-1, -1] = label.sum(), label @ label
    for t in np.flatnonzero(~known):
        window = np.append(x[t : t + length].ravel(), 0.0)
        products -= np.outer(window, window)
        sums -= window
    count = int(known.sum())
    if not count:
        return None
    return count, sums / count, products - np.outer(sums, sums) / count


def _partials(k: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, group, place = None, None, None
        x, y = np.zeros((0, k)), np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, places = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]).astype(float)
            whole = ~np.isnan(values[:, :k]).any(axis=1)
            follows = np.append((groups[0] == group) & (places[0] - 1 == place), (np.diff(groups) == 0) & (np.diff(places) == 1))
            # A row with a missing feature is in no window, as if the rows behind it began another run.
            cuts = np.flatnonzero(~follows | ~whole)
            for start, end in zip(np.append(0, cuts), np.append(cuts, len(values))):
                if start < len(values) and start in cuts:
                    x, y = np.zeros((0, k)), np.zeros(0)
                rows = values[start:end][whole[start:end]]
                x, y = np.concatenate([x, rows[:, :k]]), np.concatenate([y, rows[:, k]])
                found = window_sums(x, y, length)
                if found:
                    total = joined(total, found)
                x, y = x[len(x) - min(len(x), length - 1) :], y[len(y) - min(len(y), length - 1) :]
            group, place = groups[-1], places[-1]
        if total is not None:
            yield as_batch(0, TaskContext.get().partitionId(), total)

    return run


def sequence_moments(
    df: DataFrame, columns: Sequence[str], length: int = 20, label: str = LABEL, by: Sequence[str] = SERIES, block_rows: int = 4096, grain: str = "month",
    in_order: bool = False,
) -> Moments | None:
    """Moments of the last ``length`` rows of ``columns`` side by side, oldest first, and of the label; None without a window.

    Each row passes once, with k values, and ``length - 1`` rows of every ``block_rows`` twice; a long series is spread over
    tasks by its blocks. Windows with a missing feature or label are left out. The columns have to be scaled: their
    products are centred after they are summed. ``length * k`` numbers squared come from each task.

    ``in_order`` states that the rows of a series lie one behind the other by date, as in a feature table: they are then
    neither numbered nor exchanged, and no more of a series than a batch is held.
    """
    columns = list(columns)
    importable(df.sparkSession)
    needed = df.select(*by, "date", *[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias(label))
    if in_order:
        rows = needed.select(F.xxhash64(*by).alias("_group"), F.monotonically_increasing_id().alias("_pos"), *columns, label)
    else:
        rows = Blocks(needed, block_rows, by, grain=grain).copied(length - 1, 0)
        rows = rows.select(F.xxhash64(*by, "_block").alias("_group"), F.col("_pos").cast("bigint").alias("_pos"), *columns, label)
        rows = rows.repartition("_group").sortWithinPartitions("_group", "_pos")
    found = collected(rows.mapInArrow(_partials(len(columns), length), SCHEMA)).get(0)
    return found and moments_from([f"{c}_{length - 1 - j}" for j in range(length) for c in columns] + [label], found)


def sequence_ridge(found: Moments, alpha: float) -> tuple[np.ndarray, float]:
    """Weights, oldest row first, and intercept of the ridge regression on sequences."""
    return ridge_solution(found, alpha)


def _added_up(places: np.ndarray, intercept: float):
    """Sums of the rows of a run times the weights of their places; a run is a group without a gap in it."""
    length, k = places.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, dots, whole = None, np.zeros((0, length)), np.zeros(0, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, inputs = batch.column(0).to_numpy(), batch.columns[1 : k + 1]
            known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in inputs])
            with np.errstate(all="ignore"):
                new = np.column_stack([c.to_numpy(zero_copy_only=False) for c in inputs]).astype(float) @ places.T
            cuts = np.flatnonzero(np.append(groups[0] != group, np.diff(groups) != 0))
            yhat, full = np.zeros(len(groups)), np.zeros(len(groups), bool)
            for start, end in zip(np.unique(np.append(0, cuts)), np.append(cuts[cuts > 0], len(groups))):
                if start in cuts:
                    dots, whole = np.zeros((0, length)), np.zeros(0, bool)
                dots, whole = np.concatenate([dots, new[start:end]]), np.concatenate([whole, known[start:end]])
                n = len(dots) - length + 1
                if n > 0:  # the last n rows have a sequence
                    upto = np.cumsum(np.append(0, ~whole))
                    full[end - n : end] = upto[length:] == upto[: n]
                    for j in range(length):
                        yhat[end - n : end] += dots[j : j + n, j]
                keep = min(len(dots), length - 1)
                dots, whole = dots[len(dots) - keep :], whole[len(whole) - keep :]
            group = groups[-1]
            columns = [*batch.columns[k + 1 :], pa.array(yhat + intercept)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[k + 1 :], "yhat"]).filter(pa.array(full))

    return run


def sequence_forecasts(
    df: DataFrame, columns: Sequence[str], weights: np.ndarray, intercept: float, name: str, label: str = LABEL, by: Sequence[str] = SERIES,
    in_order: bool = False,
) -> DataFrame:
    """Forecasts in the layout of the predictions table, for rows whose sequence lies in their split and has no missing value.

    A row is multiplied with the weights of each place once; the window adds up these ``length`` numbers. ``in_order``
    states that the rows of a series lie one behind the other by date, as in a feature table; nothing is exchanged then.
    """
    columns, places = list(columns), np.asarray(weights).reshape(-1, len(columns))
    if in_order:
        importable(df.sparkSession)
        kept = df.select(F.lit(name).alias("model"), "split", *by, "date", F.col(label).cast("double").alias("y"))
        inputs = [F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]
        rows = df.select(F.xxhash64(*by, "split").alias("_group"), *inputs, F.lit(name).alias("model"), "split", *by, "date", F.col(label).cast("double").alias("y"))
        return rows.mapInArrow(_added_up(places, intercept), T.StructType([*kept.schema.fields, T.StructField("yhat", T.DoubleType())]))
    known = [F.col(c).cast("double") for c in columns]
    dots = F.array(*[sum((x * F.lit(float(w)) for x, w in zip(known[1:], place[1:])), known[0] * F.lit(float(place[0]))) for place in places])
    w, last = series((*by, "split")), len(places) - 1
    terms = [F.lag(F.col("_dots")[j], last - j).over(w) if j < last else F.col("_dots")[j] for j in range(last + 1)]
    rows = df.select(*by, "date", "split", F.col(label).cast("double").alias("y"), dots.alias("_dots"))
    rows = rows.withColumn("yhat", sum(terms, F.lit(float(intercept)))).where(F.col("yhat").isNotNull())
    return rows.select(F.lit(name).alias("model"), "split", *by, "date", "y", "yhat")
