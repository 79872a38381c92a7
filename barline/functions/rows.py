"""Whole series as arrays: columns that look along a series, computed a few series at a time.

The rows of a series become one array, several such arrays reach a task's function as numpy columns, and
the arrays are spread into rows again. A step right behind another one goes on with the arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.session import importable

BATCH_ROWS = 1 << 13  # rows handled at once, or one series if it has more


class Series:
    """Rows of whole series one behind the other, each in its order; a missing value is NaN."""

    def __init__(self, ends: np.ndarray):
        """``ends`` holds the row number behind each series."""
        starts = np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        self.bounds = list(zip(starts.tolist(), ends.tolist()))
        self.place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
        self._left = np.repeat(ends, sizes) - np.arange(len(self.place)) - 1
        self._outside: dict[int, np.ndarray] = {}

    def lag(self, x: np.ndarray, k: int) -> np.ndarray:
        """Values ``k`` rows back, ahead if ``k`` is negative; NaN outside the series."""
        if k not in self._outside:
            self._outside[k] = np.flatnonzero(self.place < k if k >= 0 else self._left < -k)
        out = np.empty_like(x)
        n = min(abs(k), len(x))
        if k >= 0:
            out[n:] = x[: len(x) - n]
        else:
            out[: len(x) - n] = x[n:]
        out[self._outside[k]] = np.nan
        return out


def divided(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    """``a / b``, NaN where ``b`` is zero."""
    return a / np.where(b == 0, np.nan, b)


Compute = Callable[[Series, dict[str, np.ndarray]], Mapping[str, np.ndarray]]


def _run(reads: Sequence[str], kept: Sequence[str], added: Sequence[str], compute: Compute, order: str):
    def of_series(rows: pa.ListArray) -> pa.ListArray:
        sizes = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values, ends = rows.flatten(), np.cumsum(sizes)
        names = [f.name for f in values.type]
        at = values.field(names.index(order)) if len(values) else pa.array([], pa.int64())
        keys = pa.table({"series": np.repeat(np.arange(len(sizes)), sizes), "at": at})
        sort = pc.sort_indices(keys, sort_keys=[("series", "ascending"), ("at", "ascending")], null_placement="at_start")
        sorted_ = dict(zip(names, values.take(sort).flatten()))
        columns = {n: sorted_[n] for n in kept}
        numbers = {n: columns[n].to_numpy(zero_copy_only=False).astype(float) for n in reads}
        with np.errstate(all="ignore"):
            found = compute(Series(ends), numbers)
        # NaN of the result is NULL again.
        fields = [*columns.values(), *[pa.array(found[n], pa.float64(), from_pandas=True) for n in added]]
        out = pa.StructArray.from_arrays(fields, [*columns, *added])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), out)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = batch.value_lengths().to_numpy(zero_copy_only=False)
            first = taken = 0
            for i, n in enumerate(sizes.tolist()):
                if i > first and taken + n > BATCH_ROWS:
                    yield of_series(batch.slice(first, i - first))
                    first, taken = i, 0
                taken += n
            if first < len(sizes):
                yield of_series(batch.slice(first))

    return run


def with_series(
    df: DataFrame, reads: Sequence[str], added: Sequence[str], compute: Compute, by: Sequence[str], order: str = "date"
) -> DataFrame:
    """``df`` with the double columns ``added``, made by ``compute`` from the columns ``reads`` of whole series.

    ``compute`` gets a :class:`Series` and the columns as doubles, a missing value as NaN, and returns the added
    ones likewise. A series has to fit a task, as with any window by series.
    """
    importable(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (*by, *added)]
    double = {f.name for f in kept if isinstance(f.dataType, T.DoubleType)}
    # Columns that are no doubles, or are keys, are read under names of their own.
    cast = {n: F.col(n).cast("double").alias(f"_as_double_{n}") for n in dict.fromkeys(reads) if n not in double}
    row = [F.col(f.name) for f in kept] + list(cast.values())
    if order in by:
        raise ValueError(f"{order} orders the rows of a series and cannot be a key of it")
    # Series in the order of their keys, so that a task that runs again gives its rows in the same order.
    packed, keys = getattr(df, "_series", (None, None))
    if keys == (*by,) and not cast:
        rows = packed  # the arrays that a step like this one has just spread
    else:
        rows = df.groupBy(*by).agg(F.collect_list(F.struct(*row)).alias("_rows")).sortWithinPartitions(*by)
    fields = [T.StructField(f.name, f.dataType) for f in kept]
    fields += [T.StructField(f"_as_double_{n}", T.DoubleType()) for n in cast]
    fields += [T.StructField(n, T.DoubleType()) for n in added]
    names = [f"_as_double_{n}" if n in cast else n for n in dict.fromkeys(reads)]

    def renamed(series: Series, columns: dict[str, np.ndarray]) -> Mapping[str, np.ndarray]:
        return compute(series, {n.removeprefix("_as_double_"): c for n, c in columns.items()})

    run = F.arrow_udf(_run(names, [f.name for f in fields if f.name not in added], list(added), renamed, order), T.ArrayType(T.StructType(fields)))
    made = rows.select(*by, run("_rows").alias("_rows"))
    # Outer, as an inner one would ask first whether there are rows, and compute them twice; there always are.
    out = made.select(*by, F.inline_outer("_rows")).select(*dict.fromkeys([*df.columns, *added]))
    out._series = (made, (*by,))
    return out


def _known(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows without a NULL or NaN."""
    keep = np.ones(batch.num_rows, bool)
    for c in batch.columns:
        if c.null_count:
            keep &= pc.is_valid(c).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(c.type):
            keep &= ~pc.is_nan(c).fill_null(False).to_numpy(zero_copy_only=False)
    return batch if keep.all() else batch.filter(pa.array(keep))


def _begins(batch: pa.RecordBatch, by: Sequence[str]) -> np.ndarray:
    """Rows whose key differs from that of the row before; keys are known."""
    new = np.zeros(batch.num_rows - 1, bool)
    for k in by:
        c = batch.column(batch.schema.get_field_index(k))
        new |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def _joined(parts: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def known_in_order(
    df: DataFrame, by: Sequence[str], name: str, label: Callable[[np.ndarray, np.ndarray], np.ndarray], only: str | None = None
) -> DataFrame:
    """Rows without a NULL or NaN and the text ``name``, which ``label`` makes from the place in the series and its size.

    Place (from one) and size count the known rows.  The rows of a series have to lie one behind the other and in
    order, as :func:`with_series` leaves them; they are passed on as they come, without an exchange or a sort, and no more
    than a series and a batch is held.  ``only`` keeps the rows with that text.
    """
    importable(df.sparkSession)
    by = list(by)

    def labelled(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(starts, rows.num_rows))
        found = label(np.arange(rows.num_rows) - np.repeat(starts, sizes) + 1, np.repeat(sizes, sizes))
        out = pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.string())], [*rows.schema.names, name])
        return out if only is None else out.filter(pa.array(found == only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last series so far
        for batch in batches:
            batch = _known(batch)
            if not batch.num_rows:
                continue
            begins = _begins(batch, by)
            if held:
                ends = _begins(_joined([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), by)
                if not len(begins) and not len(ends):
                    held.append(batch)  # still the same series
                    continue
            last = int(begins[-1]) if len(begins) else 0
            over = _joined([*held, batch.slice(0, last)]) if held else batch.slice(0, last)
            if over.num_rows:
                yield labelled(over, np.concatenate([[0], _begins(over, by)]).astype(np.int64))
            held = [batch.slice(last)]
        if held:
            over = _joined(held)
            yield labelled(over, np.zeros(1, np.int64))

    kept = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])
    return df.mapInArrow(run, kept)
