"""Profiles of feature columns: one pass over the rows, one result row per feature."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.windows import few_groups
from barline.operators.columns import column_quantiles, digit_counter, doubles, first_digits, rank_moments
from barline.operators.features import LABEL
from barline.operators.partials import BESIDE, SCHEMA, TREE, Partial, as_batch, beside, beside_collected, beside_joined, collected, joined, of_rows, shape, shape_collected, shape_joined
from barline.session import importable, materialise


def null_total(df: DataFrame) -> DataFrame:
    """Number of NULLs in the whole frame."""
    per_row = sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("n_null"))


def per_feature(df: DataFrame, columns: Sequence[str], stats: Mapping[str, Callable[[str], Column]]) -> DataFrame:
    """``feature`` and one column per statistic, from a single aggregation of the rows as they are.

    Rows are not repeated per feature; only the one row of results is turned into k.
    """
    columns = list(columns)
    found = df.select(*df.columns).agg(*[stat(c).alias(f"_{i}_{name}") for i, c in enumerate(columns) for name, stat in stats.items()])
    each = [F.struct(F.lit(c).alias("feature"), *[F.col(f"_{i}_{n}").alias(n) for n in stats]) for i, c in enumerate(columns)]
    return found.select(F.explode(F.array(*each)).alias("f")).select("f.*")


def missing_share(c: str) -> Column:
    """From counts, of which that of the rows is kept once for all columns; NULL without rows."""
    rows = F.count(F.lit(1))
    return F.try_divide(rows - F.count(c), rows)


def sample_variance(c: str) -> Column:
    return F.var_samp(F.col(c).cast("double"))


def missing_filter(df: DataFrame, columns: Sequence[str], limit: float = 0.9) -> DataFrame:
    """Share of NULLs per feature; ``kept`` if below ``limit``."""
    return per_feature(df, columns, {"missing_ratio": missing_share}).withColumn("kept", F.col("missing_ratio") < limit)


def variance_filter(df: DataFrame, columns: Sequence[str], limit: float = 0.001) -> DataFrame:
    """Sample variance per feature; ``kept`` if above ``limit``."""
    stats = per_feature(df, columns, {"variance": sample_variance})
    return stats.withColumn("kept", F.coalesce(F.col("variance") > limit, F.lit(False)))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of two columns without missing values; NULL if one is constant."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def label_correlations(df: DataFrame, columns: Sequence[str], label: str = LABEL) -> DataFrame:
    """``feature, r``: correlation of each feature with the label over the rows where both are known, from one pass.

    NULL where it is undefined.  Tasks send six numbers for each feature.
    """
    columns = list(columns)
    importable(df.sparkSession)
    rows = doubles(df, [*columns, label])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            total = beside_joined(total, beside(x[:, :-1], x[:, -1]))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % TREE], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["tree", "found"])

    found = beside_collected(rows.mapInArrow(run, BESIDE))
    schema = "feature string, r double"
    if found is None:
        return df.sparkSession.createDataFrame([(c, None) for c in columns], schema)
    n, mx, my, xx, yy, xy = found
    flat = (n < 2) | (xx <= 1e-26 * np.maximum(mx * mx, 1e-300) * n) | (yy <= 1e-26 * np.maximum(my * my, 1e-300) * n)
    r = xy / np.sqrt(np.where(flat, 1.0, xx * yy))
    return df.sparkSession.createDataFrame([(c, None if f else float(v)) for c, f, v in zip(columns, flat, r)], schema)


def _shape_summer():
    """Two functions: one takes a batch of rows, the other gives the :func:`shape` of all batches."""
    total = None

    def add(batch: pa.RecordBatch) -> None:
        nonlocal total
        if batch.num_rows:
            known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            with np.errstate(all="ignore"):
                total = shape_joined(total, shape(x, known))

    def found() -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % TREE], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["tree", "found"])

    return add, found


def _shape_table(spark, columns: list[str], partials: DataFrame) -> DataFrame:
    found = shape_collected(partials)
    rows = []
    for i, c in enumerate(columns):
        n, mean, m2, m3 = map(float, found[:, i]) if found is not None else (0.0, 0.0, 0.0, 0.0)
        std = (m2 / (n - 1)) ** 0.5 if n > 1 else None
        cubed = m2 * abs(m2) ** 0.5
        skew = n**0.5 * m3 / cubed * (n * (n - 1)) ** 0.5 / (n - 2) if n > 2 and cubed != 0 else None
        rows.append((c, int(n), mean if n else None, std, skew))
    return spark.createDataFrame(rows, "feature string, n_values bigint, mean double, std double, skew double")


def shapes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, n_values, mean, std, skew``: sample deviation and bias-corrected skewness of the known values, from one pass.

    NULL where a number is undefined: without values, a deviation of one, a skewness of two or of equal ones.  Tasks
    send four numbers for each feature; an aggregation of many columns in one expression is too long for the JVM to compile.
    """
    columns = list(columns)
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, found = _shape_summer()
        for batch in batches:
            add(batch)
        yield from found()

    return _shape_table(df.sparkSession, columns, doubles(df, columns).mapInArrow(run, BESIDE))


def shapes_and_first_digits(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """:func:`shapes` and the counts that exact quantiles begin with, from one pass over the rows."""
    columns = list(columns)
    importable(df.sparkSession)
    begin = first_digits(len(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (add, found), (count, counts) = _shape_summer(), digit_counter(*begin)
        for batch in batches:
            add(batch)
            count(batch)
        for part in (*found(), *counts()):
            there = dict(zip(part.schema.names, part.columns))
            yield pa.RecordBatch.from_arrays([there.get(f.name, pa.nulls(part.num_rows, f.type)) for f in FOUND], schema=FOUND)

    both = doubles(df, columns).mapInArrow(run, f"{BESIDE}, at int, prefix bigint, digit bigint, n bigint")
    both = materialise(both.groupBy("tree", "at", "prefix", "digit").agg(F.collect_list("found").alias("found"), F.sum("n").alias("n")))
    parts = both.where(F.col("at").isNull()).select("tree", F.explode("found").alias("found"))
    return _shape_table(df.sparkSession, columns, parts), both.where(F.col("at").isNotNull()).select("at", "prefix", "digit", "n")


FOUND = pa.schema([("tree", pa.int32()), ("found", pa.binary()), ("at", pa.int32()), ("prefix", pa.int64()), ("digit", pa.int64()), ("n", pa.int64())])


def target_corr(df: DataFrame, columns: Sequence[str], label: str = LABEL) -> DataFrame:
    """Absolute correlation of each feature with the label, 0 where it is undefined."""
    return label_correlations(df, columns, label).select("feature", F.coalesce(F.abs("r"), F.lit(0.0)).alias("score"))


@dataclass(frozen=True)
class Moments:
    """Counts, means, population deviations and correlations of k columns: k and k*k numbers."""

    columns: list[str]
    n: int
    mean: np.ndarray
    std: np.ndarray
    corr: np.ndarray

    def only(self, columns: Sequence[str]) -> "Moments":
        at = [self.columns.index(c) for c in columns]
        return Moments(list(columns), self.n, self.mean[at], self.std[at], self.corr[np.ix_(at, at)])


def _partials(k: int):
    """Moments of the rows of a partition, per group; batches are centred before they are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Partial] = {}
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            groups = batch.column(0).to_numpy()
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(k)]).astype(float)
            whole = ~np.isnan(x).any(axis=1)
            for g in np.unique(groups[whole]).tolist():
                found[g] = joined(found.get(g), of_rows(x[whole & (groups == g)]))
        for g, partial in found.items():
            yield as_batch(g, TaskContext.get().partitionId(), partial)

    return run


def moments_by(df: DataFrame, columns: Sequence[str], part: Column | None = None) -> dict[int, Moments]:
    """Moments per value of an integer ``part`` (one group without it), in one pass over the rows.

    A row with a NULL or NaN in any of the columns is left out.  Partitions send k and k * k numbers per
    group, which are merged in ``TREE`` tasks before the driver sees them.
    """
    columns = list(columns)
    importable(df.sparkSession)
    group = (F.lit(0) if part is None else part).cast("int").alias("part")
    kinds = dict(df.dtypes)
    rows = df.select(group, *[F.col(c) if kinds[c] == "double" else F.col(c).cast("double") for c in columns])
    return {g: moments_from(columns, p) for g, p in collected(rows.mapInArrow(_partials(len(columns)), SCHEMA)).items()}


def moments_from(columns: list[str], found: Partial) -> Moments:
    """Moments from counts, means and products of deviations."""
    n, mean, products = found
    std = np.sqrt(np.diag(products) / n)
    # A constant column has no correlation, not even with itself.
    std = np.where(std > 1e-13 * np.maximum(np.abs(mean), 1e-300), std, 0.0)
    safe = np.where(std > 0, std, 1.0)
    corr = np.where((std[:, None] > 0) & (std[None, :] > 0), products / n / np.outer(safe, safe), np.nan)
    return Moments(columns, n, mean, std, corr)


def _one(columns: Sequence[str], found: Moments | None) -> Moments:
    nothing = np.full(len(columns), np.nan)
    return found or Moments(list(columns), 0, nothing, nothing, np.outer(nothing, nothing))


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """First and second moments of all columns; rows with a NULL or NaN in any of them are left out."""
    return _one(columns, moments_by(df, columns).get(0))


def moments_of_ranks(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Moments of the average ranks of all columns, over the rows without a missing value."""
    found = rank_moments(df, columns)
    return _one(columns, found and moments_from(list(columns), found))


def corr_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Correlation of each pair of columns, ``feature_i`` before ``feature_j`` in column order."""
    columns = list(columns)
    found = moments(df, columns) if method == "pearson" else moments_of_ranks(df, columns)
    rows = [
        (a, b, i, j, None if np.isnan(found.corr[i, j]) else float(found.corr[i, j]))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i < j
    ]
    schema = "feature_i string, feature_j string, pos_i int, pos_j int, r double"
    return df.sparkSession.createDataFrame(rows, schema)


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1; the largest value falls into the last bin, a constant into the first."""
    share = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
    return F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int")


def _cells(columns: list[str], label: str | None, spans: dict[str, tuple[float | None, float | None]], bins: int):
    """Counts of the cells (bin of the feature, bin of the label) of each partition, for all features."""

    def codes(values: np.ndarray, name: str) -> np.ndarray:
        low, high = spans[name]
        share = np.zeros(len(values)) if low is None or high == low else (values - low) / (high - low)
        return np.minimum(bins - 1, np.floor(np.nan_to_num(share) * bins)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(columns), bins * (bins + 1)), np.int64)
        for batch in batches:
            by = np.zeros(batch.num_rows, np.int64)
            if label is not None:
                y = batch.column(len(columns)).to_numpy(zero_copy_only=False).astype(float)
                by = np.where(np.isnan(y), bins, codes(y, label))  # rows without a label have a cell of their own
            for i, name in enumerate(columns):
                x = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                there = ~np.isnan(x)
                counts[i] += np.bincount(codes(x[there], name) * (bins + 1) + by[there], minlength=bins * (bins + 1))
        at, cell = np.nonzero(counts)
        if len(at):
            by = cell % (bins + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([columns[i] for i in at]), pa.array(cell // (bins + 1), pa.int32()), pa.array(by, pa.int32(), mask=by == bins), pa.array(counts[at, cell])],
                ["feature", "bx", "by", "n"],
            )

    return run


def bin_counts(df: DataFrame, columns: Sequence[str], bins: int, label: str | None = None) -> DataFrame:
    """``feature, bx, by, n``: known values per equal-width bin of the feature and, if there is one, of the label.

    Cells are counted in the tasks; a task sends one row for each cell it has met.
    """
    columns = list(columns)
    importable(df.sparkSession)
    all_ = columns if label is None else [*columns, label]
    span = {"low": lambda c: F.min(F.col(c).cast("double")), "high": lambda c: F.max(F.col(c).cast("double"))}
    spans = {r["feature"]: (r["low"], r["high"]) for r in per_feature(df, list(dict.fromkeys(all_)), span).collect()}  # one row per feature
    values = doubles(df, all_)
    cells = values.mapInArrow(_cells(columns, label, spans, bins), "feature string, bx int, by int, n bigint")
    return cells.groupBy("feature", "bx", "by").agg(F.sum("n").alias("n"))


def mi_scores(df: DataFrame, columns: Sequence[str], label: str = LABEL, bins: int = 16) -> DataFrame:
    """Mutual information of each feature with the label over equal-width bins, in nats."""
    cells = bin_counts(df, columns, bins, label)
    shares = cells.select(
        "feature",
        "n",
        F.sum("n").over(Window.partitionBy("feature")).alias("all"),
        F.sum("n").over(Window.partitionBy("feature", "bx")).alias("nx"),
        F.sum("n").over(Window.partitionBy("feature", "by")).alias("ny"),
    )
    part = F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))
    return shares.groupBy("feature").agg(F.sum(part).alias("mi"))


class Standardizer:
    """Mean and population deviation of the training rows, applied to any rows."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)
        self.mean: dict[str, float] = {}
        self.std: dict[str, float] = {}

    def fit(self, train: DataFrame) -> "Standardizer":
        stats = per_feature(
            train, self.columns, {"mean": lambda c: F.avg(F.col(c).cast("double")), "std": lambda c: F.stddev_pop(F.col(c).cast("double"))}
        )
        for row in stats.collect():  # one row per feature
            self.mean[row["feature"]] = row["mean"]
            self.std[row["feature"]] = row["std"] or 1.0  # a constant column is only centred
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.mean[c])) / F.lit(self.std[c]) for c in self.columns})

    def features(self, df: DataFrame, name: str = "features") -> DataFrame:
        """Scaled columns as one vector column, the input of the model fits."""
        scaled = [(F.col(c) - F.lit(self.mean[c])) / F.lit(self.std[c]) for c in self.columns]
        return df.withColumn(name, array_to_vector(F.array(*scaled)))


def minmax(df: DataFrame, columns: Sequence[str], by: Sequence[str], epsilon: float = 0.0, few: bool = False) -> DataFrame:
    """Columns scaled to [0, 1] inside each group, as ``<column>_scaled``; NULL for a constant.

    ``few`` states that the number of groups is set by a model, split or column list.
    """
    spans = df.groupBy(*by).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns]
    )
    scaled = df.join(few_groups(spans, few), list(by)).withColumns(
        {
            f"{c}_scaled": F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + epsilon)
            for c in columns
        }
    )
    return scaled.drop(*[f"_lo_{c}" for c in columns], *[f"_hi_{c}" for c in columns])


def quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact quartiles per feature."""
    return column_quantiles(df, columns, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
