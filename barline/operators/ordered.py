"""Order statistics of groups that may hold a large part of all rows.

Ranks, cumulative counts and exact quantiles need a total order inside a group.  A plain window
would bring a group into one task, so equal values are combined first (map-side), the distinct
values are spread over buckets of about equal size, and the totals of the buckets before are
added to a running total inside each bucket.

Groups are few here (models, features): for groups as many as series use ``bounded``.  The
bucket borders are values chosen by their hash, at most ``MOST_BORDERS`` per group however many
values it has, so the broadcast tables of borders and buckets do not grow with the data; borders only
place values and never change a result.  They depend on the data alone, so a task that is run again
after an executor was lost places every value where it was before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 1 << 17  # distinct values per bucket, on average, until a group has its most borders
MOST_BORDERS = 4096


def _borders_below(value: str) -> Column:
    """How many of the sorted ``_borders`` are smaller than ``value``, by halving."""
    return F.aggregate(
        "_steps",
        F.lit(0),
        lambda at, step: F.when(F.get("_borders", at + step - 1) < F.col(value), at + step).otherwise(at),
    )


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    counts: Mapping[str, Column],
    bucket_rows: int = BUCKET_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """One row per distinct ``value`` of a group, with counts of its own rows and of all rows below.

    ``counts`` maps names to counts which together cover every input row.  The result has ``by``,
    ``value``, each name, ``<name>_before`` (rows with a smaller value) and ``<name>_all`` (the
    group).  ``bounded`` states that no group outgrows a task, as with one series and its
    calendar; a plain window then does.
    """
    names = list(counts)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[c.alias(n) for n, c in counts.items()])
    if bounded:
        smaller = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        group = Window.partitionBy(*by)
        return distinct.withColumns(
            {f"{n}_before": F.coalesce(F.sum(n).over(smaller), F.lit(0)) for n in names}
            | {f"{n}_all": F.sum(n).over(group) for n in names}
        )
    placed, before = _in_buckets(distinct, by, value, names, bucket_rows)
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.join(F.broadcast(before), [*by, "_bucket"]).withColumns(
        {f"{n}_before": F.col(f"_{n}_below") + F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names}
    )
    return summed.select(*by, value, *names, *[f"{n}_before" for n in names], *[f"{n}_all" for n in names])


def _in_buckets(
    distinct: DataFrame, by: Sequence[str], value: str, names: Sequence[str], bucket_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Distinct values with their bucket, and per bucket the counts below it, inside it and in all.

    One value in ``bucket_rows`` is a border, and of these the ``MOST_BORDERS`` with the smallest hash in
    each group.  Tasks keep no more than that many themselves.  A group below that size is one bucket.
    """
    # Every distinct value has a row, so the second condition holds throughout.  It keeps all
    # counts in this branch, which then reads the same exchange as the other one.
    some = sum((F.col(n) for n in names[1:]), F.col(names[0])) > 0
    first = Window.partitionBy(*by).orderBy(F.xxhash64(value), value)
    borders = (
        distinct.where((F.pmod(F.xxhash64(value), F.lit(bucket_rows)) == 0) & some)
        .withColumn("_nth", F.row_number().over(first))
        .where(F.col("_nth") <= MOST_BORDERS)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(value)).alias("_borders"))
        .withColumn(
            "_steps",
            F.transform(
                F.sequence(F.ceil(F.log2(F.size("_borders") + 1)).cast("int"), F.lit(0)),
                lambda i: F.pow(F.lit(2.0), i).cast("int"),
            ),
        )
    )
    placed = (
        distinct.join(F.broadcast(borders), list(by), "left")
        .withColumn("_bucket", F.coalesce(_borders_below(value), F.lit(0)))
        .drop("_borders", "_steps")
    )
    below = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    before = (
        placed.groupBy(*by, "_bucket")
        .agg(*[F.sum(n).alias(f"_{n}_in") for n in names])
        .withColumns(
            {f"_{n}_below": F.coalesce(F.sum(f"_{n}_in").over(below), F.lit(0)) for n in names}
            | {f"{n}_all": F.sum(f"_{n}_in").over(group) for n in names}
        )
    )
    return placed, before


def average_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rank of each distinct value in its group; tied rows share the mean of their ranks."""
    totals = running_totals(df, by, value, {"n": F.count(F.lit(1))})
    return totals.select(*by, value, (F.col("n_before") + (F.col("n") + 1) / 2).alias("avg_rank"))


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    bucket_rows: int = BUCKET_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """Exact quantiles per group, interpolated between the two neighbouring order statistics.

    Only the buckets that hold a wanted order statistic are sorted.  ``bounded`` states that no group
    outgrows a task; groups may then be as many as series.
    """
    known = df.where(F.col(value).isNotNull())
    if bounded:
        exact = [F.percentile(F.col(value).cast("double"), F.lit(float(p))).alias(q) for q, p in probabilities.items()]
        return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *exact)
    distinct = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    placed, before = _in_buckets(distinct, by, value, ["n"], bucket_rows)
    at = {name: (F.col("n_all") - 1) * F.lit(float(p)) for name, p in probabilities.items()}

    def holds(index: Column, start: Column, size: Column) -> Column:
        return (start <= index) & (index < start + size)

    wanted = F.lit(False)
    for index in at.values():
        for side in (F.floor(index), F.ceil(index)):
            wanted = wanted | holds(side, F.col("_n_below"), F.col("_n_in"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_n_below") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    rows = placed.join(F.broadcast(before), [*by, "_bucket"]).where(wanted).withColumn("_start", start)
    picks = []
    for name, index in at.items():
        low = F.when(holds(F.floor(index), F.col("_start"), F.col("n")), F.col(value))
        high = F.when(holds(F.ceil(index), F.col("_start"), F.col("n")), F.col(value))
        picks += [F.max(low).alias(f"_{name}_low"), F.max(high).alias(f"_{name}_high")]
        picks.append(F.max(index - F.floor(index)).alias(f"_{name}_part"))
    found = rows.groupBy(*by).agg(F.max("n_all").alias("n"), *picks)
    between = {
        q: F.col(f"_{q}_low") + (F.col(f"_{q}_high") - F.col(f"_{q}_low")) * F.col(f"_{q}_part") for q in probabilities
    }
    return found.select(*by, "n", *[c.alias(q) for q, c in between.items()])
