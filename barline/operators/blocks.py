"""Time blocks, for series too long for one task (intraday bars).

A series is cut into blocks of ``block_rows`` rows.  What an operator needs from outside a block comes in
one of two ways.  A bounded window sees copies of the rows near a border, which are dropped afterwards.
A value that is carried on without bound (a fill, an exponential mean) is handed over by a segmented
scan: each block is summed up in one row, a window over these few rows combines the blocks before or
behind, and the result is joined back to the rows of the block.  Either way the results equal
those of the plain window, and no task holds more of a series than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.windows import SERIES
from barline.operators.features import KEYS, LABEL
from barline.operators.indicators import decay_of, decayed_sums
from barline.session import materialise


def number_rows(df: DataFrame, by: Sequence[str] = SERIES, order: str = "date", grain: str = "month") -> DataFrame:
    """Adds ``_pos``, the 0-based row number in each series, without bringing a series together.

    Rows are numbered inside calendar cells; the cell's offset is the running count of the cells
    before it, a table with one row per series and cell.
    """
    cell = F.trunc(order, grain) if grain in ("year", "quarter", "month", "week") else F.date_trunc(grain, order)
    rows = df.withColumn("_cell", cell)
    counts = rows.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_cell").orderBy(order)
    return (
        rows.withColumn("_in", F.row_number().over(inside))
        .join(offsets, [*by, "_cell"])
        .withColumn("_pos", F.col("_offset") + F.col("_in") - 1)
        .drop("_cell", "_in", "_offset")
    )


class Blocks:
    """Rows of a panel cut into blocks; each operator gives new blocks, ``rows()`` the rows."""

    def __init__(
        self, df: DataFrame, block_rows: int = 4096, by: Sequence[str] = SERIES, order: str = "date", grain: str = "month", numbered: bool = False
    ):
        """``grain`` is a calendar cell whose rows of one series fit a task; ``numbered`` rows have ``_pos`` and ``_home``."""
        self.block_rows, self.by, self.order, self.grain = block_rows, tuple(by), order, grain
        self.df = df if numbered else number_rows(df, by, order, grain).withColumn("_home", F.floor(F.col("_pos") / block_rows))

    def rows(self) -> DataFrame:
        return self.df.drop("_pos", "_home")

    def stored(self) -> "Blocks":
        """The blocks written once; carried operators read their rows twice."""
        return self.then(materialise)

    def then(self, change: Callable[[DataFrame], DataFrame]) -> "Blocks":
        """The blocks after a change that leaves rows in their blocks, such as projections and filters."""
        return Blocks(change(self.df), self.block_rows, self.by, self.order, self.grain, numbered=True)

    def copied(self, lookback: int, lookahead: int) -> DataFrame:
        """The rows with their ``_block``, and copies of the rows that a block's windows see beyond its borders.

        All rows have to be there still: a row's place says which blocks need a copy of it.
        """
        if self.block_rows < max(lookback, lookahead):
            raise ValueError("a block has to be at least as long as its halo")
        inside = F.col("_pos") % self.block_rows

        def copy(when: Column, shift: int) -> Column:
            return F.when(when, F.array(F.col("_home") + shift)).otherwise(F.array().cast("array<bigint>"))

        targets = F.concat(
            F.array("_home"), copy(inside >= self.block_rows - lookback, 1), copy((inside < lookahead) & (F.col("_home") > 0), -1)
        )
        return self.df.withColumn("_block", F.explode(targets))

    def windowed(self, compute: Callable[[DataFrame, Sequence[str]], DataFrame], lookback: int, lookahead: int) -> "Blocks":
        """``compute(rows, by)`` with windows that look at most ``lookback`` and ``lookahead`` rows away."""
        computed = compute(self.copied(lookback, lookahead), (*self.by, "_block"))
        return self.then(lambda _: computed.where(F.col("_block") == F.col("_home")).drop("_block"))

    def carried(self, summary: Mapping[str, Column], scanned: Mapping[str, Column]) -> DataFrame:
        """Every row with ``scanned`` columns of its block: window expressions over one row of ``summary`` for each block.

        The summaries are the series shortened by ``block_rows``; their windows use ``before``, ``behind`` or ``whole``.
        """
        blocks = self.df.groupBy(*self.by, "_home").agg(*[c.alias(n) for n, c in summary.items()])
        return self.df.join(blocks.select(*self.by, "_home", *[c.alias(n) for n, c in scanned.items()]), [*self.by, "_home"])

    def before(self, most: int | None = None) -> Window:
        """The blocks before a block, or the last ``most`` of them."""
        return Window.partitionBy(*self.by).orderBy("_home").rowsBetween(Window.unboundedPreceding if most is None else -most, -1)

    def behind(self) -> Window:
        return Window.partitionBy(*self.by).orderBy(F.col("_home").desc()).rowsBetween(Window.unboundedPreceding, -1)

    def whole(self) -> Window:
        return Window.partitionBy(*self.by).orderBy("_home").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def _inside(self, reverse: bool = False) -> Window:
        order = F.col(self.order).desc() if reverse else F.col(self.order)
        return Window.partitionBy(*self.by, "_home").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    def _known(self, column: str, pick: Callable[[str, Column], Column]) -> Column:
        """The first (``min_by``) or last (``max_by``) known value of a block."""
        return pick(column, F.when(F.col(column).isNotNull(), F.col("_pos")))

    def ffill(self, columns: Sequence[str]) -> "Blocks":
        """NULLs take the last known value of their series."""
        before, inside = self.before(), self._inside()
        found = self.carried(
            {f"_last_{c}": self._known(c, F.max_by) for c in columns},
            {f"_carry_{c}": F.last(f"_last_{c}", ignorenulls=True).over(before) for c in columns},
        )
        filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carry_{c}")) for c in columns}
        return self.then(lambda _: found.withColumns(filled).drop(*[f"_carry_{c}" for c in columns]))

    def bfill(self, columns: Sequence[str]) -> "Blocks":
        """NULLs take the next known value of their series."""
        behind, inside = self.behind(), self._inside(reverse=True)
        found = self.carried(
            {f"_first_{c}": self._known(c, F.min_by) for c in columns},
            {f"_carry_{c}": F.last(f"_first_{c}", ignorenulls=True).over(behind) for c in columns},
        )
        filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carry_{c}")) for c in columns}
        return self.then(lambda _: found.withColumns(filled).drop(*[f"_carry_{c}" for c in columns]))

    def clean(self, label: str = LABEL) -> "Blocks":
        """Labelled rows with features filled forward, then back, then with zero, as :func:`fill.clean` does."""
        known = self.then(lambda df: df.where(F.col(label).isNotNull()))
        columns = [c for c in known.df.columns if c not in {*KEYS, *self.by, label, self.order, "_pos", "_home"}]
        before, whole, inside = self.before(), self.whole(), self._inside()
        found = known.carried(
            {f"_last_{c}": self._known(c, F.max_by) for c in columns} | {f"_first_{c}": self._known(c, F.min_by) for c in columns},
            {f"_carry_{c}": F.last(f"_last_{c}", ignorenulls=True).over(before) for c in columns}
            | {f"_head_{c}": F.first(f"_first_{c}", ignorenulls=True).over(whole) for c in columns},
        )
        filled = {
            c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carry_{c}"), F.col(f"_head_{c}"), F.lit(0)) for c in columns
        }
        return known.then(lambda _: found.withColumns(filled).drop(*[f"_{k}_{c}" for k in ("carry", "head") for c in columns]))

    def exponential_means(self, column: str, spans: Sequence[int]) -> "Blocks":
        """Adds ``ema_<span>`` as :func:`indicators.exponential_means` does.

        A block hands on the decayed sum of its rows.  It fades by a fixed factor with every block behind it, so
        only the blocks in which it has not faded below the smallest number there is are looked at.  All rows have to
        be there still.
        """
        local = self.then(lambda df: decayed_sums(df, column, spans, (*self.by, "_home"), self.order))
        fade = {n: decay_of(n) ** self.block_rows for n in spans}

        def fading(factor: float) -> Callable[[Column, Column], Column]:
            return lambda total, end: total * F.lit(factor) + end

        reach = {n: max(1, ceil(745 / (-log(decay_of(n)) * self.block_rows))) for n in spans}
        found = local.carried(
            {f"_end_{n}": F.max_by(f"_sum_{n}", "_pos") for n in spans},
            {f"_carry_{n}": F.aggregate(F.collect_list(f"_end_{n}").over(self.before(reach[n])), F.lit(0.0), fading(fade[n])) for n in spans},
        )
        j = F.col("_pos") % self.block_rows
        means = {
            f"ema_{n}": (F.col(f"_sum_{n}") + F.col(f"_carry_{n}") * F.pow(F.lit(q), j + 1)) * F.lit(1 - q) / (F.lit(1.0) - F.pow(F.lit(q), F.col("_pos") + 1))
            for n, q in ((n, decay_of(n)) for n in spans)
        }
        return self.then(lambda _: found.withColumns(means).drop(*[f"_{k}_{n}" for k in ("sum", "carry") for n in spans]))


def in_blocks(
    df: DataFrame,
    compute: Callable[[DataFrame, Sequence[str]], DataFrame],
    lookback: int,
    lookahead: int,
    block_rows: int = 4096,
    by: Sequence[str] = SERIES,
    order: str = "date",
    grain: str = "month",
) -> DataFrame:
    """``compute(rows, by)`` over blocks; it may look at most ``lookback`` and ``lookahead`` rows away."""
    return Blocks(df, block_rows, by, order, grain).windowed(compute, lookback, lookahead).rows()
