"""Mixing sources to target weights by Sainte-Laguë apportionment.

The documents of a source are dealt to shards by a seeded hash, and the words of a shard, its documents
in seeded order, are cut into blocks of equal size. Sainte-Laguë apportionment gives each source its
number of blocks by the highest quotients ``v, v / 3, v / 5, ...`` of the blocks ``v`` its target is
worth, and in the same way each shard of a source its quota. A shard takes all its blocks as often as the
quota allows and the rest by a seeded choice. Quotas follow from counts and the choice from a hash, so a
task that runs again takes the same blocks, and tasks need not agree on anything.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import importable, stage

BLOCK = 16  # words of a block: a source misses its target by about one block
SHARD = 1 << 18  # words and rows of a shard, on average
SOURCES = 1 << 17  # most sources a mix may have: their totals and weights are lists on the driver
STEPS = 32  # divisors tried in one pass over the shards
RANGE = 4096  # shards that are numbered together
CLOSE = 1e-12  # quotients this near are equal
WORDS = r"[^ \t-\r]++"


# ---- targets and seats ------------------------------------------------------------------------------


def targets(sizes: Sequence[int], weights: Sequence[float], repeats: int) -> np.ndarray:
    """Shares of the total size by weight; a share stops at ``repeats`` times its size and the excess is shared anew."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    most = repeats * sizes
    full = np.zeros(len(sizes), bool)
    share = most
    while not full.all():
        share = np.where(full, most, (sizes.sum() - most[full].sum()) * weights / weights[~full].sum())
        if not (share > most).any():
            break
        full |= share > most
    return np.minimum(share, most)


def seats(votes: Sequence[float], most: Sequence[int], total: int) -> np.ndarray:
    """Sainte-Laguë: ``total`` seats to the highest quotients ``votes / (2 k + 1)``, at most ``most`` to an entry.

    Votes times a common rate, rounded, are the seats of the highest quotients; the rate is found by halving.
    Of quotients that are equal at the last seats the first entries' go first.
    """
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    total = min(int(total), int(most[votes > 0].sum()))

    def given(rate: float) -> np.ndarray:
        return np.minimum(most, np.floor(votes * rate + 0.5)).astype(np.int64)

    low, high = 0.0, 1.0
    while given(high).sum() < total:
        high *= 2
    while low < (middle := (low + high) / 2) < high:
        low, high = (middle, high) if given(middle).sum() <= total else (low, middle)
    out = given(low * (1 - CLOSE))
    out[np.flatnonzero(given(high * (1 + CLOSE)) > out)[: total - out.sum()]] += 1
    return out


def shard_quotas(shards: DataFrame, wanted: dict[int, int], repeats: int) -> DataFrame:
    """``number, shard, quota``: the seats ``wanted`` of each source (``number``) dealt to its shards by Sainte-Laguë.

    ``shards`` has ``number, shard, blocks``. A source may have any number of shards: one rate a source is
    narrowed down on the driver by sums over all shards, ``STEPS`` rates a pass, until it gives the
    seats or only equal quotients are left, which go to the first shards.
    """
    spark = shards.sparkSession
    held = shards.withColumn("most", F.col("blocks") * repeats)

    def given(rate: Column) -> Column:
        return F.least("most", F.floor(F.col("blocks") * rate + F.lit(0.5)))

    def known(rates: dict[int, tuple[float, float]]) -> DataFrame:
        rows = [(n, lo, hi, wanted[n]) for n, (lo, hi) in rates.items()]
        return F.broadcast(spark.createDataFrame(rows, "number bigint, lo double, hi double, seats bigint"))

    rates = {n: (0.0, 2.0 * repeats) for n in wanted}
    left = dict(rates)
    while left:
        at = [F.col("lo") + (F.col("hi") - F.col("lo")) * F.lit(i / STEPS) for i in range(STEPS + 1)]
        sums = held.join(known(left), "number").groupBy("number").agg(*[F.sum(given(r)).alias(f"s{i}") for i, r in enumerate(at)])
        for row in sums.collect():
            n, (lo, hi) = row["number"], left[row["number"]]
            below = max((i for i in range(STEPS + 1) if row[f"s{i}"] <= wanted[n]), default=0)
            step = lambda i: lo + (hi - lo) * (i / STEPS)  # noqa: E731, B023
            exact = row[f"s{below}"] == wanted[n]
            rates[n] = (step(below), step(below if exact else min(below + 1, STEPS)))
            if exact or rates[n][1] - rates[n][0] <= CLOSE * rates[n][1]:
                del left[n]
            else:
                left[n] = rates[n]
    dealt = held.join(known(rates), "number").withColumn("quota", given(F.col("lo") * (1 - CLOSE)))
    dealt = stage(dealt.withColumn("next", (given(F.col("hi") * (1 + CLOSE)) > F.col("quota")).cast("bigint")).withColumn("range", F.floor(F.col("shard") / RANGE)), "dealt")
    short = dealt.groupBy("number").agg((F.max("seats") - F.sum("quota")).alias("short"))
    before = Window.partitionBy("number").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("number", "range").agg(F.sum("next").alias("n")).select("number", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("number", "range").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.col("before") + F.sum("next").over(inside)
    more = (F.col("next") == 1) & (nth <= F.col("short"))
    return dealt.join(ranges, ["number", "range"]).join(F.broadcast(short), "number").withColumn("_more", more.cast("bigint")).select(
        "number", "shard", (F.col("quota") + F.col("_more")).alias("quota")
    )


# ---- blocks -------------------------------------------------------------------------------------------


def _mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def taken_words(sizes: np.ndarray, blocks: int, quota: int, seed: int) -> np.ndarray:
    """Words taken of each document of a shard, whose words lie one after the other in ``blocks`` blocks.

    Every block is taken ``quota // blocks`` times; the ones taken once more are those whose numbers have
    the smallest hashes.
    """
    ends = np.cumsum(sizes)
    if not blocks:
        return np.zeros(len(sizes), np.int64)
    edges = np.arange(blocks + 1) * int(ends[-1]) // blocks
    times = np.full(blocks, quota // blocks)
    with np.errstate(over="ignore"):
        order = np.argsort(_mixed(np.arange(blocks, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64)), kind="stable")
    times[order[: quota % blocks]] += 1
    until = np.concatenate([[0], np.cumsum(times * np.diff(edges))])  # words taken before each edge
    block = np.minimum(np.searchsorted(edges, ends, side="right") - 1, blocks - 1)
    before = until[block] + times[block] * (ends - edges[block])
    return np.diff(before, prepend=0)


def _take(table: pa.Table) -> pa.Table:
    """The rows of one shard, each once for every copy, with the words taken."""
    order = np.lexsort([table.column(c).to_numpy() for c in ("copies", "size", "turn")])
    each = np.repeat(order, table.column("copies").to_numpy()[order])
    blocks, quota, seed = (table.column(c)[0].as_py() for c in ("blocks", "quota", "seed"))
    sizes = table.column("size").to_numpy()[each]
    out = table.select(["number", "doc_id", "size"]).take(pa.array(each))
    return out.append_column("taken", pa.array(taken_words(sizes, blocks, quota, seed), pa.int64()))


def mix(
    docs: DataFrame,
    weights: Sequence[float] | Callable[[str | None, int], float] = (1, 2, 3),
    repeats: int = 3,
    seed: int = 42,
    block: int = BLOCK,
    shard: int = SHARD,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row: the words that a mix of the sources takes of it.

    ``weights`` go to the sources in code point order, null last and again from the first when they run out,
    or are a function of a source and its place. The targets share the words of all documents by weight,
    none over ``repeats`` times its source. ``taken`` counts repeats and is at most ``repeats * size``.

    A null or empty text has no words and nothing is taken of it. Null ids and sources are values as any
    other, the empty source is not the null one. Rows that repeat an id, source and size are counted first
    and share what is taken of them in any order, so that reruns give the same rows. A very long text
    lies in blocks as any other. An empty table gives no rows; other columns are not read. More than
    ``SOURCES`` sources are an error.
    """
    importable(docs.sparkSession)
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col(text_column), F.lit("")), F.lit(WORDS)).cast("bigint")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), size.alias("size"))
    rows = stage(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sized")
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("rows")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"a mix has at most {SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    words = [r["words"] for r in found]
    weigh = weights if callable(weights) else lambda _, place: weights[place % len(weights)]
    goal = targets(words, [weigh(r["source"], n) for n, r in enumerate(found)], repeats)

    parts = [(n, r["source"], -(-(r["words"] + r["rows"]) // shard)) for n, r in enumerate(found)]
    numbered = F.broadcast(spark.createDataFrame(parts, "number bigint, _source string, shards bigint"))
    most = F.greatest(F.lit(1), F.floor(F.lit(shard) / (F.col("size") + 1)))  # copies that stay together
    placed = rows.join(numbered, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_most", most)
    placed = placed.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.col("_most")))))
    hashed = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "doc_id", "size", "_part")
    placed = stage(
        placed.select(
            "number", F.pmod(hashed("shard"), "shards").alias("shard"), "doc_id", "size", hashed("turn").alias("turn"),
            F.least("_most", F.col("n") - F.col("_part") * F.col("_most")).alias("copies"), F.xxhash64(F.lit(seed), "source").alias("seed"),
        ),
        "placed",
    )
    held = placed.groupBy("number", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    blocks = F.when(F.col("words") == 0, 0).otherwise(F.greatest(F.lit(1), F.round(F.col("words") / block))).cast("bigint")
    held = stage(held.select("number", "shard", blocks.alias("blocks")), "shards")
    count = {r["number"]: r["blocks"] for r in held.groupBy("number").agg(F.sum("blocks").alias("blocks")).collect()}
    of = np.array([count[n] for n in range(len(found))], np.int64)
    votes = np.divide(goal * of, words, out=np.zeros(len(found)), where=of > 0)
    given = seats(votes, repeats * of, round(float(votes.sum())))
    quotas = shard_quotas(held, {n: int(s) for n, s in enumerate(given)}, repeats).join(held, ["number", "shard"])
    kind = dict(docs.dtypes)[id_column]
    picked = placed.join(quotas, ["number", "shard"]).withColumn("seed", F.xxhash64("seed", "shard"))
    taken = picked.groupBy("number", "shard").applyInArrow(_take, f"number bigint, doc_id {kind}, size bigint, taken bigint")
    totals = spark.createDataFrame([(n, w, float(t)) for n, (w, t) in enumerate(zip(words, goal))], "number bigint, source_size bigint, target double")
    return taken.join(F.broadcast(totals), "number").select("doc_id", "size", "source_size", "target", "taken")
