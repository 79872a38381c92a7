"""Document fingerprints by SimHash, with permuted block tables for the search.

Terms are pairs of neighbouring words. Every term hash votes on each bit with its weight, its length in
characters, and a bit is set if more than half of the weight voted for it. The votes are counted with
plain sums: two bits share a long, one in each half, so a 64-bit hash takes 32 sums that Spark compiles
and combines before the shuffle. A fingerprint is an array of such words, one per hash seed.

The search splits a fingerprint into blocks. Within radius r of a query at least ``blocks - r`` blocks are
equal, so one table per choice of that many blocks, keyed by them, finds every fingerprint in the radius.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import id_text, stage

SEEDS = (42, 7)
LANES = 32
LOW = (1 << 32) + 1  # the lowest bit of either half
TERM_WEIGHT = 64  # longest length that counts; keeps a half below 2**31 up to 2**25 terms a text
ROWS_PER_BUCKET = 1000
MOST_BUCKETS = 20_000


def _terms(text: Column) -> Column:
    words = F.split(F.lower(text), r"\s+")
    return F.arrays_zip(words.alias("first"), F.slice(words, F.lit(2), F.size(words)).alias("second"))


def fingerprint(rows: DataFrame, keys: Sequence[str], text: str, seeds: Sequence[int] = SEEDS) -> DataFrame:
    """``keys, fp`` with ``fp`` an array of longs; ``keys`` have to tell the rows apart.

    The empty text has one empty term, so all empty texts share a fingerprint.
    """
    exploded = rows.select(*keys, F.explode(_terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    first, second = F.col("term.first"), F.col("term.second")
    weight = F.least(F.octet_length(first) + F.coalesce(F.octet_length(second), F.lit(0)) + 1, F.lit(TERM_WEIGHT)).cast("bigint")
    hashed = exploded.select(*keys, weight.alias("weight"), *[F.xxhash64(F.lit(s), first, second).alias(f"h{s}") for s in seeds])
    sums = [
        F.sum(F.shiftrightunsigned(F.col(f"h{s}"), i).bitwiseAND(F.lit(LOW)) * F.col("weight")).alias(f"v{s}_{i}")
        for s in seeds
        for i in range(LANES)
    ]
    voted = hashed.groupBy(*keys).agg(F.sum("weight").alias("total"), *sums)

    def word(s: int) -> Column:
        bits = []
        for i in range(LANES):
            low = F.col(f"v{s}_{i}").bitwiseAND(F.lit((1 << 32) - 1))
            high = F.shiftrightunsigned(F.col(f"v{s}_{i}"), 32)
            for votes, bit in ((low, i), (high, i + 32)):
                bits.append(F.when(votes * 2 > F.col("total"), F.shiftleft(F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint")))
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return voted.select(*keys, F.array(*[word(s) for s in seeds]).alias("fp"))


def distance(a: Column, b: Column, words: int = len(SEEDS)) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(words)])


def _bits(fp: Column, start: int, end: int) -> Column:
    """Bits start..end of a fingerprint as a long; at most 62 of them, over one or two words."""
    part = None
    at = start
    while at < end:
        word, low = divmod(at, 64)
        size = min(end - at, 64 - low)
        own = F.shiftrightunsigned(fp[word], low).bitwiseAND(F.lit((1 << size) - 1))
        part = own if part is None else part.bitwiseOR(F.shiftleft(own, at - start))
        at += size
    return part


def search(fps: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 5, words: int = len(SEEDS)) -> DataFrame:
    """``query, fp, apart`` for every pair of a query fingerprint and one within ``radius`` bits.

    Both tables have one row per distinct ``fp``. All tables of the index hold all fingerprints.
    """
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    width = 64 * words
    cuts = [(width * i // blocks, width * (i + 1) // blocks) for i in range(blocks)]
    choices = list(combinations(range(blocks), blocks - radius))

    def tables(rows: DataFrame, name: str) -> DataFrame:
        keys = [F.struct(F.lit(n).alias("table"), F.xxhash64(*[_bits(F.col("fp"), *cuts[c]) for c in choice]).alias("key")) for n, choice in enumerate(choices)]
        return rows.select(F.col("fp").alias(name), F.explode(F.array(*keys)).alias("k")).select(name, "k.table", "k.key")

    apart = distance(F.col("query"), F.col("fp"), words)
    met = tables(fps, "fp").join(tables(queries, "query"), ["table", "key"])
    return met.where(apart <= radius).select("query", "fp", apart.alias("apart")).distinct()


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, bucket, place, text, next_text, copy``: each document beside the next by ascending id.

    Ids are cut into buckets of about ``ROWS_PER_BUCKET`` rows; the first document of a bucket also goes
    to the end of the bucket before it (of the last, for the first), as a row with ``copy`` true. So one
    shuffle sets every document beside its successor and no task sees more than a few buckets. Rows that
    repeat an id follow each other by text; null ids come after all others.
    """
    source = id_text(docs, id_column, text_column)
    ids = source.select(F.col("doc_id").cast("bigint").alias("id"))
    rows = ids.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).first()
    buckets = max(1, min(MOST_BUCKETS, rows["n"] // ROWS_PER_BUCKET))
    cuts = [rows["least"]]
    if buckets > 1:
        found = ids.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("c")).first()["c"]
        cuts = sorted({rows["least"], *(found or [])}) if rows["least"] is not None else [None]
    last = len(cuts) - 1
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if last < 200 else F.from_json(F.lit(str(cuts)), "array<bigint>")
    key = F.col("doc_id").cast("bigint")

    def halve(at: Column, jump: Column) -> Column:
        probe = at + jump
        return F.when((probe <= last) & (F.get("cuts", probe) <= F.col("key")), probe).otherwise(at)

    placed = source.withColumn("cuts", bounds).withColumn("key", key)
    found = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(max(1, last.bit_length())))]), F.lit(0), halve)
    placed = placed.withColumn("bucket", F.when(F.col("key").isNull(), F.lit(last)).otherwise(found) if last else F.lit(0))
    first = F.col("key").eqNullSafe(F.get("cuts", F.col("bucket")))
    before = F.when(F.col("bucket") == 0, F.lit(last)).otherwise(F.col("bucket") - 1)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy"))
    again = F.struct(before.alias("bucket"), F.lit(True).alias("copy"))
    dealt = placed.select("doc_id", "text", F.explode(F.when(first, F.array(own, again)).otherwise(F.array(own))).alias("to"))
    order = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_last(), "text")
    return dealt.select("doc_id", "text", "to.bucket", "to.copy").select(
        "doc_id", "bucket", "copy", "text", F.lead("text").over(order).alias("next_text"), F.row_number().over(order).alias("place")
    )


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seeds: Sequence[int] = SEEDS) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp`` for every row.

    The edited text is the document whose last half gives way to the start of the next document. A null
    text is the empty text; a single document is its own next. Repeated rows stay, each with a row.
    """
    rows = with_next(docs, id_column, text_column)
    length = F.char_length("text")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, n_chars - half)"), F.expr("substring(next_text, 1, half)"))
    rows = rows.withColumn("n_chars", length).withColumn("half", half).withColumn("edited", F.when(~F.col("copy"), edited))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    whole = F.struct(F.lit(0).alias("which"), F.col("text").alias("body"), F.lit(None).cast("string").alias("sha"))
    change = F.struct(F.lit(1).alias("which"), F.col("edited").alias("body"), F.col("edited_sha256").alias("sha"))
    bodies = rows.select(
        "doc_id", "bucket", "place", "copy", "n_chars", F.explode(F.when(F.col("copy"), F.array(whole)).otherwise(F.array(whole, change))).alias("b")
    ).select("doc_id", "bucket", "place", "copy", "n_chars", "b.which", "b.body", "b.sha")
    keys = ["doc_id", "bucket", "place", "copy", "n_chars", "which", "sha"]
    found = fingerprint(bodies, keys, "body", seeds)
    pick = lambda c, n: F.max(F.when(F.col("which") == n, F.col(c))).alias(f"{c}_{n}")
    both = found.groupBy("bucket", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("copy").alias("copy"), F.first("n_chars").alias("n_chars"), pick("fp", 0), pick("fp", 1), pick("sha", 1)
    )
    after = F.lead("fp_0").over(Window.partitionBy("bucket").orderBy("place"))
    return both.withColumn("next_fp", after).where(~F.col("copy")).select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), F.col("sha_1").alias("edited_sha256"), F.col("fp_0").alias("fp"), F.col("fp_1").alias("edited_fp"), "next_fp"
    )


def near_counts(found: DataFrame, every: int = 50, radius: int = 3, blocks: int = 5, words: int = len(SEEDS)) -> DataFrame:
    """``fp, n_near`` for the fingerprints of rows whose id is divisible by ``every``: how many rows of
    ``found`` (``doc_id``, ``fp``) lie within ``radius`` bits, the row itself included."""
    classes = stage(found.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") % every == 0).alias("asked")), "classes")
    pairs = search(classes.select("fp"), classes.where("asked").select("fp"), radius, blocks, words)
    return pairs.join(classes.select("fp", "n"), "fp").groupBy(F.col("query").alias("fp")).agg(F.sum("n").alias("n_near"))
