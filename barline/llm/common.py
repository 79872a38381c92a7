"""Helpers that several operators share: staged tables, joins with hot keys, graph components, texts in tasks."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import shared_folder

HOT_KEYS = 1000
HOT_ROWS = 500
MOST_MARKS = 1 << 26  # 8 MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back, which cuts its lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))


def id_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The two columns an operator reads, under its own names; a null text is the empty text."""
    importable(docs.sparkSession)
    return docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def free(columns: Iterable[str], name: str) -> str:
    """``name``, or a longer one that none of the columns has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds


def lookup(rows: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows with a table that has one row per key, whatever share of the rows one key holds.

    A key is hot if it holds over a ``1 / HOT_KEYS`` share of the rows, so there are at most that many;
    their entries are broadcast and their rows stay where they are. All other keys meet in a join. Both
    inputs are read more than once: stage what is costly.
    """
    least = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least).select(key)
    if not hot.take(1):
        return rows.join(small, key, how)
    hot = F.broadcast(stage(hot, "hot"))
    few = F.broadcast(small.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(few, key, how).unionByName(rows.join(hot, key, "left_anti").join(small, key, how))


class Marks:
    """A set of 64-bit hashes as marked bits, of a size that never exceeds ``MOST_MARKS`` bits.

    A hash that was marked is always found; others can be found too, the more the fuller the table is. So it
    spares rows a shuffle but decides nothing: an exact join or grouping has to follow.
    """

    def __init__(self, keys: DataFrame, key: str):
        """``key`` holds signed hashes; they are read twice."""
        self.bits = 1 << 15
        count = keys.count()
        while self.bits < min(16 * count, MOST_MARKS):
            self.bits *= 2
        self.bytes = bytearray(self.bits // 8)
        at = keys.select((F.pmod(F.col(key), F.lit(self.bits)) + 1).alias("at"))
        parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("marked"))
        for row in parts.collect():
            self.bytes[(row["part"] - 1) * 4096 : row["part"] * 4096] = row["marked"]

    def __contains__(self, digest: int) -> bool:
        at = digest & (self.bits - 1)
        return bool(self.bytes[at >> 3] >> (at & 7) & 1)


def components(nodes:DataFrame, links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, label`` for every node: the smallest node that links reach from it.

    ``links`` has columns ``a, b`` of distinct nodes and bounded degree. Each round takes the smallest
    label among the neighbours and then the label of that label, so chains shorten by half.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    linked = stage(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(rounds):
        near = both.join(linked.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = linked.join(near, "node").select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        step = stage(step, "labels")
        if not step.where("moved").take(1):
            linked = step.drop("moved")
            break
        up = step.select(F.col("node").alias("label"), F.col("label").alias("above"))
        linked = stage(lookup(step.drop("moved"), up, "label").select("node", F.least("label", "above").alias("label")), "labels")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(linked, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch, so that few texts are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts_in(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch, one after the other; a null is the empty text."""
    for part in slices(batch):
        for text in part.column(column).to_pylist():
            yield "" if text is None else text
