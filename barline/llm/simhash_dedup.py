"""SimHash near-duplicates by a self-join of a binary trie.

The trie of all distinct fingerprints is joined with itself: two nodes are walked down together, the
differing bits of their prefixes add up, and a pair is pruned as soon as they exceed the budget. With
a budget of k, two linked fingerprints agree wholly in one of k + 1 blocks of bits, so the walk runs
over k + 1 rotations of the fingerprint and starts, in each, at the nodes whose first block is equal.
Every step of the walk is a pair of joins on node prefixes, so a node with very many fingerprints
below it is dealt out over its children and never meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import components, free, id_text, lookup, stage, texts_in

BITS = 64
STEP = 6  # bits per step of the walk: a pair of nodes has at most 2**12 pairs of children


def fingerprint(text: str, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, as an unsigned 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = iter([b" ".join(words)])
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    count = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), parts), np.uint64, count)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, count, 4096):
        votes += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > count, bitorder="little").view("<u8")[0])


def _digest(text_column: str) -> Column:
    """What tells the texts of one id apart; a null text is the empty text."""
    return F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed long, and ``digest`` of the text if asked for; a null text is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in texts_in(batch)), np.uint64, batch.num_rows)
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found.view(np.int64))], [*names, "fp"])

    source = id_text(docs, id_column, text_column)
    kind = dict(source.dtypes)["doc_id"]
    if digest:
        return source.withColumn("digest", _digest("text")).mapInArrow(run, f"doc_id {kind}, digest bigint, fp bigint")
    return source.mapInArrow(run, f"doc_id {kind}, fp bigint")


def _rotated(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _prefix(path: Column, depth: int) -> Column:
    return path if depth == BITS else F.shiftrightunsigned(path, BITS - depth)


def links(fps: DataFrame, budget: int = 2) -> DataFrame:
    """``a, b``: all pairs of distinct fingerprints ``fp`` that differ in at most ``budget`` bits."""
    if not 0 <= budget < BITS:
        raise ValueError("the budget has to be between 0 and 63 bits")
    starts = [BITS * i // (budget + 1) for i in range(budget + 1)]
    block = min(b - a for a, b in zip(starts, [*starts[1:], BITS]))
    turned = F.array(*[F.struct(F.lit(i).alias("turn"), _rotated(F.col("fp"), s).alias("path")) for i, s in enumerate(starts)])
    leaves = fps.select(F.explode(turned).alias("t")).select("t.turn", "t.path")
    # Nodes with a single fingerprint below them have no partner.
    root = leaves.groupBy("turn", _prefix(F.col("path"), block).alias("node")).agg(F.count("*").alias("n")).where("n > 1")
    busy = stage(
        leaves.withColumn("node", _prefix(F.col("path"), block)).join(root.select("turn", "node"), ["turn", "node"], "left_semi").select("turn", "path"),
        "trie",
    )
    pairs = busy.select("turn", _prefix(F.col("path"), block).alias("p")).distinct().select("turn", "p", F.col("p").alias("q"), F.lit(0).alias("used"))
    depth = block
    while depth < BITS:
        below = min(BITS, depth + STEP)
        children = busy.groupBy("turn", _prefix(F.col("path"), depth).alias("node"), _prefix(F.col("path"), below).alias("child")).agg(F.count("*").alias("n"))
        children = stage(children, "children")
        left = children.select("turn", F.col("node").alias("p"), F.col("child").alias("pc"), F.col("n").alias("pn"))
        right = children.select("turn", F.col("node").alias("q"), F.col("child").alias("qc"))
        apart = F.bit_count(F.col("pc").bitwiseXOR(F.col("qc")))  # of the whole prefixes: the sum down the path
        same = F.col("pc") == F.col("qc")
        kept = (apart <= budget) & F.when(F.col("p") == F.col("q"), F.col("pc") <= F.col("qc")).otherwise(True)
        kept = kept & (~same | ((F.col("pn") > 1) & F.lit(below < BITS)))
        pairs = stage(
            pairs.join(left, ["turn", "p"]).join(right, ["turn", "q"]).where(kept).select("turn", F.col("pc").alias("p"), F.col("qc").alias("q"), apart.alias("used")),
            "pairs",
        )
        depth = below
    back = lambda c: F.coalesce(*[F.when(F.col("turn") == i, _rotated(F.col(c), (BITS - s) % BITS)) for i, s in enumerate(starts)])
    return pairs.select(back("p").alias("x"), back("q").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 3, budget: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, fp, component_id``: fingerprints at most ``budget`` bits apart are linked.

    ``component_id`` is the smallest id that links reach. Null and empty texts have fingerprint zero and
    link as any other. Rows that repeat an id stay; a null id takes part and is the component only if
    no row of it has an id.
    """
    rows = stage(fingerprints(docs, shingle, id_column, text_column), "fingerprints")
    return _labelled(rows, budget, "component_id").select("doc_id", "fp", "component_id")


def _labelled(rows: DataFrame, budget: int, *columns: str) -> DataFrame:
    """``rows`` with columns of their component: its ``label`` (smallest fingerprint) and ``component_id``."""
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    label = components(nodes.select(F.col("fp").alias("node")), links(nodes.select("fp"), budget)).withColumnRenamed("node", "fp")
    label = stage(label.join(nodes, "fp"), "label")
    group = label.groupBy("label").agg(F.min("least").alias("component_id"))
    named = stage(lookup(label.select("fp", "label"), group, "label").select("fp", *columns), "named")
    return lookup(rows, named, "fp")


def keep_first(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """One row of each component: of its rows with the smallest id, the one with the smallest digest of its text.

    Rows without an id are kept only where their component has no id, one for each. An id whose texts are
    in several components can stay for each of them; of rows that repeat id and text any one stays.
    """
    rows = stage(fingerprints(docs, shingle, digest=True), "fingerprints")
    found = _labelled(rows, budget, "label", "component_id").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    texts = found.groupBy("label", "component_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = texts.groupBy("label").agg(F.min(F.struct("digest", "component_id", "n")).alias("first"))
    own, id_, digest, n = (free(docs.columns, c) for c in ("_own", "_id", "_digest", "_n"))
    first = stage(first.select(F.col("first.component_id").alias(id_), F.col("first.digest").alias(digest), F.col("first.n").alias(n)), "first")
    marked = docs.withColumn(own, _digest("text"))
    kept = marked.join(first.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(digest)), "left_semi")
    if first.where(F.col(n) > 1).take(1):
        kept = kept.dropDuplicates(["doc_id", own])
    return kept.select(*docs.columns)
