"""Benchmark decontamination by greedy string tiling.

A document leaks a test item if tiles of it cover enough of the item. Tiles are runs of equal words
that do not overlap on either side; the longest free run is marked first, again and again, so a
passage whose sentences were put in another order is still covered. Runs start from seeds: windows
of ``min_match`` words whose running Karp-Rabin hash the document and the item share.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import id_text, texts_in

WORD = re.compile(r"\w+")
BASE = np.uint64(1_000_003)
BLOCK_BYTES = 16 << 20


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def running_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash modulo 2**64 of every window of k ids."""
    if len(ids) < k:
        return np.empty(0, np.uint64)
    n = len(ids) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * BASE + ids[j : j + n].astype(np.uint64)
    return out


class Index:
    """The seeds of a block of test items. Its size is bounded by the bytes of the block."""

    def __init__(self, items: Sequence[tuple[int, str]], min_match: int):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if ids:
                self.items.append((item, np.array(ids, np.int64)))
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for n, (_, ids) in enumerate(self.items):
            k = min(min_match, len(ids))
            own = self.seeds.setdefault(k, defaultdict(list))
            for at, h in enumerate(running_hashes(ids, k).tolist()):
                own[h].append((n, at))
        self.sorted = {k: np.array(sorted(own), np.uint64) for k, own in self.seeds.items()}

    def matches(self, text: str) -> dict[int, list[tuple[int, int, int]]]:
        """Per item the maximal runs (document word, item word, length) that contain a seed."""
        ids = np.fromiter(map(self.vocabulary.get, words(text), repeat(0)), np.int64)
        found: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
        for k, known in self.sorted.items():
            hashes = running_hashes(ids, k)
            if not len(hashes):
                continue
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            done: dict[tuple[int, int], int] = {}  # item, diagonal -> document word behind the last run
            for at in np.flatnonzero(known[place] == hashes).tolist():
                for n, j in self.seeds[k][int(hashes[at])]:
                    item = self.items[n][1]
                    if done.get((n, at - j), -1) >= at + k or not np.array_equal(ids[at : at + k], item[j : j + k]):
                        continue
                    end, reach = k, min(len(ids) - at, len(item) - j)
                    while end < reach and ids[at + end] == item[j + end]:
                        end += 1
                    done[n, at - j] = at + end
                    found[n].add((at, j, end))
        return {n: sorted(runs) for n, runs in found.items()}


def tiles(runs: Sequence[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: mark the longest run that is free on both sides until none has ``least`` words.

    Ties go to the earlier document word, then the earlier item word. A run that is partly marked goes
    back as its free parts.
    """
    heap = [(-length, i, j) for i, j, length in runs]
    heapq.heapify(heap)
    used_doc: set[int] = set()
    used_item: set[int] = set()
    out = []
    while heap:
        size, i, j = heapq.heappop(heap)
        free = [p for p in range(-size) if i + p not in used_doc and j + p not in used_item]
        if len(free) == -size:
            out.append((i, j, -size))
            used_doc.update(range(i, i - size))
            used_item.update(range(j, j - size))
            continue
        parts = np.split(np.array(free, np.int64), np.flatnonzero(np.diff(free) > 1) + 1) if free else []
        for part in parts:
            if len(part) >= least:
                heapq.heappush(heap, (-len(part), i + int(part[0]), j + int(part[0])))
    return out


def leaks(
    docs: DataFrame,
    items: DataFrame,
    min_match: int = 5,
    coverage: float = 0.8,
    block_bytes: int = BLOCK_BYTES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, item_id, coverage, n_tiles, tiles`` for every document and item it leaks.

    ``items`` (``item_id``, ``text``) is the query set. Its bytes are counted first; beyond
    ``block_bytes`` it is cut into blocks of about that size by hash, and every block meets all
    documents in turn. ``tiles`` lists ``document word, item word, length``. An item shorter than
    ``min_match`` words has to occur whole. Ids are of any type. Null or empty texts and items leak nothing, an
    empty table gives no rows, and very long texts are searched whole. A pair of ids has one row: of repeated rows, or of several
    texts with one id, the one that covers most, then the one with the greatest tiles. Other columns are not read.
    """
    source = id_text(docs, id_column, text_column)
    schema = f"doc_id {dict(source.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, coverage double, n_tiles int, tiles array<struct<doc_word:int,item_word:int,length:int>>"
    kind = items.select("item_id").limit(0).toArrow().schema.field(0).type
    parts = [source.mapInArrow(_finder(index, min_match, coverage, kind), schema) for index in _indexes(items, min_match, block_bytes)]
    best = F.max(F.struct("coverage", "n_tiles", "tiles")).alias("best")
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _indexes(items: DataFrame, min_match: int, block_bytes: int) -> Iterator[Index]:
    """The items in blocks of about ``block_bytes``, one block at a time on the driver."""
    wanted = items.where("text is not null").select("item_id", "text").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield Index([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()], min_match)


def _leaked(index: Index, text: str, min_match: int, coverage: float) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
    """Item, covered share and tiles of every item that ``text`` leaks."""
    for n, found in index.matches(text).items():
        item, ids = index.items[n]
        marked = tiles(found, min(min_match, len(ids)))
        share = sum(t[2] for t in marked) / len(ids)
        if share >= coverage:
            yield item, share, sorted(marked)


def _finder(index: Index, min_match: int, coverage: float, kind: pa.DataType):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("length", pa.int32())]))
        for batch in batches:
            at, item_ids, shares, runs = [], [], [], []
            for row, text in enumerate(texts_in(batch)):
                for item, share, marked in _leaked(index, text, min_match, coverage):
                    at.append(row)
                    item_ids.append(item)
                    shares.append(share)
                    runs.append([{"doc_word": a, "item_word": b, "length": c} for a, b, c in marked])
            if at:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at)), pa.array(item_ids, kind), pa.array(shares, pa.float64()), pa.array([len(r) for r in runs], pa.int32()), pa.array(runs, tile)],
                    ["doc_id", "item_id", "coverage", "n_tiles", "tiles"],
                )

    return find


def decontaminate(
    docs: DataFrame, items: DataFrame, min_match: int = 5, coverage: float = 0.8, block_bytes: int = BLOCK_BYTES, text_column: str = "text"
) -> DataFrame:
    """``docs`` without the rows that leak an item; all columns stay and no row is shuffled.

    Rows with a null or empty text stay, as do repeated rows that leak nothing; very long texts are searched whole.
    """
    for index in _indexes(items, min_match, block_bytes):
        docs = docs.mapInArrow(_sieve(index, min_match, coverage, text_column), docs.schema)
    return docs


def _sieve(index: Index, min_match: int, coverage: float, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([next(_leaked(index, t, min_match, coverage), None) is None for t in texts_in(batch, text_column)], pa.bool_()))

    return run
