"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

Every string of ``length`` bytes holds an anchor: the window of ``KGRAM`` bytes whose hash is the smallest
in it. Equal strings have their anchor in the same place, so only occurrences of one anchor have to
be compared, by the context of an anchor: all bytes that share a string of ``length`` with it.

1. Each task finds the anchors of its documents. An anchor whose whole context was seen earlier in the
   batch is covered; the others meet by anchor, sorted, where the first of each context is kept and
   the others are covered.
2. First contexts of an anchor that has several are cut into chunks on the right of the anchor, and a
   suffix array over these, built by linear grouping, tells how far each agrees with its neighbours.
   That bounds the strings that can occur twice; an exact comparison of these strings follows.
3. The covered spans of a document are put together and cut out.

The suffix array is built by processing groups of suffixes with the same Lyndon prefix in descending
order, refining lower groups through previous-smaller pointers, and then emitting each group's order
from the order of what follows; nothing is renamed and no recursion is needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import importable, slices, stage

LENGTH = 100
KGRAM = 32
CHUNKS = 4
GROUP_BYTES = 1 << 20
LOT = 4096  # contexts whose suffixes are sorted together
HOT_CONTEXTS = 20_000  # contexts of one anchor that a task compares; beyond, their strings are dealt out
LAST = (1 << 63) - 1

U64 = np.uint64


# ---- suffix array by linear grouping ------------------------------------------------------------------


def suffix_array(text: Sequence[int]) -> list[int]:
    """Suffix array of a sequence of non-negative integers."""
    n = len(text)
    if not n:
        return []
    # Phase 1. A group is a run of ``order``; ``start[i]`` is where the group of suffix i begins.
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    start = [0] * n
    size = [0] * n
    begin = 0
    for at, i in enumerate(order):
        if text[i] != text[order[begin]]:
            begin = at
        place[i] = at
        start[i] = begin
        size[begin] += 1
    previous = [-1] * n
    end = n
    while end > 0:
        begin = start[order[end - 1]]
        group = sorted(order[begin:end])
        pointed: dict[int, int] = {}
        for i in group:
            j = i - 1
            while j >= 0 and start[j] >= begin:  # the nearest earlier suffix of a lower group
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        # Suffixes pointed at more often go higher; each leaves its group for a new one right behind it.
        by_count: dict[int, list[int]] = {}
        for j, times in pointed.items():
            by_count.setdefault(times, []).append(j)
        for times in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[times]:
                g = start[j]
                last = g + size[g] - 1 - moved.get(g, 0)
                other = order[last]
                order[place[j]], order[last] = other, j
                place[other], place[j] = place[j], last
                moved[g] = moved.get(g, 0) + 1
            for g, many in moved.items():
                first = g + size[g] - many
                if first == g:
                    continue  # the whole group moves: it stays where it is
                size[g] -= many
                size[first] = many
                for at in range(first, first + many):
                    start[order[at]] = first
        end = begin
    # Phase 2. Suffixes that end before a known one follow each other in its order.
    free = list(range(n))  # per group start: its next open place
    result = [-1] * n
    done = [False] * n
    # The suffix behind the last symbol is empty and comes first of all.
    def follow(j: int) -> None:
        while j >= 0 and not done[j]:
            g = start[j]
            result[free[g]] = j
            free[g] += 1
            done[j] = True
            j = previous[j]

    follow(n - 1)
    for at in range(n):
        follow(result[at] - 1)
    return result


# ---- anchors ------------------------------------------------------------------------------------------


def _levels(codes: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Hashes of all windows of 1, 2, 4, ... codes up to ``most``."""
    out = {1: codes * U64(0xBF58476D1CE4E5B9)}
    n = 1
    while 2 * n <= most:
        a, b = out[n][:-n], out[n][n:]
        h = (a * U64(0x94D049BB133111EB + 2 * n)) ^ (b + (b >> U64(31)))
        h *= U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
        n *= 2
        out[n] = h
    return out


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every window of ``width`` values."""
    n, out = 1, values
    while 2 * n <= width:
        out = best(out[:-n], out[n:])
        n *= 2
    return out if n == width else best(out[: len(values) - width + 1], out[width - n : len(values) - n + 1])


def anchors(documents: Sequence[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, place, hash of the anchor and hash of its context, for all anchors of all documents."""
    side = length - KGRAM
    whole = 2 * side + KGRAM
    sizes = np.array([len(d) for d in documents], np.int64)
    offsets = np.cumsum(sizes + side) - sizes  # a gap before every document, one behind the last
    total = int(sizes.sum()) + side * (len(documents) + 1)
    codes = np.zeros(total, np.uint64)
    inside = np.zeros(total, bool)
    for d, at in zip(documents, offsets.tolist()):
        codes[at : at + len(d)] = np.frombuffer(d, np.uint8)
        codes[at : at + len(d)] += U64(1)
        if len(d) >= length:
            inside[at : at + len(d) - length + 1] = True
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none
    widest = 1 << (whole.bit_length() - 1)
    levels = _levels(codes, max(widest, KGRAM))
    grams = levels[KGRAM]
    least = _sliding(grams, side + 1, np.minimum)
    least[~inside[: len(least)]] = 0
    lead = np.zeros(side, np.uint64)
    chosen = _sliding(np.concatenate([lead, least, lead]), side + 1, np.maximum)
    at = np.flatnonzero((chosen == grams) & (chosen > 0))
    ends = levels[widest]
    context = (ends[at - side] * U64(0xD6E8FEB86659FD93)) ^ (ends[at - side + whole - widest] + U64(0x632BE59BD9B4E019))
    context ^= context >> U64(32)
    context *= U64(0xD6E8FEB86659FD93)
    document = np.searchsorted(offsets, at, "right") - 1
    return document, at - offsets[document], grams[at].view(np.int64), context.view(np.int64)


def _parted(document: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Place, anchor and context hash of a very long document, a part at a time; parts overlap by more
    than an anchor looks at, so they have the anchors of the whole."""
    margin = 3 * length
    for at in range(0, len(document), GROUP_BYTES):
        begin = max(0, at - margin)
        _, place, gram, context = anchors([document[begin : at + GROUP_BYTES + margin]], length)
        place = place + begin
        own = (place >= at) & (place < at + GROUP_BYTES)
        yield place[own], gram[own], context[own]


# Where an anchor stands and how far its context reaches to either side, in one number.
def _packed(place: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    left = np.minimum(place, length - KGRAM)
    return place << 16 | left << 8 | np.minimum(size - place, length)


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, and start and end of the context."""
    place = packed >> 16
    return place, place - (packed >> 8 & 255), place + (packed & 255)


_MET = "cover boolean, k bigint, c bigint, doc bigint, tie bigint, packed bigint"
_NAMES = ["cover", "k", "c", "doc", "tie", "packed"]


def _rows(*columns: np.ndarray, cover: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), cover)), *(pa.array(c.astype(np.int64, copy=False)) for c in columns)], _NAMES)


def _covers(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Cover rows, overlapping ones of a document merged. Ends rise with starts, as contexts are cut by the document alone."""
    if not len(doc):
        return
    order = np.lexsort((end, start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], end[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(fresh)
    reach = np.maximum.reduceat(end, first)
    yield _rows(doc[first], reach, doc[first], tie[first], start[first], cover=True)


def _find(length: int):
    """Anchors of each batch: the first of every context, and the covers of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for batch in slices(whole, 256):
                docs, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
                texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
                at = 0
                while at < len(texts):
                    end, size = at + 1, len(texts[at])
                    while end < len(texts) and size + len(texts[end]) < GROUP_BYTES:
                        size += len(texts[end])
                        end += 1
                    if len(texts[at]) > 4 * GROUP_BYTES:
                        for place, gram, context in _parted(texts[at], length):
                            found.append((gram, context, np.full(len(place), docs[at]), np.full(len(place), ties[at]), _packed(place, len(texts[at]), length)))
                    else:
                        document, place, gram, context = anchors(texts[at:end], length)
                        sizes = np.array([len(t) for t in texts[at:end]], np.int64)
                        found.append((gram, context, docs[at:end][document], ties[at:end][document], _packed(place, sizes[document], length)))
                    at = end
            if not found:
                continue
            k, c, doc, tie, packed = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((packed, tie, doc, c, k))
            k, c, doc, tie, packed = k[order], c[order], doc[order], tie[order], packed[order]
            again = np.zeros(len(k), bool)
            again[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
            same = again.copy()
            same[1:] &= (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (packed[1:] == packed[:-1])
            _, start, stop = _unpacked(packed)
            again &= ~same
            yield _rows(*(x[~again & ~same] for x in (k, c, doc, tie, packed)), cover=False)
            yield from _covers(doc[again], tie[again], start[again], stop[again])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, context and place: covers for all but the first of a context, and the
    first ones of anchors with several contexts. One row is held from batch to batch."""
    last: tuple[int, ...] | None = None  # the row before
    held: tuple[int, ...] | None = None  # the last first-of-context, not yet known to have company
    shared = False  # whether the one before it had the same anchor
    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in _NAMES]
        cover = columns[0].astype(bool)
        if cover.any():
            yield _rows(*(c[cover] for c in columns[1:]), cover=True)
        k, c, doc, tie, packed = rows = [x[~cover] for x in columns[1:]]
        if not len(k):
            continue
        before = [np.concatenate([[last[n] if last else 0], x[:-1]]) for n, x in enumerate(rows)]
        again = (k == before[0]) & (c == before[1])
        same = again & (doc == before[2]) & (tie == before[3]) & (packed == before[4])
        if last is None:
            again[0] = same[0] = False
        last = tuple(int(x[-1]) for x in rows)
        more = again & ~same
        _, start, stop = _unpacked(packed)
        yield from _covers(doc[more], tie[more], start[more], stop[more])
        firsts = [x[~again] for x in rows]
        if held:
            firsts = [np.concatenate([[held[n]], x]) for n, x in enumerate(firsts)]
        if not len(firsts[0]):
            continue
        with_next = np.append(firsts[0][1:] == firsts[0][:-1], False)
        with_last = np.insert(with_next[:-1], 0, shared if held else False)
        out = (with_next | with_last)[:-1]
        held, shared = tuple(int(x[-1]) for x in firsts), bool(with_last[-1])
        if out.any():
            yield _rows(*(x[:-1][out] for x in firsts), cover=False)
    if held and shared:
        yield _rows(*(np.array([x]) for x in held), cover=False)


# ---- contexts of one anchor ----------------------------------------------------------------------------


def agreement(keys: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Per row the most chunks, from the first on, that it shares with another row of its key.

    Rows become fragments ``key, chunk, chunk, ..., 0`` of one sequence; in its suffix array the
    fragments that agree furthest stand side by side.
    """
    rows, width = chunks.shape
    if rows < 2:
        return np.full(rows, -1)
    symbols = np.zeros((rows, width + 2), np.int64)
    _, own = np.unique(keys, return_inverse=True)
    _, cut = np.unique(chunks.reshape(-1), return_inverse=True)
    symbols[:, 0] = own + 1
    symbols[:, 1:-1] = cut.reshape(rows, width) + 1
    array = np.array(suffix_array(symbols.reshape(-1).tolist()))
    order = array[array % (width + 2) == 0] // (width + 2)
    near = symbols[order]
    common = np.cumprod(near[1:, :-1] == near[:-1, :-1], axis=1).sum(axis=1)
    out = np.zeros(rows, np.int64)
    out[order[1:]] = common
    out[order[:-1]] = np.maximum(out[order[:-1]], common)
    return out - 1


_WEIGHTS = np.random.default_rng(7).integers(1, 1 << 62, 512, dtype=np.uint64) * U64(2) + U64(1)


def compare(keys: np.ndarray, contexts: Sequence[bytes], left: np.ndarray, right: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For contexts in document order, the least and most bytes before the anchor with which a string of
    ``length`` begins that an earlier context of the same key holds too; ``length`` and -1 for none."""
    side = length - KGRAM
    whole, rows = 2 * side + KGRAM, len(keys)
    sizes = left + right
    grid = np.zeros((rows, whole), np.uint8)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    owner = np.repeat(np.arange(rows), sizes)
    grid[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + side - left[owner]] = flat
    sums = np.zeros((rows, whole + 1), np.uint64)
    np.cumsum((grid.astype(np.uint64) + U64(1)) * _WEIGHTS[:whole], axis=1, out=sums[:, 1:])
    step = side // CHUNKS
    cuts = side + KGRAM + step * np.arange(CHUNKS + 1)
    chunks = sums[:, cuts[1:]] - sums[:, cuts[:-1]]
    agreed = agreement(keys, chunks + np.arange(CHUNKS, dtype=np.uint64))
    low, high = np.full(rows, length), np.full(rows, -1)
    mixed = keys.view(np.uint64) * U64(0x9E3779B97F4A7C15)
    for before in range(side + 1):
        able = np.flatnonzero((left >= before) & (right >= length - before) & (agreed >= (side - before) // step))
        if len(able) < 2:
            continue
        a, b = side - before, side - before + length
        code, found = pd.factorize((sums[able, b] - sums[able, a]) ^ mixed[able])
        if len(found) == len(able):
            continue
        first = np.empty(len(found), np.int64)
        first[code[::-1]] = np.arange(len(able))[::-1]
        twin = able[first[code]]
        again = np.flatnonzero(twin != able)
        own, other = able[again], twin[again]
        if not ((keys[own] == keys[other]) & (grid[own, a:b] == grid[other, a:b]).all(axis=1)).all():
            code = pd.factorize(pd.Series([(int(keys[i]), grid[i, a:b].tobytes()) for i in able]))[0]  # two strings of one hash
            own = able[pd.Series(code).duplicated().to_numpy()]
        low[own] = np.minimum(low[own], before)
        high[own] = before
    return low, high


_CONTEXT = "k bigint, doc bigint, tie bigint, place bigint, reach int, context binary"


def _cut(length: int, hot: bool):
    """Contexts of the wanted anchors of each document; of hot ones, all their strings by hash instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 128):
                out: list[list] = [[] for _ in range(6)]
                for doc, tie, text, wanted in zip(*(batch.column(n).to_pylist() for n in ("doc", "tie", "text", "wanted"))):
                    raw = text.encode("utf-8", "surrogatepass")
                    for one in wanted:
                        if one["hot"] != hot:
                            continue
                        place = one["packed"] >> 16
                        left, right = one["packed"] >> 8 & 255, one["packed"] & 255
                        context = raw[place - left : place + right]
                        if not hot:
                            for column, value in zip(out, (one["k"], doc, tie, place, left, context)):
                                column.append(value)
                            continue
                        for at in range(len(context) - length + 1):
                            digest = hashlib.blake2b(context[at : at + length], digest_size=16).digest()
                            start = place - left + at
                            high, low = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                            for column, value in zip(out, (high, low, doc, tie, start << 16 | length)):
                                column.append(value)
                if not out[0]:
                    continue
                if hot:
                    yield _rows(*(np.array(c, np.int64) for c in out[:5]), cover=False)
                else:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["k", "doc", "tie", "place", "reach", "context"])

    return run


def _sort_out(length: int):
    """Contexts sorted by anchor and document order, compared a lot of whole anchors at a time."""

    def lot(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        k, doc, tie, place, left = (table.column(n).to_numpy().astype(np.int64) for n in ("k", "doc", "tie", "place", "reach"))
        contexts = table.column("context").to_pylist()
        right = np.array([len(c) for c in contexts], np.int64) - left
        low, high = compare(k, contexts, left, right, length)
        hit = np.flatnonzero(high >= 0)
        yield from _covers(doc[hit], tie[hit], (place - high)[hit], (place - low)[hit] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = 0
            k = batch.column("k").to_numpy()
            for cut in [*(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), None]:
                if cut is None:
                    break
                if count + cut - at >= LOT:
                    yield from lot([*held, batch.slice(at, cut - at)])
                    held, count, at = [], 0, cut
            # The end of the batch may be in the middle of an anchor, or just behind one.
            if held and count >= LOT and held[-1].column("k")[-1].as_py() != int(k[at]):
                yield from lot(held)
                held, count = [], 0
            held.append(batch.slice(at))
            count += batch.num_rows - at
        if held:
            yield from lot(held)

    return run


# ---- documents ------------------------------------------------------------------------------------------


def merged(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of a set of spans; spans that touch are one run."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for whole in batches:
        for batch in slices(whole):
            sizes, spans, kept = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                runs = merged([(s["start"], s["end"]) for s in found or []])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                sizes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else raw)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def dedup(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row: the removed runs of bytes and the bytes that stay.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a document with a smaller
    id or further up in the same one. Matches never cross documents. A null text is the empty text; a
    null id comes after all others; rows that repeat an id stand in the order of a hash of their texts,
    and rows that repeat id and text are one document with one result. Ids are integers.
    """
    if not KGRAM < length <= 255 or length + length - KGRAM > len(_WEIGHTS) or (length - KGRAM) % CHUNKS:
        raise ValueError(f"length has to be over {KGRAM}, at most 255, and leave a multiple of {CHUNKS}")
    importable(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    source = source.withColumn("doc", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)))
    repeated = source.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)
    source = source.withColumn("tie", F.xxhash64("text") if repeated else F.lit(0).cast("bigint"))
    order = ["k", "c", "doc", "tie", "packed"]
    found = source.select("doc", "tie", "text").mapInArrow(_find(length), _MET)
    met = stage(found.repartition("k").sortWithinPartitions(*order).mapInArrow(_meet, _MET), "met")
    wanted = met.where("not cover")
    hot = wanted.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_CONTEXTS).select("k", F.lit(True).alias("hot"))
    hot = stage(hot, "hot")  # at most one row per HOT_CONTEXTS contexts
    any_hot = bool(hot.take(1))
    wanted = wanted.join(F.broadcast(hot), "k", "left") if any_hot else wanted.withColumn("hot", F.lit(False))
    lists = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("k", "packed", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    # Rows that repeat a document ask for it once; their texts are equal.
    asked = source.select("doc", "tie", "text").join(lists.hint("shuffle_hash"), ["doc", "tie"])
    if repeated:
        asked = asked.dropDuplicates(["doc", "tie"])
    contexts = asked.mapInArrow(_cut(length, False), _CONTEXT)
    covers = met.where("cover").unionByName(contexts.repartition("k").sortWithinPartitions("k", "doc", "tie", "place").mapInArrow(_sort_out(length), _MET))
    if any_hot:
        strings = asked.mapInArrow(_cut(length, True), _MET).repartition("k").sortWithinPartitions(*order)
        covers = covers.unionByName(strings.mapInArrow(_meet, _MET).where("cover"))
    runs = stage(covers.select("doc", "tie", F.col("packed").alias("start"), F.col("c").alias("end")), "covers")
    runs = runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = source.join(runs.hint("shuffle_hash"), ["doc", "tie"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_keep, f"doc_id {dict(source.dtypes)['doc_id']}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
