"""Periodic runs of words by grammar compression.

A run is a stretch of words with smallest period ``q`` that is at least ``shortest`` words and two
periods long and that no neighbouring word extends. The word ids of a document are compressed by
Re-Pair; each nonterminal's expansion is searched once for the runs that cross the boundary between
its two halves, the runs found are translated to every position the nonterminal derives, and
intervals of one period that overlap by a period merge into maximal ones. A run is found whole at the
lowest node of the derivation that contains it.

The words between which nothing can repeat are left out before compression: a run of length ``n`` and
period ``q`` has ``n - q >= shortest / 2``, so every word of it lies in a string of half the shortest
length that occurs twice in the document. Words outside such strings part the document into segments.

Every document is a row of its own, handled by one task in memory proportional to its words, times the
logarithm of the longest repeat for those words that take part in repeats.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import importable, slices

CELLS = 1 << 20  # pairs of boundary and period looked at together
Run = tuple[int, int, int]  # (start, length, period)


# ---- grammar --------------------------------------------------------------------------------------


def re_pair(ids: np.ndarray) -> tuple[list[tuple[int, int]], list[int], int]:
    """``rules, start, terminals``: symbol ``terminals + r`` derives the two symbols of ``rules[r]``.

    The most frequent pair of neighbours becomes a symbol until no pair occurs twice.
    """
    n, terminals = len(ids), int(ids.max()) + 1 if len(ids) else 0
    base = terminals + n  # above every symbol
    sym, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    keys = ids[:-1].astype(np.int64) * base + ids[1:]
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    where: dict[int, list[int]] = {}
    for part in np.split(order, cuts):
        if len(part) > 1:
            where[int(keys[part[0]])] = part.tolist()
    heap = [(-len(at), key) for key, at in where.items()]
    heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        known, key = heappop(heap)
        if key not in where:
            continue
        a, b = divmod(key, base)
        live = sorted({i for i in where[key] if sym[i] == a and after[i] < n and sym[after[i]] == b})
        if len(live) < 2:
            del where[key]
            continue
        where[key] = live
        if len(live) < -known and heap and heap[0][0] < -len(live):
            heappush(heap, (-len(live), key))
            continue
        del where[key]
        new = terminals + len(rules)
        rules.append((a, b))
        touched = set()
        for i in live:
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:  # overlaps the one before
                continue
            k, p = after[j], before[i]
            sym[i], sym[j], after[i] = new, -1, k
            if k < n:
                before[k] = i
                touched.add(new * base + sym[k])
                where.setdefault(new * base + sym[k], []).append(i)
            if p >= 0:
                touched.add(sym[p] * base + new)
                where.setdefault(sym[p] * base + new, []).append(p)
        for t in touched:
            if len(where[t]) > 1:
                heappush(heap, (-len(where[t]), t))
            # A pair seen once stays listed: later rules may add to it.
    start, i = [], 0
    while i < n:
        start.append(sym[i])
        i = after[i]
    return rules, start, terminals


def _rooted(rules: list[tuple[int, int]], start: list[int], terminals: int) -> list[tuple[int, int]]:
    """The rules with a balanced tree over the start sequence behind them; the last one is the root."""
    rules, level = list(rules), start
    while len(level) > 1:
        up = []
        for i in range(0, len(level) - 1, 2):
            up.append(terminals + len(rules))
            rules.append((level[i], level[i + 1]))
        level = up + level[len(up) * 2 :]
    return rules


# ---- longest common extensions ------------------------------------------------------------------------


class Names:
    """Exact names of all substrings of power-of-two length: of one length, equal names mean equal substrings.

    The ids are dense: each is below the length of the sequence.
    """

    def __init__(self, ids: np.ndarray):
        self.size, self.levels = len(ids), [ids.astype(np.int64)]
        while 2 << (len(self.levels) - 1) <= self.size:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            kinds, named = np.unique(last[:-half] * self.size + last[half:], return_inverse=True)  # every name is below the size
            if len(kinds) == len(named):  # all differ, so all longer ones do
                break
            self.levels.append(named.astype(np.int64))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` on equal those from ``j > i`` on."""
        found = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            for _ in range(1 if k < len(self.levels) - 1 else self.size >> k):
                a, b = i + found, j + found
                fits = b < len(names)
                same = fits & (names[np.where(fits, a, 0)] == names[np.where(fits, b, 0)])
                if not same.any():
                    break
                found += same << k
        return found

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to and with ``i`` equal those up to and with ``j > i``."""
        found = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            for _ in range(1 if k < len(self.levels) - 1 else self.size >> k):
                a, b = i - found - (1 << k) + 1, j - found - (1 << k) + 1
                fits = a >= 0
                same = fits & (names[np.where(fits, a, 0)] == names[np.where(fits, b, 0)])
                if not same.any():
                    break
                found += same << k
        return found


# ---- runs ---------------------------------------------------------------------------------------------


def _crossing(ids: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray, shortest: int) -> tuple[np.ndarray, ...]:
    """``node, start, end, period`` of the runs inside ``[low, high)`` that hold the words on both sides of ``mid``."""
    names = Names(ids)
    found = []
    sizes = (high - low) // 2
    at = 0
    while at < len(low):  # nodes in chunks of about CELLS pairs of boundary and period
        to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), CELLS, side="right")) + at)
        node = np.repeat(np.arange(at, to), sizes[at:to])
        q = np.arange(len(node)) - np.repeat(np.cumsum(sizes[at:to]) - sizes[at:to], sizes[at:to]) + 1
        at = to
        b, m, e = low[node], mid[node], high[node]
        for right in (True, False):  # a run holds a whole period on one side of the boundary
            fits = q <= (e - m if right else m - b)
            first = m - 1 if right else m - q
            fits &= ids[np.where(fits, first, 0)] == ids[np.where(fits, first + q, 0)]
            k, p, lo, hi, c = node[fits], q[fits], b[fits], e[fits], (m if right else m - q)[fits]
            ahead = np.minimum(names.forward(c, c + p), hi - c - p)
            back = np.minimum(names.backward(c - 1, c - 1 + p), c - lo)
            start, end = c - back, c + p + ahead
            long = (end - start >= 2 * p) & (end - start >= shortest)
            found.append(np.stack([k[long], start[long], end[long], p[long]]))
    node, start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start, node))  # of equal intervals the smallest period stays
    node, start, end, period = node[order], start[order], end[order], period[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[new], start[new], end[new], period[new]


def _maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows ``start, end, period``: intervals of one period that overlap by a period become one."""
    order = np.lexsort((end, start, period))
    start, end, period = start[order], end[order], period[order]
    span = int(end.max()) + 1 if len(end) else 1
    reach = np.maximum.accumulate(end + period * span) - period * span  # the farthest end so far, within a period
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] + period[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return np.stack([start[first], reach[last], period[first]]) if len(first) else np.zeros((3, 0), np.int64)


def _segments(ids: np.ndarray, shortest: int) -> np.ndarray:
    """Positions of the words that a run can hold."""
    n, gram = len(ids), (shortest + 1) // 2
    if n < max(shortest, gram + 1):
        return np.zeros(0, np.int64)
    code = ids[: n - gram + 1].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, gram):  # equal strings have equal codes; a chance meeting only keeps a word
            code = code * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - gram + 1 + k].astype(np.uint64)
            code ^= code >> np.uint64(29)
    order = np.argsort(code)
    same = np.diff(code[order]) == 0
    twice = np.zeros(n + 1, np.int64)
    hits = np.unique(np.concatenate([order[:-1][same], order[1:][same]]))
    np.add.at(twice, hits, 1)
    np.add.at(twice, hits + gram, -1)
    return np.flatnonzero(np.cumsum(twice[:n]) > 0)


def runs_of(ids: np.ndarray, shortest: int = 12) -> list[Run]:
    """All runs of a sequence of ids, by start and then period."""
    kept = _segments(ids, shortest)
    if not len(kept):
        return []
    # A symbol of its own behind each segment keeps its neighbours apart.
    gaps = np.flatnonzero(np.diff(kept) > 1) + 1
    _, dense = np.unique(ids[kept], return_inverse=True)
    borders = np.append(gaps, len(kept))
    seq = np.insert(dense, borders, dense.max() + 1 + np.arange(len(borders)))
    origin = np.insert(kept, borders, -1)
    rules, start, terminals = re_pair(seq)
    rules = _rooted(rules, start, terminals)
    size = [1] * terminals
    for a, b in rules:
        size.append(size[a] + size[b])
    places: dict[int, list[np.ndarray]] = defaultdict(list)
    at: dict[int, np.ndarray] = {}
    places[len(size) - 1].append(np.zeros(1, np.int64))
    for r in range(len(rules) - 1, -1, -1):  # a rule only names symbols before it
        s = terminals + r
        if s not in places:
            continue
        at[s] = np.concatenate(places.pop(s))
        a, b = rules[r]
        if size[a] >= shortest:
            places[a].append(at[s])
        if size[b] >= shortest:
            places[b].append(at[s] + size[a])
    symbols = np.fromiter(at, np.int64, len(at))
    lengths = np.array(size)
    low = np.array([at[s][0] for s in symbols.tolist()])
    mid = low + lengths[[rules[s - terminals][0] for s in symbols.tolist()]]
    high = low + lengths[symbols]
    # Only the tree over the start sequence reaches over the ends of segments.
    ends = borders + np.arange(len(borders))
    low, high = np.maximum(low, np.append(-1, ends)[np.searchsorted(ends, mid - 1, side="left")] + 1), np.minimum(high, ends[np.minimum(np.searchsorted(ends, mid), len(ends) - 1)])
    usable = (low < mid) & (mid < high) & (high - low >= shortest)
    symbols, low, mid, high = symbols[usable], low[usable], mid[usable], high[usable]
    if not len(symbols):
        return []
    node, begin, end, period = _crossing(seq, low, mid, high, shortest)
    shifts = [at[s] - at[s][0] for s in symbols[node].tolist()]
    times = np.fromiter(map(len, shifts), np.int64, len(shifts))
    moved = np.concatenate(shifts) if shifts else np.zeros(0, np.int64)
    begin, end, period = _maximal(np.repeat(begin, times) + moved, np.repeat(end, times) + moved, np.repeat(period, times))
    begin, length = origin[begin], end - begin
    order = np.lexsort((period, begin))
    return list(zip(begin[order].tolist(), length[order].tolist(), period[order].tolist()))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, shortest: int = 12, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: its runs by start, and its text with each run cut to one period.

    Words are parted by ASCII white space. A null or empty text has no words, no runs and an empty
    collapsed text. Rows that repeat an id or lack one are rows of their own; other columns are not read.
    Of equal intervals only the smallest period is a run, so nothing is left to ties. A very long text
    is handled whole, by one task. An empty table gives none.
    """
    if shortest < 2:
        raise ValueError("a run has two words at least")
    importable(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    run = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, runs, kept = [], [], []
                for text in part.column("text").to_pylist():
                    words = text.split()
                    number = defaultdict(count().__next__)
                    found = runs_of(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), shortest)
                    n.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    kept.append(collapsed(words, found))
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    found = source.mapInArrow(search, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def longest(runs: str = "runs") -> Column:
    """The longest run of a row, the first and then the shortest period among equals; null without runs."""
    keyed = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(keyed)
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period")))


def spelled(runs: str = "runs") -> Column:
    """``start,length,period`` and a line feed for every run."""
    line = lambda r: F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")])
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")
