"""Best-fit packing by a configuration linear program over the length histogram.

Lengths are at most the size of a sequence, so the histogram has a bounded number of entries however
many documents there are, and the program over it is solved on the driver: multiplicative weights on
the lengths, where a knapsack dynamic program prices the configurations under the weights of the
moment. The shares of the full configurations are rounded, the rest is solved again, and the last
pieces go by best fit, each onto the fullest open sequence that still takes it.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import id_text, stage, texts_in

CAPACITY = 4096
END = 1
SALTS = 64
Config = tuple[tuple[int, int], ...]  # (length, how often), longest first


# ---- tokens ---------------------------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """Byte to letter as byte-level tokenizers write them: printable bytes stand for themselves, the
    others, in order, for the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, with the ids of the chunks between ASCII white space kept.

    The tokenizer never joins across white space and folds case, so a text's ids are those of its
    lower-cased chunks in order. A word with punctuation behind it is parted from that as the tokenizer
    parts them, and a word of letters goes straight to the tokenizer's model, as letters of bytes. All
    of this is tested against whole texts. Case is left alone where a special token might stand.
    ``most`` bounds the chunks that are kept from one group of texts to the next.
    """

    PUNCTUATION = b".,;:!?"

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.most = most
        self.known: dict[bytes, bytes] = {}

    def _letters_of(self, word: bytes) -> str | None:
        """A word as the tokenizer's model takes it, if it is made of letters alone: others may join with what is behind them."""
        if word.isalpha():  # ASCII letters
            return word.lower().decode()
        text = word.decode("utf-8", "surrogatepass")
        low = text.lower()
        if not (text.isalpha() and low.isalpha() and is_normalized("NFC", text) and is_normalized("NFC", low)) or "\u03a3" in text:
            return None
        return low.encode().decode("latin-1").translate(self.letters)

    def _pieces(self, texts: list[str], size: int = 256) -> Iterator[bytes]:
        """Ids of texts without line ends, encoded together and cut at the texts' borders."""
        for at in range(0, len(texts), size):
            part = texts[at : at + size]
            encoded = self.tokenizer.encode("\n".join(part), add_special_tokens=False)
            starts = np.array([o[0] for o in encoded.offsets], np.int64)
            cut = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in part]), "left") * 4
            raw, last = np.array(encoded.ids, "<u4").tobytes(), 0
            for end in cut.tolist():
                yield raw[last:end]
                last = end

    def learn(self, chunks: Iterable[bytes]) -> None:
        known, parted, other = self.known, [], {}
        for chunk in chunks:
            word = chunk.rstrip(self.PUNCTUATION)
            text = self._letters_of(word) if word else None
            if text is None:
                other[chunk] = b""
                continue
            ids = known.get(word)
            if ids is None:
                ids = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            if len(word) < len(chunk):
                tail = chunk[len(word) :]
                other[tail] = b""
                parted.append((chunk, ids, tail))
            else:
                known[chunk] = ids
        wanted = [c for c in other if c not in known]
        known.update(zip(wanted, self._pieces([c.decode("utf-8", "surrogatepass") for c in wanted])))
        for chunk, ids, tail in parted:
            known[chunk] = ids + known[tail]

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; about 2 MB of texts are held at a time."""
        left, more = iter(texts), True
        while more:
            size, group, new, more = 0, [], set(), False
            for text in left:
                raw = text.encode("utf-8", "surrogatepass")
                chunks = (raw if b"<|" in raw else raw.lower()).split()
                ids = list(map(self.known.get, chunks))
                gaps = [(n, chunks[n]) for n, i in enumerate(ids) if i is None] if None in ids else ()
                new.update(c for _, c in gaps)
                group.append((ids, gaps) if gaps else (b"".join(ids), gaps))
                size += len(raw)
                if size > 2_000_000:
                    more = True
                    break
            before = len(self.known)
            self.learn(new)
            for ids, gaps in group:
                for n, chunk in gaps:
                    ids[n] = self.known[chunk]
                yield b"".join(ids) if gaps else ids
            surplus = len(self.known) - max(before, self.most)
            for _ in range(surplus):
                self.known.popitem()  # the newest


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the end id, cut to ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        encoder = _ENCODERS[tokenizer]
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encoder(texts_in(batch))):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    source = id_text(docs, id_column, text_column)
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint")


# ---- the program over the histogram ------------------------------------------------------------------


def worths(lengths: np.ndarray, worth: np.ndarray, capacity: int, waste: float = 0.0) -> tuple[np.ndarray, list[int]]:
    """Unbounded knapsack over ascending ``lengths``: the most worth in each room when empty room costs ``waste``
    a token, and how many of the lengths fit into each room."""
    best = np.zeros(capacity + 1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        most = best[room - 1] - waste
        if fits[room]:
            most = max(most, (best[room - lengths[: fits[room]]] + worth[: fits[room]]).max())
        best[room] = most
    return best, fits


def best_config(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> Config:
    """The lengths of most total worth that fit into ``capacity``."""
    order = np.argsort(lengths)
    lengths, worth = lengths[order], worth[order]
    best, fits = worths(lengths, worth, capacity)
    room, out = capacity, Counter()
    while room > 0 and fits[room]:
        values = best[room - lengths[: fits[room]]] + worth[: fits[room]]
        i = int(values.argmax())
        if values[i] < best[room - 1]:
            room -= 1
        else:
            out[int(lengths[i])] += 1
            room -= int(lengths[i])
    return tuple(sorted(out.items(), reverse=True))


def solve(histogram: dict[int, int], capacity: int, rounds: int = 20, gap: float = 0.05, rate: float = 0.5) -> dict[Config, float]:
    """Fractional cover of the histogram by configurations, by multiplicative weights.

    A length's weight falls as it gets covered. A round prices all rooms by one knapsack table under the weights of
    the moment. It then takes, from the least covered length on, the dearest configuration with it that holds no
    length the round has covered before, if that is priced within ``gap`` of the best of all. Such a configuration
    covers its tightest length by ``rate`` of its count. Rounds end when the cover is within ``gap`` of the
    volume bound, or after ``rounds``. The shares are scaled to cover every length, at most twofold.
    """
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[n] for n in lengths.tolist()], float)
    size = lengths.tolist()
    tokens = float(lengths @ need)
    # Worths start in proportion to the length, so that full sequences win from the first round on.
    prior, log_weight, covered = np.log(lengths / capacity), np.zeros(len(lengths)), np.zeros(len(lengths))
    share: dict[Config, float] = {}
    least = 0.0
    for _ in range(rounds):
        worth = np.exp(prior + log_weight - log_weight.max())
        best, fits = worths(lengths, worth, capacity, float(worth @ need) / tokens)
        enough = best[capacity] - gap * abs(best[capacity])
        free, done = worth.copy(), np.zeros(len(lengths))
        for first in np.lexsort((-lengths, covered / need)).tolist():
            if done[first]:
                continue
            config, room, got = {first: 1}, capacity - size[first], worth[first]
            while fits[room]:
                values = free[: fits[room]] + best[room - lengths[: fits[room]]]
                i = int(values.argmax())
                if got + values[i] < enough:
                    break
                config[i] = config.get(i, 0) + 1
                got += worth[i]
                room -= size[i]
            if got < enough:
                continue
            use = min(rate * need[i] / k for i, k in config.items())
            key = tuple(sorted(((size[i], k) for i, k in config.items()), reverse=True))
            share[key] = share.get(key, 0.0) + use
            for i, k in config.items():
                done[i] = use * k / need[i]
                covered[i] += use * k
                free[i] = -np.inf
        log_weight -= done
        least = float((covered / need).min())
        if least and sum(share.values()) / least <= (1 + gap) * tokens / capacity:
            break
    scale = min(1 / least, 2.0) if least else 1.0
    return {c: x * scale for c, x in share.items()}


def best_fit(rest: Counter, capacity: int) -> Counter:
    """Longest first, each piece into the fullest open sequence that takes it; equal contents are counted together."""
    open_by_room: dict[int, Counter] = {}
    rooms = np.zeros(capacity + 1, np.int64)  # sequences with that much room left
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            fitting = np.flatnonzero(rooms[length:])
            if not len(fitting):
                many = min(left, max(1, left // max(1, capacity // length)))
                content: tuple[int, ...] = ()
                room = capacity
                open_by_room.setdefault(room, Counter())[content] += many
                rooms[room] += many
                continue
            room = int(fitting[0]) + length
            content, many = next(iter(open_by_room[room].items()))
            used = min(many, left)
            open_by_room[room][content] -= used
            if not open_by_room[room][content]:
                del open_by_room[room][content]
            rooms[room] -= used
            open_by_room.setdefault(room - length, Counter())[(*content, length)] += used
            rooms[room - length] += used
            left -= used
    out: Counter = Counter()
    for group in open_by_room.values():
        for content, many in group.items():
            if content and many:
                out[tuple(sorted(Counter(content).items(), reverse=True))] += many
    return out


SLACK = 2000  # a plan may use one sequence in this many more than the fewest found


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 20, least: float = 0.2) -> Counter:
    """Configurations and how many sequences use each; together they hold exactly the histogram."""
    program, rest = plan_parts(histogram, capacity, rounds, least)
    return program + rest


def plan_parts(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 20, least: float = 0.2) -> tuple[Counter, Counter]:
    """The plan's sequences from the program (and whole ones), and those from best fit.

    Each solve's shares are rounded, the largest first and one at least, as far as the pieces last. Only
    its configurations with the least room left are fixed, and the rest is solved again; a looser one could
    still be filled better. Once a solve places less than ``least`` of its pieces, the rest goes by best fit.
    Of the solves the most are kept that lead to no more sequences than the fewest after any of them, but for
    one in ``SLACK``.
    """
    rest = Counter({n: c for n, c in histogram.items() if c})
    fixed: Counter = Counter()
    full = rest.pop(capacity, 0)
    if full:
        fixed[((capacity, 1),)] = full
    after = [(Counter(fixed), best_fit(rest, capacity))]
    while rest:
        before, placed = sum(rest.values()), 0
        shares = solve(rest, capacity, rounds)
        most = max((sum(n * k for n, k in c) for c in shares), default=0)
        for config, share in sorted(shares.items(), key=lambda x: (-x[1], x[0])):
            times = min([max(1, int(share)), *(rest[n] // k for n, k in config)])
            if times and sum(n * k for n, k in config) == most:
                fixed[config] += times
                placed += times * sum(k for _, k in config)
                for n, k in config:
                    rest[n] -= k * times
                    if not rest[n]:
                        del rest[n]
        after.append((Counter(fixed), best_fit(rest, capacity)))
        if placed < least * before:
            break
    used = [sum(a.values()) + sum(b.values()) for a, b in after]
    return after[max(i for i, n in enumerate(used) if n <= min(used) + min(used) // SLACK)]


class Places:
    """Where the i-th piece of a length goes; as many entries as configurations have lengths."""

    def __init__(self, configs: Counter):
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        filled: Counter = Counter()
        base = 0
        for config, times in sorted(configs.items()):
            offset = 0
            for n, k in config:
                slots.setdefault(n, []).append((filled[n], base, k, offset))
                filled[n] += k * times
                offset += n * k
            base += times
        self.slots = {n: np.array(s, np.int64) for n, s in slots.items()}
        self.sequences = base

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            table = self.slots[n]
            at = np.searchsorted(table[:, 0], ranks[own], "right") - 1
            k = ranks[own] - table[at, 0]
            sequence[own] = table[at, 1] + k // table[at, 2]
            offset[own] = table[at, 3] + (k % table[at, 2]) * n
        return sequence, offset


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``; see :func:`pieces` for the rest.

    Null and empty texts are one piece with the end id alone. Repeated rows are packed once each. No
    documents give no rows.
    """
    cut = pieces(docs, tokenizer, capacity, id_column, text_column)
    cut = stage(cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int")), "pieces")
    counts = stage(cut.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan(histogram, capacity))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    ranked = cut.withColumn("rank", F.row_number().over(order) - 1).join(first, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))
    schema = ", ".join(f"{n} {t}" for n, t in cut.drop("salt").dtypes) + ", sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, found)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)
