"""Scoring by a gated recurrent language model, trained with numpy inside Spark tasks.

Word counts over all training texts give the vocabulary. The most frequent words are predicted one by
one, with a class-factored softmax: first a class, then a word of the class. All other words fall into
tail classes by their spelling; a tail class is predicted like any class and its words share its mass in
proportion to count plus one, with one share for unseen words. So the model spreads probability one over
all texts, whatever words they hold.

Each partition trains a copy of the network with truncated backpropagation through time and the copies
are averaged, first over an eighth of the texts and then over the rest; every training text is used
once. For scoring the state starts at zero with every document and is carried from window to window to
its end. Words too rare for the bounded table that tasks hold get their counts from a join.
"""

from __future__ import annotations

import io
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import crc_fold, id_text, slices, stage

FOLDS, HELD_OUT = 7, 2
CLASSES, PER_CLASS = 32, 64
TAILS = 64
HEAD = CLASSES * PER_CLASS
TABLE = 262_144  # words whose counts every task holds; the counts of rarer words come from a join
MOST_BYTES = 1 << 22  # of text that a task has as words at a time
MOST_WORDS = 400_000  # words a task counts before it hands them on
WIDTH = 16  # of the embedding and of the state
LANES, STEPS = 512, 16  # texts side by side and steps back in time while training
WARM = 8  # one text in so many goes into the first round
END = b""
PUNCTUATION = b".,;:!?\"')(|"
F32 = np.float32


def bounded(batch: pa.RecordBatch, column: str = "text", most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, with A-Z lower-cased, parted by ASCII white space, and how many each text has.

    The end token is not among them; a null is the empty text.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty string
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return words.filter(full), np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(lists))


def as_bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist


def tail_class(word: bytes) -> int:
    """Class of a rare word: words that end alike, punctuation aside, share it."""
    return zlib.crc32((word.rstrip(PUNCTUATION) or word)[-2:]) % TAILS


# ---- counts -----------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(counts: Counter) -> Iterator[pa.RecordBatch]:
        items = list(counts.items())
        counts.clear()
        for at in range(0, len(items), 50_000):
            words = [w for w, _ in items[at : at + 50_000]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(map(tail_class, words), pa.int32()), pa.array([n for _, n in items[at : at + 50_000]], pa.int64())],
                ["word", "tail", "n"],
            )

    counts: Counter = Counter()
    for batch in batches:
        for part in bounded(batch):
            found = words_of(part.column("text"))[0].value_counts()
            counts.update(dict(zip(as_bytes(found.field("values")), found.field("counts").to_numpy().tolist())))
            counts[END] += part.num_rows
            if len(counts) > MOST_WORDS:
                yield from flush(counts)
    yield from flush(counts)


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """``word, n`` of the end and of the most frequent words, fewer than ``most``.

    Words are taken by bins of their count, sixteen to a doubling, as long as whole bins fit; no task
    sorts or gathers more than the few hundred bins.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    bins = counts.where(F.octet_length("word") > 0).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, taken = 1 << 30, 1
    for r in sorted(bins, key=lambda r: -r["level"]):
        taken += r["words"]
        if taken > most:
            break
        least = r["level"]
    return counts.where((level >= least) | (F.octet_length("word") == 0)).select("word", "n")


class Vocabulary:
    """The bounded table of frequent words, and the masses of all classes.

    Ids below ``HEAD`` are words (class ``id // PER_CLASS``), ids from there on tail classes.
    """

    def __init__(self, words: Sequence[bytes], counts: Sequence[int], tail_mass: np.ndarray, total: int, distinct: int):
        """``words`` by falling count, the end first; ``tail_mass`` is the sum of count + 1 of all words by tail class."""
        self.total, self.distinct = total, distinct
        self.index = {w: n for n, w in enumerate(words)}
        counts = np.array(counts, np.int64).reshape(-1)
        self.log_count = np.log10(counts + 1.0) if len(counts) else np.zeros(0)
        head = list(words[:HEAD])
        order = sorted(range(len(head)), key=lambda n: (head[n].rstrip(PUNCTUATION) or head[n])[::-1])  # words that end alike share a class
        self.ids = np.array([HEAD + tail_class(w) for w in words], np.int32).reshape(-1)
        mass = np.array(tail_mass, float) + 1  # one share for unseen words
        self.word_bias = np.full((CLASSES, PER_CLASS), -1e9, F32)
        self.class_bias = np.full(CLASSES + TAILS, -1e9, float)
        size = -(-len(head) // CLASSES) if head else 0
        for place, n in enumerate(order):
            k, j = divmod(place, size)
            mass[tail_class(head[n])] -= counts[n] + 1
            self.ids[n] = k * PER_CLASS + j
            self.word_bias[k, j] = np.log(counts[n] + 1)
        sums = np.exp(self.word_bias.astype(float)).sum(1)
        used = sums > 0
        self.class_bias[:CLASSES][used] = np.log(sums[used])
        self.word_bias[used] -= self.class_bias[:CLASSES][used, None].astype(F32)
        self.class_bias[CLASSES:] = np.log(mass)
        self.class_bias = (self.class_bias - np.log(np.exp(self.class_bias).sum())).astype(F32)
        self.log_tail = np.log10(mass)

    def read(self, texts: pa.Array) -> "Read":
        """The texts in ids; a word is looked up once, however often they hold it."""
        words, counts = words_of(texts)
        coded = words.dictionary_encode()
        distinct = [*as_bytes(coded.dictionary), END]
        rows = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int32, len(distinct))
        ids = self.ids[rows] if len(self.ids) else np.zeros(len(rows), np.int32)
        missing = np.flatnonzero(rows < 0)
        ids[missing] = [HEAD + tail_class(distinct[n]) for n in missing.tolist()]
        sizes = counts + 1
        codes = np.full(int(sizes.sum()), len(distinct) - 1, np.int64)
        inside = np.ones(len(codes), bool)
        inside[np.cumsum(sizes) - 1] = False
        codes[inside] = coded.indices.to_numpy()
        return Read(distinct, rows, ids, codes, sizes)


@dataclass
class Read:
    """Texts as codes of their distinct words, each text closed by the end."""

    distinct: list[bytes]
    rows: np.ndarray  # of the distinct words in the vocabulary's table, -1 for none
    ids: np.ndarray  # of the distinct words
    codes: np.ndarray  # of the words of all texts, one text behind the other
    sizes: np.ndarray  # tokens of each text

    def texts(self) -> list[np.ndarray]:
        """The ids of each text."""
        return np.split(self.ids[self.codes], np.cumsum(self.sizes)[:-1]) if len(self.sizes) else []

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value of its tokens."""
        return np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes), values[self.codes], len(self.sizes))

    def rare(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words without a row in the table: each once for every text that holds it, how often, and where a text's words begin and end."""
        far = np.flatnonzero(self.rows[self.codes] < 0)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[far]
        pairs, times = np.unique(owner * len(self.distinct) + self.codes[far], return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(len(self.sizes) + 1) * len(self.distinct))
        return [self.distinct[n] for n in (pairs % len(self.distinct)).tolist()], times, cuts


# ---- the network --------------------------------------------------------------------------------------


def initial(vocabulary: Vocabulary, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters under which the model is the unigram model with add-one counts, but for small noise."""
    rng = np.random.default_rng(seed)
    noise = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(F32)
    return {
        "embed": noise(HEAD + TAILS, WIDTH), "wx": noise(WIDTH, 3 * WIDTH) * 3, "wh": noise(WIDTH, 3 * WIDTH) * 3, "b": np.zeros(3 * WIDTH, F32),
        "wc": noise(WIDTH, CLASSES + TAILS), "bc": vocabulary.class_bias.copy(), "wo": noise(CLASSES, PER_CLASS, WIDTH), "bo": vocabulary.word_bias.copy(),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def step(p: dict[str, np.ndarray], projected: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One step of the gated unit for all lanes: new state, and what the way back needs."""
    u = h @ p["wh"]
    zr = _sigmoid(projected[:, : 2 * WIDTH] + u[:, : 2 * WIDTH])
    z, r = zr[:, :WIDTH], zr[:, WIDTH:]
    n = np.tanh(projected[:, 2 * WIDTH :] + r * u[:, 2 * WIDTH :])
    return n + z * (h - n), (z, r, n, u[:, 2 * WIDTH :], h)


def _exponentials(state: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the scores and their sums by row. States lie within 1, so weights and bias bound the scores;
    they are shifted only if they might overflow."""
    x = state @ weights
    x += bias
    if float((np.abs(weights).sum(axis=0) + bias).max()) > 80:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x, x.sum(axis=1)


def _by_class(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the words of each class."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")  # numbers of 16 bits are sorted by digits
    order = order[: np.searchsorted(ids[order], HEAD)]
    classes = ids[order] // PER_CLASS
    cuts = np.flatnonzero(np.diff(classes)) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(ids[part[0]]) // PER_CLASS, part


def log_likelihood(p: dict[str, np.ndarray], h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log probability of each id (a word of the head, or a tail class) after its state."""
    first = np.where(ids < HEAD, ids // PER_CLASS, ids - HEAD + CLASSES)
    rows = np.arange(len(ids))
    e, total = _exponentials(h, p["wc"], p["bc"])
    chance = e[rows, first] / total
    for k, own in _by_class(ids):
        e, total = _exponentials(h[own], p["wo"][k].T, p["bo"][k])
        chance[own] *= e[rows[: len(own)], ids[own] % PER_CLASS] / total
    return np.log(np.maximum(chance, F32(1e-37)))


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h0: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Loss per token, gradients and last state of one window: ids in, ids out and where a text starts,
    each ``steps x lanes``. The way back ends at the window's start."""
    steps, lanes = x.shape
    embedded = p["embed"][x]
    projected = embedded @ p["wx"] + p["b"]
    states, memory, h = np.empty((steps, lanes, WIDTH), F32), [], h0
    for t in range(steps):
        h = np.where(fresh[t][:, None], F32(0), h)
        h, kept = step(p, projected[t], h)
        states[t] = h
        memory.append(kept)
    flat, ids = states.reshape(-1, WIDTH), y.reshape(-1)
    n = len(ids)
    g = {name: np.zeros_like(value) for name, value in p.items()}
    first = np.where(ids < HEAD, ids // PER_CLASS, ids - HEAD + CLASSES)
    rows = np.arange(n)
    wrong, total = _exponentials(flat, p["wc"], p["bc"])
    loss = -float(np.log(wrong[rows, first] / total + F32(1e-37)).sum())
    wrong *= (1 / (total * n))[:, None]
    wrong[rows, first] -= F32(1 / n)
    g["wc"], g["bc"] = flat.T @ wrong, wrong.sum(0)
    back = wrong @ p["wc"].T
    for k, own in _by_class(ids):
        at, some, state = ids[own] % PER_CLASS, rows[: len(own)], flat[own]
        miss, total = _exponentials(state, p["wo"][k].T, p["bo"][k])
        loss -= float(np.log(miss[some, at] / total + F32(1e-37)).sum())
        miss *= (1 / (total * n))[:, None]
        miss[some, at] -= F32(1 / n)
        g["wo"][k], g["bo"][k] = miss.T @ state, miss.sum(0)
        back[own] += miss @ p["wo"][k]
    back = back.reshape(steps, lanes, WIDTH)
    d_projected, dh = np.empty_like(projected), np.zeros((lanes, WIDTH), F32)
    d_hidden = np.empty((steps, lanes, 3 * WIDTH), F32)
    before = np.empty((steps, lanes, WIDTH), F32)
    for t in range(steps - 1, -1, -1):
        z, r, m, u, h_in = memory[t]
        dh = dh + back[t]
        dn = dh * (1 - z) * (1 - m * m)
        dz = dh * (h_in - m) * z * (1 - z)
        dr = dn * u * r * (1 - r)
        d_projected[t, :, :WIDTH], d_projected[t, :, WIDTH : 2 * WIDTH], d_projected[t, :, 2 * WIDTH :] = dz, dr, dn
        d_hidden[t, :, : 2 * WIDTH] = d_projected[t, :, : 2 * WIDTH]
        np.multiply(dn, r, out=d_hidden[t, :, 2 * WIDTH :])
        before[t] = h_in
        dh = (dh * z + d_hidden[t] @ p["wh"].T) * ~fresh[t][:, None]
    g["wh"] = before.reshape(-1, WIDTH).T @ d_hidden.reshape(-1, 3 * WIDTH)
    wide = d_projected.reshape(-1, 3 * WIDTH)
    g["wx"], g["b"] = embedded.reshape(-1, WIDTH).T @ wide, wide.sum(0)
    np.add.at(g["embed"], x.reshape(-1), wide @ p["wx"].T)
    return loss / n, g, h


class Trainer:
    """Adam over windows of lanes; texts are laid end to end and cut into lanes."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.rounds, self.seen = p, rate, 0, 0
        self.m = {n: np.zeros_like(v) for n, v in p.items()}
        self.v = {n: np.zeros_like(v) for n, v in p.items()}

    def learn(self, ids: np.ndarray, end: int) -> None:
        """One pass over texts that each close with ``end``; the end of one text is the start of the next."""
        self.seen += len(ids)
        lanes = max(1, min(LANES, len(ids) // (32 * STEPS)))  # at least 32 windows, however few texts there are
        length = len(ids) // lanes
        before = np.concatenate([[end], ids[:-1]]).astype(np.int32)
        cut = lambda a: a[: lanes * length].reshape(lanes, length).T
        x, y = cut(before), cut(ids)
        fresh = x == end
        fresh[0] = True
        h = np.zeros((lanes, WIDTH), F32)
        for at in range(0, length, STEPS):
            _, g, h = gradients(self.p, x[at : at + STEPS], y[at : at + STEPS], fresh[at : at + STEPS], h)
            self.update(g)

    def update(self, g: dict[str, np.ndarray]) -> None:
        self.rounds += 1
        norm = float(np.sqrt(sum(float((v * v).sum()) for v in g.values())))
        scale = F32(min(1.0, 1.0 / (norm + 1e-9)))
        rate = self.rate * np.sqrt(1 - 0.99**self.rounds) / (1 - 0.9**self.rounds)
        for name, value in g.items():
            value *= scale
            m, v = self.m[name], self.v[name]
            m += F32(0.1) * (value - m)
            v += F32(0.01) * (value * value - v)
            self.p[name] -= F32(rate) * m / (np.sqrt(v) + F32(1e-6))


def pack(p: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as found:
        return {n: found[n] for n in found.files}


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token-weighted mean of the parameter sets of a partition."""
    total, weight = None, 0
    for batch in batches:
        for one in slices(batch, 1):
            n, p = one.column("n")[0].as_py(), unpack(one.column("model")[0].as_py())
            weight += n
            total = {k: v.astype(float) * n + (total[k] if total else 0) for k, v in p.items()}
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([pack({k: (v / weight).astype(F32) for k, v in total.items()})], pa.binary())], ["n", "model"])


def train(rows: DataFrame, vocabulary, p: dict[str, np.ndarray], rate: float, fan_in: int = 16) -> dict[str, np.ndarray]:
    """The mean of copies of ``p`` that each partition of ``rows`` (``text``) has trained.

    Copies are averaged ``fan_in`` at a time in tasks until that few are left, so the driver never
    holds more than that. ``vocabulary`` is a broadcast.
    """
    start = rows.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        end = int(words.ids[words.index[END]])
        trainer = Trainer({k: v.copy() for k, v in start.value.items()}, rate)
        held, size = [], 0
        for batch in batches:
            for part in bounded(batch):
                for ids in words.read(part.column("text")).texts():
                    held.append(ids)
                    size += len(ids)
                    if size >= LANES * 512:
                        trainer.learn(np.concatenate(held), end)
                        held, size = [], 0
        if held:
            trainer.learn(np.concatenate(held), end)
        if trainer.seen:
            yield pa.RecordBatch.from_arrays([pa.array([trainer.seen], pa.int64()), pa.array([pack(trainer.p)], pa.binary())], ["n", "model"])

    copies = stage(rows.select("text").mapInArrow(run, "n bigint, model binary"), "copies")
    left = copies.count()
    while left > fan_in:
        left = -(-left // fan_in)
        copies = stage(copies.repartition(left).mapInArrow(_averaged, "n bigint, model binary"), "copies")
    found = copies.collect()
    weight = sum(r["n"] for r in found)
    if not weight:
        return p
    sets = [(r["n"] / weight, unpack(r["model"])) for r in found]
    return {k: sum(w * m[k].astype(float) for w, m in sets).astype(F32) for k in p}


# ---- scores -------------------------------------------------------------------------------------------


def document_scores(p: dict[str, np.ndarray], documents: Sequence[np.ndarray], start: int, window: int = 16_384) -> np.ndarray:
    """Natural log probability of the ids of each document, the state carried to its end.

    Documents run side by side, the longest first, in windows of about ``window`` tokens.
    """
    if not documents:
        return np.zeros(0)
    sizes = np.array([len(d) for d in documents])
    order = np.argsort(-sizes, kind="stable")
    lengths = sizes[order]
    # Ids by step and then by document: those of a step lie together, and documents end from the back.
    alive = len(lengths) - np.cumsum(np.bincount(lengths, minlength=lengths[0] + 1))[: lengths[0]]
    first = np.concatenate([[0], np.cumsum(alive)])
    ids, owner = np.empty(int(first[-1]), np.int32), np.empty(int(first[-1]), np.int32)
    for lane, n in enumerate(order.tolist()):
        at = first[: sizes[n]] + lane
        ids[at] = documents[n]
        owner[at] = lane
    out = np.zeros(len(lengths))
    projected = p["embed"] @ p["wx"] + p["b"]
    h, last = np.zeros((len(lengths), WIDTH), F32), np.full(len(lengths), start, np.int32)
    t = 0
    while t < lengths[0]:
        until = min(lengths[0], max(t + 1, int(np.searchsorted(first, first[t] + window, "right")) - 1))
        states = np.empty((first[until] - first[t], WIDTH), F32)
        for now in range(t, until):
            n = alive[now]
            h = step(p, projected[last[:n]], h[:n])[0]
            states[first[now] - first[t] : first[now + 1] - first[t]] = h
            last = ids[first[now] : first[now + 1]]
        span = slice(first[t], first[until])
        out += np.bincount(owner[span], log_likelihood(p, states, ids[span]), len(out))
        t = until
    result = np.empty(len(documents))
    result[order] = out
    return result


_SCORED = "row bigint, doc_id {id}, held_out boolean, n_tokens bigint, known bigint, logs double, model double, rare array<struct<word:binary,n:int>>"


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Texts whose id has a crc32 of remainder 2 by 7 are held out; all others teach. A null text is the
    empty text, which is the end token alone; repeated rows count and are scored each. Without training
    texts the base score is zero and the score spreads evenly over the tail classes.
    """
    source = id_text(docs, id_column, text_column).withColumn("held_out", crc_fold("doc_id", FOLDS) == HELD_OUT)
    context = docs.sparkSession.sparkContext
    teach = source.where("not held_out")
    counts = stage(teach.select("text").mapInArrow(_count, "word binary, tail int, n bigint").groupBy("word", "tail").agg(F.sum("n").alias("n")), "counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    mass = np.zeros(TAILS)
    for r in counts.groupBy("tail").agg(F.sum(F.col("n") + 1).alias("n")).collect():
        mass[r["tail"]] = r["n"]
    top = frequent(counts, TABLE).toArrow().to_pylist()
    top.sort(key=lambda r: (r["word"] != END, -r["n"], r["word"]))
    vocabulary = Vocabulary([r["word"] for r in top], [r["n"] for r in top], mass, sums["total"], sums["distinct"])
    words = context.broadcast(vocabulary)
    p = initial(vocabulary)
    if sums["total"]:
        warm = F.pmod(F.xxhash64("doc_id", "text"), F.lit(WARM)) == 0
        p = train(teach.where(warm), words, p, rate=0.01)
        p = train(teach.where(~warm), words, p, rate=0.004)
    model = context.broadcast(p)
    kind = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, network, n = words.value, model.value, 0
        start = int(known.ids[known.index[END]]) if END in known.index else HEAD + tail_class(END)
        base = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in bounded(whole):
                read = known.read(batch.column("text"))
                there, far = read.rows >= 0, read.ids >= HEAD
                log_count = np.where(there, known.log_count[read.rows], 0.0) if len(known.log_count) else np.zeros(len(there))
                # A tail word has its share of the class: count + 1 over the mass; rare counts come later.
                tail = np.where(far, log_count - known.log_tail[np.where(far, read.ids - HEAD, 0)], 0.0)
                rare, times, cuts = read.rare()
                found = document_scores(network, read.texts(), start) / np.log(10) + read.sums(tail)
                entries = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int32())], ["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(base + n, base + n + batch.num_rows)), batch.column("doc_id"), batch.column("held_out"), pa.array(read.sizes, pa.int64()),
                        pa.array(read.sums(there.astype(float)).astype(np.int64)), pa.array(read.sums(log_count)), pa.array(found, pa.float64()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), entries),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "model", "rare"],
                )
                n += batch.num_rows

    scored = stage(source.select("doc_id", "held_out", "text").mapInArrow(run, _SCORED.format(id=kind)), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    rare = rare.join(counts.select("word", "n"), "word", "left")
    more = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found"))
    joined = scored.drop("rare").join(more, "row", "left")
    more, found = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
    each = F.log10(F.lit(float(vocabulary.total + vocabulary.distinct + 1)))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + found).cast("bigint").alias("n_known"), F.lit(vocabulary.total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * each).alias("base_score"), (F.col("model") + more).alias("score"),
    )
