"""Toxicity by class-conditional Kneser-Ney models.

One model of character n-grams inside words is fitted to toxic texts and one to ordinary texts. The
short n-grams have backoff counts that both classes share, so a rare expression that neither class has
seen costs the same under both, and one that shares a stem with known abuse does not. A text is judged
by its log-likelihood ratios: per word over the whole text, of the expressions that speak most for the
toxic model, and as the share of the text whose ratio is clearly toxic, so that one chance word in a
long text weighs less than a few in a short one. A logistic curve fitted to labelled rows that the
models have not seen turns these length-normalised figures into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import crc_fold, id_text, stage, texts_in

WORD = re.compile(r"[^\W\d_]+")
ORDER = 4
SHARED = 2  # n-grams up to this length have one count for both classes
DISCOUNT = 0.75
CLEAR = (3.0, 5.0)  # ratios in nats from which a word counts as evidence, and as strong evidence
TOP = 5
FOLDS = 5
CALIBRATION_FOLD = 4
#: Bounds of the labelled sample that the models are fitted to: rows of each class, and rows of the curve.
FIT_ROWS = 1500
CALIBRATION_ROWS = 3000

FEATURES = ("mean_ratio", "top_1", "top_2", "top_3", "top_mean", "log_excess", "log_total", "log_words", "log_clear", "log_strong")
#: Weights of the features and the intercept where too few labels are left to fit the curve.
DEFAULT_CURVE = np.array([0.0, 0.5, *[0.0] * 8, -7.0])

_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _hashes(codes: np.ndarray, most: int) -> list[np.ndarray]:
    """For n = 0..most the hash of the n codes that end at each place; places before the n-th are not used."""
    out = [np.zeros(len(codes), np.uint64)]
    for n in range(1, most + 1):
        h = np.zeros(len(codes), np.uint64)
        h[1:] = out[-1][:-1]
        h = (h ^ (h >> np.uint64(29))) * _STEP + codes + np.uint64(1)
        out.append(h)
    return out


def _spell(vocabulary: Sequence[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words in a row, each behind ``order - 1`` starts (1) and before an end (2); the places
    to predict; and the first of these of every word."""
    pad, end = "\x01" * (order - 1), "\x02"
    codes = np.frombuffer("".join(pad + w + end for w in vocabulary).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)) + 1
    starts = np.cumsum(sizes) - sizes
    places = np.arange(sizes.sum()) + np.repeat((np.arange(len(sizes)) + 1) * (order - 1), sizes)
    return codes, places, starts


class Models:
    """Both models as sorted tables of n-gram hashes, and the log-likelihood ratio of words."""

    def __init__(self, vocabulary: Sequence[str], counts: np.ndarray, order: int = ORDER, shared: int = SHARED, discount: float = DISCOUNT):
        self.order, self.discount = order, discount
        codes, places, starts = _spell(vocabulary, order)
        sizes = np.diff(np.append(starts, len(places)))
        hashes = _hashes(codes, order)
        keys, first = np.unique(hashes[order][places], return_index=True)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inverse = np.searchsorted(keys, hashes[order][places])
        tally = np.stack([np.bincount(inverse, counts[owner, k], len(keys)) for k in (0, 1)], 1)
        at = places[first]
        self.tables = [None] * (order + 1)
        for n in range(order, 0, -1):
            if n <= shared:
                tally = np.repeat(tally.sum(1, keepdims=True), 2, 1)
            contexts, belongs = np.unique(hashes[n - 1][at - 1], return_inverse=True)
            totals = np.stack([np.bincount(belongs, tally[:, k], len(contexts)) for k in (0, 1)], 1)
            kinds = np.stack([np.bincount(belongs, tally[:, k] > 0, len(contexts)) for k in (0, 1)], 1)
            self.tables[n] = (keys, tally, contexts, totals, kinds)
            if n > 1:
                # The next counts are continuations: how many n-grams of the class end in the shorter one.
                own = hashes[n - 1][at]
                keys, first, belongs = np.unique(own, return_index=True, return_inverse=True)
                tally = np.stack([np.bincount(belongs, tally[:, k] > 0, len(keys)) for k in (0, 1)], 1).astype(float)
                at = at[first]
        self.letters = len(self.tables[1][0]) + 1

    def ratios(self, vocabulary: Sequence[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        if not len(vocabulary):
            return np.empty(0)
        codes, places, starts = _spell(vocabulary, self.order)
        hashes = _hashes(codes, self.order)
        p = np.full((len(places), 2), 1.0 / self.letters)
        alive = np.arange(len(places))
        for n in range(1, self.order + 1):
            keys, tally, contexts, totals, kinds = self.tables[n]
            wanted = hashes[n - 1][places[alive] - 1]
            c = np.minimum(np.searchsorted(contexts, wanted), len(contexts) - 1)
            there = contexts[c] == wanted
            alive, c = alive[there], c[there]  # an unseen context stays unseen when it gets longer
            wanted = hashes[n][places[alive]]
            g = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            count = np.where((keys[g] == wanted)[:, None], tally[g], 0.0)
            total = totals[c]
            seen = total > 0
            fresh = (np.maximum(count - self.discount, 0) + self.discount * kinds[c] * p[alive]) / np.where(seen, total, 1)
            p[alive] = np.where(seen, fresh, p[alive])
        logs = np.log(p)
        return np.add.reduceat(logs[:, 1] - logs[:, 0], starts)


class Reader:
    """The features of texts; the ratios of a bounded number of words are kept."""

    def __init__(self, models: Models, most: int = 400_000):
        self.models, self.most = models, most
        self.known: dict[str, float] = {}

    def __call__(self, texts: Iterator[str]) -> Iterator[list[float]]:
        left, more = iter(texts), True
        while more:
            size, group, more = 0, [], False
            for text in left:
                group.append(words(text))
                size += len(text)
                if size > 1_000_000:
                    more = True
                    break
            new = list(set().union(*group).difference(self.known))
            self.known.update(zip(new, self.models.ratios(new).tolist()))
            for found in group:
                yield features(np.fromiter(map(self.known.__getitem__, found), float, len(found)))
            for word in new[max(0, self.most - len(self.known) + len(new)) :]:
                del self.known[word]


def features(ratios: np.ndarray) -> list[float]:
    """``FEATURES`` of a text from the ratios of its words; a text without words has no evidence at all."""
    n = len(ratios)
    top = np.zeros(TOP)
    if n:
        most = min(n, TOP)
        top[:most] = -np.sort(np.partition(-ratios, most - 1)[:most])
    excess = np.maximum(ratios - CLEAR[0], 0).sum()
    share = lambda least: np.count_nonzero(ratios > least) / max(n, 1)
    return [
        float(ratios.mean()) if n else 0.0, *top[:3].tolist(), float(top.mean()),
        float(np.log(excess / max(n, 1) + 0.01)), float(np.log1p(excess)), float(np.log(max(n, 1))),
        float(np.log(share(CLEAR[0]) + 0.003)), float(np.log(share(CLEAR[1]) + 0.003)),
    ]


def fit_curve(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's steps, on standardised features; the weights
    returned apply to the raw features, the intercept last."""
    mean, spread = rows.mean(0), rows.std(0) + 1e-9
    x = np.column_stack([(rows - mean) / spread, np.ones(len(rows))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * rows.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[:-1] / spread
    return np.append(slope, w[-1] - slope @ mean)


def _sample(labels: DataFrame, fit_rows: int, curve_rows: int) -> DataFrame:
    """``doc_id, toxic, part``: at most ``fit_rows`` rows of each class and ``curve_rows`` for the curve.

    Rows are taken in the order of a hash of the id. ``part`` is the class, plus 2 in the fold of the
    curve, for rows to fit; 4 for rows of the curve.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("fold", crc_fold("doc_id", FOLDS)).where("fold <> 0").withColumn("order", F.xxhash64("doc_id"))
    aside = F.col("fold") == CALIBRATION_FOLD
    part = F.col("toxic") + F.when(aside, 2).otherwise(0)
    fitted = [known.where(F.col("toxic") == k).orderBy("order", "doc_id").limit(fit_rows).withColumn("part", part) for k in (0, 1)]
    curve = known.where(aside).orderBy("order", "doc_id").limit(curve_rows).withColumn("part", F.lit(4))
    return fitted[0].unionByName(fitted[1]).unionByName(curve).select("doc_id", "toxic", "part")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = tuple(Counter() for _ in range(4))
    for batch in batches:
        for part, text in zip(batch.column("part").to_pylist(), texts_in(batch)):
            counts[part].update(words(text))
    for part, own in enumerate(counts):
        items = list(own.items())
        for at in range(0, len(items), 10_000):
            some = items[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some]), pa.array([part] * len(some), pa.int32()), pa.array([n for _, n in some], pa.int64())], ["word", "part", "n"])


def _read(rows: DataFrame, models: Models, keep: str, weights: np.ndarray | None = None) -> DataFrame:
    """``keep`` and, without weights, the ``features`` of each row, or else its ``score``."""
    shared = rows.sparkSession.sparkContext.broadcast((models, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, curve = shared.value
        reader = Reader(known)
        for batch in batches:
            found = np.array(list(reader(texts_in(batch))), float).reshape(-1, len(FEATURES))
            if curve is None:
                out = pa.array(found.tolist(), pa.list_(pa.float64()))
            else:
                out = pa.array(1 / (1 + np.exp(-np.clip(found @ curve[:-1] + curve[-1], -700, 700))))
            yield pa.RecordBatch.from_arrays([batch.column(keep), out], [keep, "found"])

    return rows.select(keep, "text").mapInArrow(run, f"{keep} {dict(rows.dtypes)[keep]}, found {'double' if weights is not None else 'array<double>'}")


def fit(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, curve_rows: int = CALIBRATION_ROWS, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[Models, np.ndarray] | float:
    """The models and the weights of the curve, or a constant score if a class has no words to learn from.

    The models fit on the driver: they hold the n-grams of at most ``2 * fit_rows`` texts.
    """
    source = id_text(docs, id_column, text_column)
    picked = stage(_sample(labels, fit_rows, curve_rows), "sample")
    rows = source.join(F.broadcast(picked), "doc_id")
    learned = rows.where("part < 4").select("text", "part").mapInArrow(_count_words, "word string, part int, n bigint")
    learned = learned.groupBy("word").agg(*[F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)])
    table = learned.orderBy("word").toPandas()
    vocabulary, counts = table["word"].tolist(), table[["n0", "n1", "n2", "n3"]].to_numpy(float)
    if not (counts[:, [0, 2]].sum() and counts[:, [1, 3]].sum()):
        share = picked.agg(((F.coalesce(F.sum("toxic"), F.lit(0)) + 0.5) / (F.count(F.lit(1)) + 2)).cast("double").alias("s"))
        return float(share.first()["s"])
    weights = DEFAULT_CURVE
    if (counts[:, :2].sum(0) > 0).all():
        # The curve comes from models that have not seen its rows.
        curve = _read(rows.where("part = 4"), Models(vocabulary, counts[:, :2]), "toxic").toPandas()
        if curve["toxic"].nunique() == 2:
            weights = fit_curve(np.array(curve["found"].tolist()), curve["toxic"].to_numpy(float))
    return Models(vocabulary, counts[:, :2] + counts[:, 2:]), weights


def score(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, curve_rows: int = CALIBRATION_ROWS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    ``labels`` (``doc_id``, ``toxic``) teach only through rows whose id has a crc32 not divisible by 5;
    a repeated id takes its highest label. A null or empty text has no evidence for either model.
    Without labels of both classes every score is the share of toxic labels, drawn towards a quarter by
    two rows.
    """
    fitted = fit(docs, labels, fit_rows, curve_rows, id_column, text_column)
    source = id_text(docs, id_column, text_column)
    found = source.select("doc_id", F.lit(fitted).alias("found")) if isinstance(fitted, float) else _read(source, fitted[0], "doc_id", fitted[1])
    held = (crc_fold("doc_id", FOLDS) == 0).alias("held_out")
    return found.select("doc_id", held, F.col("found").alias("score"), (F.col("found") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or more; all columns stay and no row is shuffled."""
    fitted = fit(docs, labels, id_column=id_column, text_column=text_column)
    if isinstance(fitted, float):
        return docs if fitted < 0.5 else docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, curve = shared.value
        reader = Reader(known)
        for batch in batches:
            found = np.array(list(reader(texts_in(batch, text_column))), float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(found @ curve[:-1] + curve[-1] < 0))

    return docs.mapInArrow(run, docs.schema)
