"""Personal data, by patterns and by information-theoretic sanitisation.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers. For each of these protected
entities the words of the documents that hold it are counted over the distinct texts of the corpus. A word
reveals an entity if most texts that hold the word hold that entity too, if that is far more often than
chance (pointwise mutual information), and if it happens in several classes of near-duplicates, so that
copies of one document do not count as evidence. Such words become spans wherever they stand; the
strongest are removed, the others generalised.

An entity in fewer than ``CLASSES`` classes gives no evidence: every rare word of its documents would
reveal it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import Marks, components, free, id_text, lookup, slices, stage
from barline.llm.simhash_dedup import fingerprint, links

# The kinds in their order, and their patterns and limits as stated. The patterns are
# written so that a long run of their characters is read once; matches are those of the plain ones.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = "term"

WORD = re.compile(r"[^\W\d_]{2,}")
CLASSES = 3
APART = 2  # bits by which the fingerprints of near-duplicates differ at most
DISCLOSURE = 0.5
REMOVAL = 0.9
BITS = 3.0
BLOCK_WORDS = 100_000  # revealing words that one pass over the documents looks for
MOST_WORDS = 300_000  # words a task counts before it hands them on

Span = tuple[int, int, str]  # start, end, kind


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if n % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds by start, then kind; code points, end exclusive."""
    out: list[Span] = [(*s, "email") for s in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def entity(text: str, span: Span) -> int:
    """What identifies an entity however it is written, as a signed 64-bit hash."""
    raw = text[span[0] : span[1]]
    value = raw.lower() if span[2] in ("email", "ip") else _digits(raw)
    digest = xxhash.xxh64_intdigest(f"{span[2]}:{value}".encode("utf-8", "surrogatepass"))
    return digest - (1 << 64) * (digest >> 63)


def beside(text: str, spans: list[Span]) -> set[str]:
    """The lower-cased words of a text outside its base spans."""
    out, at = set(), 0
    for start, end, _ in spans:
        out.update(WORD.findall(text[at : max(at, start)].lower()))
        at = max(at, end)
    out.update(WORD.findall(text[at:].lower()))
    return out


_ROWS = "doc_id {id}, digest bigint, base array<struct<start:bigint,end:bigint,kind:string>>, entities array<bigint>, words array<string>, fp bigint"


def _signed(text: str) -> int:
    digest = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return digest - (1 << 64) * (digest >> 63)


def _spark_hash(word: str) -> int:
    """``xxhash64`` of Spark, as an unsigned number."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=42)


def _survey(kind: pa.DataType):
    """One pass over the texts: a row per document with its base spans and, if it has any, its entities, the
    words beside them and the fingerprint."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    types = [pa.int64(), span, pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64()]
    names = ["doc_id", "digest", "base", "entities", "words", "fp"]

    def row(text: str) -> tuple:
        spans = base_spans(text)
        base = [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        if not spans:
            return _signed(text), base, None, None, None
        fp = fingerprint(text)
        return _signed(text), base, sorted({entity(text, s) for s in spans}), sorted(beside(text, spans)), fp - (1 << 64) * (fp >> 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = list(zip(*map(row, batch.column("text").to_pylist())))
                if found:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(found, types))], names)

    return run


def _counted(wanted: Marks, repeated: Marks | None = None):
    """``word, n``: in how many of the texts a wanted word stands, in parts to add up; texts marked as repeated are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(w, n) for w, n in words.items() if _spark_hash(w) in wanted]
            words.clear()
            for at in range(0, len(rows), 20_000):
                some, n = zip(*rows[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        words: Counter = Counter()
        for whole in batches:
            for batch in slices(whole):
                for text in batch.column("text").to_pylist():
                    if repeated is None or _signed(text) not in repeated:
                        words.update(set(WORD.findall(text.lower())))
                if len(words) > MOST_WORDS:
                    yield from flush()
        yield from flush()

    return run


def _repeated(marks: Marks):
    """``digest, text`` of the texts marked as repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                digests = [_signed(t) for t in batch.column("text").to_pylist()]
                rows = pa.array([n for n, d in enumerate(digests) if d in marks], pa.int64())
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()).take(rows), batch.column("text").take(rows)], ["digest", "text"])

    return run


def document_counts(source: DataFrame, words: DataFrame, repeats: DataFrame) -> DataFrame:
    """``word, df``: the number of distinct texts of ``source`` that hold each of ``words``.

    ``repeats`` has the digests of texts that stand more than once. Only those texts, and the few whose
    digest falls on a mark of theirs, are shuffled to be counted once; all others are counted where they are.
    """
    wanted = Marks(words.select(F.xxhash64("word").alias("key")), "key")
    marks = Marks(repeats, "digest") if repeats.take(1) else None
    counts = source.select("text").mapInArrow(_counted(wanted, marks), "word string, n bigint")
    if marks:
        once = source.select("text").mapInArrow(_repeated(marks), "digest bigint, text string").dropDuplicates(["digest"])
        counts = counts.unionByName(once.select("text").mapInArrow(_counted(wanted), "word string, n bigint"))
    return counts.groupBy("word").agg(F.sum("n").alias("df")).join(words, "word", "left_semi")


class Survey:
    """The base spans of every document and the words that reveal an entity.

    All counts are of distinct texts. Words are counted only if an entity stands in ``classes`` classes.
    """

    def __init__(
        self, docs: DataFrame, disclosure: float = DISCLOSURE, bits: float = BITS, classes: int = CLASSES,
        id_column: str = "doc_id", text_column: str = "text",
    ):
        self.source = id_text(docs, id_column, text_column)
        self.kind = dict(self.source.dtypes)["doc_id"]
        arrow = pa.int64() if self.kind == "bigint" else pa.int32() if self.kind == "int" else pa.string()
        rows = stage(self.source.mapInArrow(_survey(arrow), _ROWS.format(id=self.kind)), "survey")
        self.documents = rows.select("doc_id", "digest", "base")
        holding = rows.where("entities is not null").select("digest", "entities", "fp").dropDuplicates(["digest"])
        held = stage(holding.select("digest", "fp", F.explode("entities").alias("entity")), "held")
        often = held.groupBy("entity").agg(F.count(F.lit(1)).alias("ef")).where(F.col("ef") >= classes)
        self.words, self.blocks = self.source.sparkSession.createDataFrame([], "word string, strength double"), 0
        if not often.take(1):
            return
        often = stage(often, "often")
        nodes = stage(lookup(held, often.select("entity"), "entity").select("fp").distinct(), "nodes")
        named = stage(components(nodes.select(F.col("fp").alias("node")), links(nodes, APART)).withColumnRenamed("node", "fp"), "classes")
        told = stage(lookup(lookup(held, often, "entity"), named, "fp").select("digest", "entity", "ef", "label"), "told")
        several = told.groupBy("entity").agg(F.count_distinct("label").alias("classes")).where(F.col("classes") >= classes)
        if not several.take(1):
            return
        told = lookup(told, stage(several.select("entity"), "several"), "entity")
        of_text = told.groupBy("digest").agg(F.collect_list(F.struct("entity", "ef", "label")).alias("entities"))
        texts = rows.where("entities is not null").select("digest", "words").dropDuplicates(["digest"])
        pairs = texts.join(of_text, "digest").select("words", F.explode("entities").alias("e")).select("e.*", F.explode("words").alias("word"))
        # By class first: one word and entity may be in very many texts.
        met = pairs.groupBy("entity", "ef", "word", "label").agg(F.count(F.lit(1)).alias("n"))
        met = met.groupBy("entity", "ef", "word").agg(F.sum("n").alias("joint"), F.count(F.lit(1)).alias("classes")).where(F.col("classes") >= classes)
        met = stage(met, "met")
        if not met.take(1):
            return
        repeats = stage(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeats")
        total = rows.count() - (repeats.agg(F.sum(F.col("n") - 1)).first()[0] or 0)
        with_word = document_counts(self.source, stage(met.select("word").distinct(), "candidates"), repeats.select("digest"))
        strength = F.col("joint") / F.col("df")
        pmi = F.log2(F.col("joint") * F.lit(float(total)) / (F.col("df") * F.col("ef")))
        telling = met.join(with_word, "word").where((strength >= disclosure) & (pmi >= bits))
        #: ``word, strength``: the words whose disclosure of some entity exceeds the thresholds.
        self.words = stage(telling.groupBy("word").agg(F.max(strength).alias("strength")), "words")
        self.blocks = -(-self.words.count() // BLOCK_WORDS)

    def added(self) -> DataFrame:
        """``doc_id, digest, terms``: the places of revealing words, for documents that have any.

        The words are looked for in blocks of a bounded number, each in a pass over the documents.
        Documents of one id and text have one row.
        """
        schema = f"doc_id {self.kind}, digest bigint, terms array<struct<start:bigint,end:bigint,strength:double>>"
        out = self.source.sparkSession.createDataFrame([], schema)
        for block in range(self.blocks):
            own = self.words.where(F.pmod(F.xxhash64("word"), F.lit(self.blocks)) == block)
            out = out.unionByName(self.source.mapInArrow(_finder({r["word"]: r["strength"] for r in own.collect()}), schema))
        return out.groupBy("doc_id", "digest").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))

    def spans(self) -> DataFrame:
        """``doc_id, base, terms`` for every row of the documents."""
        none = F.array().cast("array<struct<start:bigint,end:bigint,strength:double>>")
        if not self.blocks:
            return self.documents.select("doc_id", "base", none.alias("terms"))
        added = self.added().select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "terms")
        joined = self.documents.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
        return joined.select("doc_id", "base", F.coalesce("terms", none).alias("terms"))


def _finder(words: dict[str, float]):
    terms = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("strength", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows, digests, out = [], [], []
                for n, text in enumerate(batch.column("text").to_pylist()):
                    if words.keys().isdisjoint(WORD.findall(text.lower())):
                        continue
                    # Lower-casing can change lengths, so places are looked for in the text as it is.
                    hits = [{"start": m.start(), "end": m.end(), "strength": words[w]} for m in WORD.finditer(text) if (w := m[0].lower()) in words]
                    if hits:
                        rows.append(n)
                        digests.append(_signed(text))
                        out.append(hits)
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(digests, pa.int64()), pa.array(out, terms)], ["doc_id", "digest", "terms"])

    return find


def mask(text: str, base: list[Span], terms: list[tuple[int, int, float]], removal: float = REMOVAL) -> str:
    """``text`` with each base span replaced by its kind in brackets; revealing words of a strength of
    ``removal`` and more go, weaker ones become ``[TERM]``. Spans that overlap are masked as one."""
    marks = [(a, b, f"[{k.upper()}]") for a, b, k in base]
    marks += [(a, b, "" if s >= removal else f"[{TERM.upper()}]") for a, b, s in terms]
    out, at, end = [], 0, 0
    for a, b, label in sorted(marks, key=lambda m: (m[0], -m[1])):
        if a >= end:
            out += [text[at:a], label]
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with personal data masked in the text; all other columns stay.

    Null texts stay null, and empty and very long ones are masked as any other. Repeated rows stay, each masked; spans that
    overlap are masked as one. Other columns stay, whatever their names; an empty table gives one. Without
    revealing words no document is shuffled.
    """
    survey = Survey(docs, id_column=id_column, text_column=text_column)
    columns = docs.columns
    own, id_, text_digest, terms = (free(columns, c) for c in ("_own", "_id", "_digest", "_terms"))
    if survey.blocks:
        added = survey.added().select(F.col("doc_id").alias(id_), F.col("digest").alias(text_digest), F.col("terms").alias(terms))
        digest = F.pandas_udf(lambda s: s.fillna("").map(_signed), "bigint")
        marked = docs.withColumn(own, digest(F.col(text_column)))
        rows = marked.join(added.hint("shuffle_hash"), F.col(id_column).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(text_digest)), "left").select(*columns, terms)
    else:
        rows = docs.withColumn(terms, F.lit(None).cast("array<struct<start:bigint,end:bigint,strength:double>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                out = []
                for text, found in zip(batch.column(text_column).to_pylist(), batch.column(terms).to_pylist()):
                    own = [(t["start"], t["end"], t["strength"]) for t in found or []]
                    out.append(None if text is None else mask(text, base_spans(text), own))
                at = batch.schema.get_field_index(text_column)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == at else batch.column(n) for n in range(len(columns))], columns)

    return rows.mapInArrow(run, docs.schema)


def span_list(base: Column | str, terms: Column | str | None = None) -> Column:
    """Spans as ``kind:start:end``, by start and then kind, comma-joined."""
    order = F.create_map(*[x for n, k in enumerate((*KINDS, TERM)) for x in (F.lit(k), F.lit(n))])
    spans = F.transform(base, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("n"), s["end"].alias("end"), s["kind"].alias("kind")))
    if terms is not None:
        more = F.transform(terms, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("n"), s["end"].alias("end"), F.lit(TERM).alias("kind")))
        spans = F.concat(spans, more)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
