"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. A blob is scanned once for each
rule version the ledger has not seen for it, whatever number of paths or versions hold it, and the
findings are joined back to all of them. All work is regular expressions and joins of Spark itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import id_text, lookup, stage


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what it looks like, which group's length counts, and a text it cannot lack."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1
    hint: str | None = None


# Kinds, patterns and lengths are as stated. Where a minimum length is written into the
# pattern, the plain run and a filter behind it give the same matches.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", least=18, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", least=16),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
)
RULES = BASE + ADDED

LEDGER = "blob string, kind string, version int, spans array<struct<start:bigint,end:bigint>>"
SPANS = "array<struct<start:bigint,end:bigint>>"


def _found(rule: Rule) -> Column:
    """All matches of the rule in ``text``, leftmost first and non-overlapping, or none if not asked."""
    asked = F.array_contains("kinds", rule.kind)
    if rule.hint:
        asked = asked & F.contains("text", F.lit(rule.hint))
    return F.when(asked, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _spans(rule: Rule, matches: str) -> Column:
    """Code points of the matches that pass: the texts between matches give the places.

    A match starts where the gaps and matches before it end, so the lengths add up from left to right.
    """
    gaps = F.split("text", rule.pattern, -1)
    value = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else F.col(matches)
    each = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), F.col(matches).alias("match"), value.alias("value"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("spans"))

    def add(state: Column, one: Column) -> Column:
        begin = state["at"] + F.char_length(one["gap"])
        end = begin + F.char_length(one["match"])
        kept = F.when(F.char_length(one["value"]) >= rule.least, F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast(SPANS))
        return F.struct(end.alias("at"), F.concat(state["spans"], kept).alias("spans"))

    return F.when(F.size(matches) > 0, F.aggregate(each, start, add)["spans"]).otherwise(F.array().cast(SPANS))


def scan(
    versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """``(paths, ledger)``: the blob of every version, and the ledger with all pairs now scanned.

    ``ledger`` has one row per blob and rule version (``blob, kind, version, spans``); only the pairs it
    lacks are scanned. ``paths`` has ``doc_id, blob``, one row per row of ``versions``, repeated rows and
    null ids included. A null text is the empty text, which holds no finding; no versions leave the
    ledger as it is.
    """
    source = id_text(versions, id_column, text_column).withColumn("blob", F.sha2("text", 256))
    paths = stage(source.select("doc_id", "blob"), "paths")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("path")
    blobs = paths.groupBy("blob").agg(F.min(key).alias("path"))
    spark = versions.sparkSession
    known = spark.createDataFrame([], LEDGER) if ledger is None else ledger.select("blob", "kind", "version", "spans")
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        unseen = blobs.withColumn("kinds", F.array(*[F.lit(r.kind) for r in rules]))
    else:
        pairs = blobs.select("blob", "path", F.explode(wanted).alias("r")).select("blob", "path", "r.kind", "r.version")
        unseen = pairs.join(known, ["blob", "kind", "version"], "left_anti").groupBy("blob", "path").agg(F.collect_set("kind").alias("kinds"))
    texts = source.select("blob", "text", key).join(unseen.hint("shuffle_hash"), ["blob", "path"]).select("blob", "text", "kinds")
    matched = texts.select("*", *[_found(r).alias(f"m_{r.kind}") for r in rules])
    placed = matched.select("blob", "kinds", *[_spans(r, f"m_{r.kind}").alias(f"s_{r.kind}") for r in rules])
    placed = stage(placed, "scanned")
    each = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(f"s_{r.kind}").alias("spans")) for r in rules])
    new = placed.select("blob", "kinds", F.explode(each).alias("r")).where(F.array_contains("kinds", F.col("r.kind"))).select("blob", "r.kind", "r.version", "r.spans")
    return paths, known.unionByName(new.dropDuplicates(["blob", "kind", "version"]))


def findings(paths: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every path with the spans of its blob: ``doc_id, blob`` and one array column per rule kind.

    Blobs without a finding are not joined at all; their paths get empty arrays.
    """
    wanted = {r.kind: r.version for r in rules}
    current = F.coalesce(*[F.when(F.col("kind") == k, F.col("version") == v) for k, v in wanted.items()], F.lit(False))
    hits = ledger.where(current & (F.size("spans") > 0))
    wide = stage(hits.groupBy("blob").agg(*[F.first(F.when(F.col("kind") == k, F.col("spans")), True).alias(k) for k in wanted]), "hits")
    joined = lookup(paths, wide, "blob", "left")
    return joined.select("doc_id", "blob", *[F.coalesce(F.col(k), F.array().cast(SPANS)).alias(k) for k in wanted])


def spelled(kinds: Sequence[str]) -> Column:
    """``kind:start:end`` of the span columns, by start and then in the order of ``kinds``, comma-joined."""
    tagged = [F.transform(F.col(k), _tag(k, n)) for n, k in enumerate(kinds)]
    ordered = F.array_sort(F.concat(*tagged))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _tag(kind: str, n: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), s["end"].alias("end"), F.lit(kind).alias("kind"))
