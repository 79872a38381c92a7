"""The registered queries of the subpackage, each over its whole table, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import decontaminate, fingerprints, html_text, language_model, mixture, packing, periodic_runs, prefix_trie
from barline.llm import sanitise, secret_scan, simhash_dedup, suffix_dedup, toxicity
from barline.llm.common import lookup, stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file() -> str:
    """The public tokenizer the packing query is stated for; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def hex16(value: Column) -> Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


@query
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; 3-word shingles, at most 2 bits apart."""
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, budget=2)
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it leaks, with the covered share of the item and the tiles."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """128-bit SimHash of every document and of its edited text, and their likeness.

    ``n_near`` counts the documents within 3 bits for the queries, ids divisible by 50.
    """
    found = stage(fingerprints.edited_fingerprints(table(spark, sf_dir, "documents")), "edited")
    near = fingerprints.near_counts(found)
    asked = lookup(found.where("doc_id % 50 = 0"), stage(near, "near"), "fp", "left")
    rest = found.where("doc_id is null or doc_id % 50 <> 0").withColumn("n_near", F.lit(None).cast("bigint"))
    width = 64 * len(fingerprints.SEEDS)
    text = lambda c: F.concat(*[hex16(F.col(c)[i]) for i in range(len(fingerprints.SEEDS))])
    like = lambda c: 1.0 - fingerprints.distance(F.col("fp"), F.col(c)) / F.lit(float(width))
    return asked.unionByName(rest).select(
        "doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"),
        like("edited_fp").alias("near_edited"), like("next_fp").alias("near_next"), "n_near",
    )


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each distinct text scanned once; the ledger starts empty."""
    paths, ledger = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE]
    return secret_scan.findings(paths, ledger).select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(secret_scan.spelled(base), 256).alias("base_sha256"),
        secret_scan.spelled([r.kind for r in secret_scan.RULES]).alias("spans"),
    )


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page and its code points."""
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans, and words that reveal an entity."""
    found = sanitise.Survey(table(spark, sf_dir, "documents")).spans()
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in sanitise.KINDS], F.sha2(sanitise.span_list("base"), 256).alias("base_sha256"), sanitise.span_list("base", "terms").alias("spans")
    )


@query
def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and recurrent model's log10 probability of every document."""
    return language_model.score(table(spark, sf_dir, "documents"))


# Every string of 100 bytes of every document, in hex; all but its first occurrence cover their bytes.
ORACLES["op10_suffix_dedup"] = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT *, length(x) // 2 AS n FROM h),
w AS (SELECT doc_id, s, substr(x, 2 * s + 1, 200) AS k FROM (SELECT *, unnest(range(0, greatest(n - 99, 0))) AS s FROM n)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM w),
g AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM f WHERE nth > 1),
r AS (SELECT doc_id, s, count(*) FILTER (gap IS NULL OR gap > 100) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g),
runs AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM r GROUP BY 1, 2),
parts AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM runs),
kept AS (SELECT p.doc_id, sum(b - a) AS gone, count(*) AS spans,
  string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS head, max(b) AS last FROM parts p JOIN n ON p.doc_id = n.doc_id GROUP BY 1)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN kept ON n.doc_id = kept.doc_id"""


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of 100-byte strings that start earlier too."""
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


# crc32 of a number's decimal text, byte by byte and bit by bit.
CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST({id} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""

# All pairs of equal words of a document; those of one distance beside each other are a run.
ORACLES["op11_periodic_runs"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {CRC32.format(id="doc_id")} AS h FROM documents),
p AS (SELECT *, h // 10 AS g, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
m AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN
  list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM p),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM m),
x AS (SELECT a.doc_id, a.i, b.i - a.i AS q, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS k
  FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.word = b.word AND a.i < b.i),
l AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM x GROUP BY doc_id, q, k HAVING count(*) >= greatest(q, 12 - q)),
r AS (SELECT doc_id, s, n, min(q) AS q FROM l GROUP BY doc_id, s, n),
f AS (SELECT doc_id, count(*) AS n_runs, min({{'n': -n, 's': s, 'q': q}}) AS best, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS spelled FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM r),
c AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN gone ON e.doc_id = gone.doc_id AND e.i = gone.i GROUP BY e.doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(-best.n AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(-1000 * best.n // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(spelled, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN f ON d.doc_id = f.doc_id LEFT JOIN c ON d.doc_id = c.doc_id"""

# A node is the list of its turns; its subtree is found through the smallest member of every node in it.
ORACLES["op12_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT *, conv_id - conv_id % 20 AS base, {CRC32.format(id="conv_id")} % 4 AS h FROM t),
c AS (SELECT h.conv_id, coalesce(list_slice(b.own, 1, h), []) || coalesce(list_slice(h.own, h + 1, len(h.own)), []) AS turns FROM h LEFT JOIN t b ON b.conv_id = h.base),
m AS (SELECT conv_id, d, list_slice(turns, 1, d) AS k, d = len(turns) AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM c)),
n AS (SELECT k, d, min(conv_id) AS c, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
  CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].text, '[^\\x20\\x09-\\x0D]+')) END AS words FROM m GROUP BY k, d),
p AS (SELECT n.*, up.c AS parent, list_slice(n.k, 1, n.d - 1) AS above FROM n LEFT JOIN n up ON n.d > 0 AND up.d = n.d - 1 AND up.k = list_slice(n.k, 1, n.d - 1)),
kids AS (SELECT above, d - 1 AS d, count(*) AS n_children FROM p WHERE d > 0 GROUP BY 1, 2),
q AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN kids ON kids.d = p.d AND kids.above = p.k),
s AS (SELECT m.k, m.d, sum((q.n - 1) * q.words) AS saved, count(*) FILTER (q.n_children = 0) AS leaves FROM q JOIN m ON m.conv_id = q.c AND m.d <= q.d GROUP BY 1, 2)
SELECT q.c AS conv_id, CAST(q.d AS BIGINT) AS depth, parent AS parent_conv_id, CAST(n AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM q JOIN s ON q.d = s.d AND q.k = s.k"""


def _made_periodic(docs: DataFrame) -> DataFrame:
    """The texts the query is stated for: one id in ten, by its crc32, repeats a part of its words to the end."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    g = F.floor(number / 10)
    a = g % F.col("_n")
    p = 1 + F.floor((F.col("_n") - a) / (3 + g % 8))
    again = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1), lambda i: F.get("_words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    made = docs.select("doc_id", "text", F.when(number % 10 == 0, words).alias("_words")).withColumn("_n", F.size("_words").cast("bigint"))
    return made.select("doc_id", F.when(F.col("_n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 12 words and two periods in every document, the longest one, and the text with runs cut to a period."""
    found = periodic_runs.find_runs(_made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = found.withColumn("_best", periodic_runs.longest())
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(periodic_runs.spelled(), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _rebuilt(convs: DataFrame) -> DataFrame:
    """The conversations the query is stated for: up to three first turns come from the one at the next lower multiple of 20."""
    convs = stage(convs, "sequences")
    base = F.col("conv_id") - F.col("conv_id") % 20
    heads = convs.where("conv_id % 20 = 0").select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 3).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    head = F.coalesce("_head", F.slice("turns", 1, 0))
    turns = F.concat(F.slice(head, F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return convs.withColumn("_base", base).join(heads, "_base", "left").select("conv_id", turns.alias("turns"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix tree of the rebuilt conversations."""
    return prefix_trie.build(_rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


@query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document; sources weigh 1, 2, 3, 1, ... by name and repeat a text three times at most."""
    return mixture.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), repeats=3)
