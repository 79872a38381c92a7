"""Near and exact duplicates, fingerprints and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barline.llm import common, decontaminate, fingerprints, simhash_dedup, suffix_dedup
from barline.llm.queries import QUERIES


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def classes(nodes, linked):
    label = {n: n for n in nodes}

    def find(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = QUERIES["op7_simhash_dedup"](spark, sf).toPandas().set_index("doc_id")
    fp = {i: slow_fingerprint(t or "") for i, t in zip(docs.doc_id, docs.text)}
    ids = sorted(fp)
    want = classes(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {i: got.fingerprint[i] for i in ids} == {i: format(fp[i], "016x") for i in ids}
    assert {i: got.component_id[i] for i in ids} == want


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_finds_all_links(spark, budget):
    rng = random.Random(budget)
    base = [rng.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1]
    near = {f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for f in base for _ in range(25)}
    fps = sorted(near | set(base))
    frame = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp bigint")
    got = {tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in simhash_dedup.links(frame, budget).collect()}
    want = {(a, b) for n, a in enumerate(fps) for b in fps[n + 1 :] if (a ^ b).bit_count() <= budget}
    assert got == want


ODD = [(1, None), (2, ""), (2, ""), (None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, None), (4, "x " * 40_000), (5, " \t\n")]


def odd(spark, rows=ODD):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    frame = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows], "doc_id bigint, text string, fp int, k int, n int, url string")
    return frame


def test_simhash_odd_rows(spark):
    got = simhash_dedup.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD)
    empty = [r["component_id"] for r in got if r["fp"] == 0]
    assert empty == [1] * 5
    kept = simhash_dedup.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    assert simhash_dedup.keep_first(odd(spark, [])).count() == 0


def test_one_row_of_each_component_stays(spark):
    x, y, z, v, w = (f"{c}1 {c}2 {c}3 {c}4 {c}5" for c in "xyzvw")
    rows = [(5, x), (5, y), (2, x), (None, z), (None, z), (None, v), (None, w), (7, w), (9, x + " q1 q2"), (9, y + " r1 r2"), (5, y), (None, x)]
    kept = simhash_dedup.keep_first(odd(spark, rows))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    fp = [simhash_dedup.fingerprint(t) for t in dict.fromkeys(t for _, t in rows)]
    assert all((a ^ b).bit_count() > 2 for n, a in enumerate(fp) for b in fp[:n])  # a component for each text
    assert got == sorted([(2, x), (5, y), (None, z), (None, v), (7, w), (9, x + " q1 q2"), (9, y + " r1 r2")], key=str)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a bigint, b bigint")
    nodes = spark.range(0, 202).union(spark.createDataFrame([(500,), (501,)], "id bigint")).withColumnRenamed("id", "node")
    got = {r["node"]: r["label"] for r in common.components(nodes, links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 201: 201, 500: 500, 501: 500}


def test_lookup_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = spark.range(0, 2000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"))
    small = spark.range(0, 1000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    for how in ("inner", "left"):
        got = common.lookup(rows, small, "key", how)
        want = rows.join(small, "key", how)
        assert sorted(got.select("id", "value").collect()) == sorted(want.select("id", "value").collect())


# ---- suffix arrays ----------------------------------------------------------------------------------


def test_suffix_array_equals_sorting():
    rng = random.Random(5)
    for _ in range(1500):
        text = [rng.randint(0, rng.randint(0, 4)) for _ in range(rng.randint(0, 16))]
        assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def slow_dedup(documents, length):
    seen, out = set(), []
    for raw in documents:
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            part = raw[at : at + length]
            if part in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(part)
        edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(gone) + b"\0", np.uint8).astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def passages(seed, count=120):
    rng = random.Random(seed)
    words = ["the", "of", "añ", "on", "erth", "ß"] + ["".join(rng.choices("abcdé", k=rng.randint(3, 9))) for _ in range(60)]
    shared = [" ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(8)]
    line = " ".join(rng.choices(words, k=14))[:70]
    texts = []
    for _ in range(count):
        parts = [rng.choice(shared)[rng.randint(0, 30) :] if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.4:
            parts.insert(rng.randint(0, len(parts)), line)
        texts.append(" ".join(parts))
    return texts + ["ab" * 400, "ab" * 300, "a" * 1000, "", texts[3], texts[3]]


@pytest.mark.parametrize("seed,hot", [(1, None), (2, None), (3, 5)])
def test_dedup_equals_brute_force(spark, monkeypatch, seed, hot):
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(suffix_dedup, "LOT", 40)
    texts = passages(seed)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    got = sorted(suffix_dedup.dedup(frame).collect())
    want = slow_dedup([t.encode() for t in texts], 100)
    assert [[(s["start"], s["end"]) for s in r["spans"]] for r in got] == [w[0] for w in want]
    assert [bytes(r["kept"]) for r in got] == [w[1] for w in want]


def test_parts_of_a_long_document_have_its_anchors(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 700)
    raw = " ".join(passages(4)).encode()
    _, place, gram, context = suffix_dedup.anchors([raw])
    parts = [np.concatenate(x) for x in zip(*suffix_dedup._parted(raw, 100))]
    assert all(np.array_equal(a, b) for a, b in zip((place, gram, context), parts))


def test_dedup_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    got = QUERIES["op10_suffix_dedup"](spark, sf).toPandas().set_index("doc_id")
    for i, t, (spans, kept) in zip(docs.doc_id, docs.text, slow_dedup([(t or "").encode() for t in docs.text], 100)):
        row = got.loc[i]
        assert (row.n_bytes, row.n_removed, row.n_spans) == (len((t or "").encode()), sum(b - a for a, b in spans), len(spans))
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_dedup_odd_rows(spark):
    long = "word and another word to make it long enough for a string of a hundred bytes, which this one is by now. "
    rows = [(5, long * 2), (5, long * 2), (5, long + "x" * 50), (None, long), (1, None), (2, ""), (3, "é" * 60)]
    got = suffix_dedup.dedup(odd(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_bytes"]): r for r in got}
    assert bytes(by[(None, len(long))]["kept"]) == b""
    assert by[(1, 0)]["spans"] == [] and by[(3, 120)]["n_bytes"] == 120
    same = [bytes(r["kept"]) for r in got if r["doc_id"] == 5 and r["n_bytes"] == 2 * len(long)]
    assert len(same) == 2 and same[0] == same[1]
    assert suffix_dedup.dedup(odd(spark, [])).count() == 0


# ---- fingerprints -----------------------------------------------------------------------------------


def apart(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_fingerprints_of_edited_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    got = QUERIES["op9_fingerprints"](spark, sf).toPandas().set_index("doc_id").loc[docs.doc_id]
    texts = [t or "" for t in docs.text]
    after = texts[1:] + texts[:1]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, after)]
    assert list(got.edited_sha256) == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    assert list(got.n_chars) == [len(t) for t in texts]
    own = list(got.fingerprint)
    assert list(got.near_next) == [1 - apart(a, b) / 128 for a, b in zip(own, own[1:] + own[:1])]
    assert list(got.near_edited) == [1 - apart(a, b) / 128 for a, b in zip(own, got.edited_fingerprint)]
    assert len(set(zip(texts, own))) == len(set(texts))
    asked = got[got.index % 50 == 0]
    assert list(asked.n_near) == [sum(apart(f, o) <= 3 for o in own) for f in asked.fingerprint]
    assert (got.near_edited > got.near_next).mean() > 0.95


@pytest.mark.parametrize("radius,blocks", [(0, 3), (2, 4), (3, 5)])
def test_block_tables_find_all(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(15)]
    near = sorted({f ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 5))) for f in base for _ in range(12)})
    signed = lambda w: w - (w >> 63 << 64)
    split = lambda f: [signed(f & (2**64 - 1)), signed(f >> 64)]
    frame = spark.createDataFrame([(split(f),) for f in near], "fp array<bigint>")
    asked = spark.createDataFrame([(split(f),) for f in near[::5]], "fp array<bigint>")
    join = lambda a: (a[0] % 2**64) | (a[1] % 2**64) << 64
    got = {(join(r["query"]), join(r["fp"])) for r in fingerprints.search(frame, asked, radius, blocks).collect()}
    assert got == {(q, f) for q in near[::5] for f in near if (q ^ f).bit_count() <= radius}


def test_next_documents_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 7)
    ids = random.Random(3).sample(range(10_000), 100)
    frame = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(None, "none")], "doc_id bigint, text string")
    rows = fingerprints.with_next(frame).where("not copy").collect()
    got = {r["text"]: r["next_text"] for r in rows}
    order = [f"text {i}" for i in sorted(ids)] + ["none"]
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_fingerprints_odd_rows(spark):
    got = fingerprints.edited_fingerprints(odd(spark)).collect()
    assert len(got) == len(ODD) and all(len(r["fp"]) == 2 for r in got)
    assert len({tuple(r["fp"]) for r in got if r["n_chars"] == 0}) == 1
    one = fingerprints.edited_fingerprints(odd(spark, [(9, "alone here")])).collect()
    assert one[0]["next_fp"] == one[0]["fp"]
    assert fingerprints.edited_fingerprints(odd(spark, [])).count() == 0
    assert fingerprints.edited_fingerprints(odd(spark, [(None, "a"), (None, "b")])).count() == 2


# ---- decontamination --------------------------------------------------------------------------------


def slow_tiles(a, b, least):
    """Greedy string tiling as published: search all pairs for the longest free match, mark it, repeat."""
    marked_a, marked_b, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in marked_a and j + k not in marked_b:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return sorted(out)
        k, i, j = best
        marked_a.update(range(i, i + k))
        marked_b.update(range(j, j + k))
        out.append((i, j, k))


def test_tiling_equals_the_plain_search():
    rng = random.Random(11)
    for _ in range(150):
        item = [rng.choice("abcdef") for _ in range(rng.randint(1, 14))]
        text = [rng.choice("abcdefg") for _ in range(rng.randint(0, 12))] + item[5:] + ["z"] + item[:6]
        index = decontaminate.Index([(1, " ".join(item))], 3)
        least = min(3, len(item))
        found = index.matches(" ".join(text)).get(0, [])
        got = decontaminate.tiles(found, least)
        assert sum(t[2] for t in got) == sum(t[2] for t in slow_tiles(text, item, least))


def test_leaks_are_found_whole_reordered_and_in_blocks(spark, sf):
    items = spark.createDataFrame([(1, "One two three four five. Six seven eight nine ten!"), (2, "tiny item"), (3, None), (4, "")], "item_id bigint, text string")
    docs = [(1, "x ONE two three four five six seven eight nine ten y"), (2, "six seven eight nine ten -- and one two three four five"), (3, "one two three four six seven eight"),
            (4, "a tiny item"), (5, None), (None, "tiny item"), (6, "")]
    for size in (decontaminate.BLOCK_BYTES, 20):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd(spark, docs), items, block_bytes=size).collect()}
        assert got == {(1, 1), (2, 1), (4, 2), (None, 2)}
        kept = decontaminate.decontaminate(odd(spark, docs), items, block_bytes=size)
        assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6] and kept.columns == odd(spark).columns
    assert decontaminate.leaks(odd(spark, docs), items.limit(0)).count() == 0
    assert decontaminate.leaks(odd(spark, []), items).count() == 0


def test_planted_items_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    got = QUERIES["op8_benchmark_decontamination"](spark, sf).toPandas()
    plain = lambda t: f" {' '.join(decontaminate.words(t))} "
    want = {(i, j) for i, t in zip(docs.doc_id, docs.text) for j, u in zip(items.item_id, items.text) if plain(u) in plain(t)}
    assert want <= set(zip(got.doc_id, got.item_id))
    assert (got.coverage >= 0.8).all()


CLASHES = ("_own", "_id", "_digest", "_n", "_terms", "_ID_")


def clashing(spark, rows):
    """Documents with columns named as the operators name their own."""
    names = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, *CLASHES) for i, t in rows], f"doc_id bigint, text string, {names}")


def test_columns_with_clashing_names_stay(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l"), (3, "g h i j k l"), (4, None)]
    kept = simhash_dedup.keep_first(clashing(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4]
    assert all(tuple(r)[2:] == CLASHES for r in kept)


def test_item_ids_of_any_type_and_one_row_for_a_pair_of_ids(spark):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([("x", item), ("y", None)], "item_id string, text string")
    part = " ".join(item.split()[:8])
    docs = spark.createDataFrame([(1, f"so {part} end"), (1, f"so {item} end"), (2, "nothing here"), (None, item)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, "x"): 1.0, (None, "x"): 1.0}
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
