"""Periodic runs, the prefix tree of conversations and the mix of sources, against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import mixture, periodic_runs, prefix_trie
from barline.llm.queries import QUERIES
from tests.llm.test_dedup import ODD, odd

# ---- periodic runs ----------------------------------------------------------------------------------


def slow_runs(words, shortest=12):
    """Every stretch of words equal to those ``q`` further on, for every ``q``."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, out = np.array([number[w] for w in words], np.int64), []
    for q in range(1, len(ids) // 2 + 1):
        same = np.concatenate([[0], (ids[:-q] == ids[q:]).astype(np.int8), [0]])
        for s, e in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            long = int(e - s) + q
            if long >= max(shortest, 2 * q) and not any((ids[s : s + long - p] == ids[s + p : s + long]).all() for p in range(1, q)):
                out.append((int(s), long, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(1500):
        n, letters = rng.randint(0, 80), rng.choice([1, 2, 3, 5, 20])
        words = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.7:
            a = rng.randrange(n)
            p = 1 + rng.randrange((n - a) // 2 + 1)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            if rng.random() < 0.4:
                cut = rng.randrange(n)
                words = words[:cut] + [rng.randrange(letters)] + words[cut:] + words[: cut // 2]
        shortest = rng.choice([12, 12, 2, 5])
        assert periodic_runs.runs_of(np.array(words, np.int64), shortest) == slow_runs(words, shortest), words


def test_grammar_derives_its_text_and_repeats_no_pair():
    rng = random.Random(3)
    for _ in range(200):
        ids = np.array([rng.randrange(4) for _ in range(rng.randint(2, 60))], np.int64)
        rules, start, terminals = periodic_runs.re_pair(ids)

        def spelled(s):
            return [s] if s < terminals else spelled(rules[s - terminals][0]) + spelled(rules[s - terminals][1])  # noqa: B023

        assert [t for s in start for t in spelled(s)] == ids.tolist()
        seen = defaultdict(list)
        for i, pair in enumerate(zip(start, start[1:])):
            seen[pair].append(i)
        assert all(len(at) < 2 or at == [at[0], at[0] + 1] for at in seen.values())  # only an overlap is left


def test_periodic_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    some = 0
    for i, text in zip(docs.doc_id, docs.text):
        words = text.encode().split()
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        runs = slow_runs(words)
        some += len(runs)
        gone = {j for s, m, q in runs for j in range(s + q, s + m)}
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        row = got[i]
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"]) == ((best[1], -best[0], best[2]) if best else (None,) * 3)
        assert row["exponent_milli"] == (1000 * -best[0] // best[2] if best else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(w for j, w in enumerate(words) if j not in gone)).hexdigest()
    assert some > 5


def test_runs_of_odd_rows(spark):
    got = periodic_runs.find_runs(odd(spark)).collect()
    assert len(got) == len(ODD)
    for row in got:
        if row["doc_id"] == 4:
            assert [tuple(r) for r in row["runs"]] == [(0, 40_000, 1)] and row["collapsed"] == "x"
        else:
            assert row["runs"] == []
    assert [r["collapsed"] for r in got if r["doc_id"] in (1, 2, 5)] == [""] * 4
    assert periodic_runs.find_runs(odd(spark, [])).count() == 0


# ---- conversations ----------------------------------------------------------------------------------


def slow_tree(convs):
    """Rows of the prefix tree of ``{id: [(role, text), ...]}``."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for key, of in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = {k for k in below if len(k) == len(key) + 1}
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode().split()) for k in below if k)
        leaves = sum(1 for k in below if not any(len(o) > len(k) and o[: len(k)] == k for o in members))
        ends = ",".join(str(c) for c in sorted(of) if len(convs[c]) == len(key))
        rows.append((min(of), len(key), min(members[key[:-1]]) if key else None, len(of), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def tree(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, node int, parent string, depth int, digest int, one int")


def plain(rows):
    return [(*r, 1, "x", 2, 3, 4) for r in rows]


@pytest.mark.parametrize("turns", [2, 1 << 18])
def test_tree_equals_brute_force(spark, turns):
    rng = random.Random(12)
    convs = {}
    for c in range(120):
        kind = rng.random()
        base = convs[rng.choice(list(convs))] if convs and kind < 0.8 else []
        own = [(rng.choice("ua"), " ".join(rng.choice("xyz") for _ in range(rng.randint(0, 2)))) for _ in range(rng.randint(1 if not base else 0, 7))]
        convs[c] = base[: rng.randint(0, len(base))] + own or [("u", "")]
    rows = [(c, d, r, t) for c, ts in convs.items() for d, (r, t) in enumerate(ts)]
    rng.shuffle(rows)
    found = prefix_trie.sequences(talk(spark, plain(rows)).repartition(5))
    assert tree(prefix_trie.build(found, turns)) == slow_tree(convs)


def test_trie_finds_exit_nodes():
    rng = random.Random(2)

    def path(word):
        return [prefix_trie.ROOT, *(word[: d + 1].encode() for d in range(len(word)))]

    for _ in range(60):
        words = {"".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(25)}
        trie = prefix_trie.ZFastTrie()
        for n, w in enumerate(sorted(words, key=lambda _: rng.random())):
            trie.insert([(n, path(w), [0] * (len(w) + 1))])
        deep = {n.path[n.depth]: n.depth for n in trie.nodes}
        for node in trie.nodes[1:]:
            handle = prefix_trie.two_fattest(node.parent.depth, node.depth)
            assert trie.handles[node.path[handle]] is node
        assert len(trie.handles) == len(trie.nodes) - 1 <= 2 * len(words)
        for w in [*words, *("".join(rng.choice("ab") for _ in range(9)) for _ in range(20))]:
            want = max(d for d, p in enumerate(path(w)) if p in deep)
            assert trie.exit_node(path(w)).depth == want


def test_tree_of_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "u", "a b"), (1, 0, "u", "a b"),
        (2, 5, "u", "c"), (2, None, "", ""), (None, 0, "u", "lost"), (3, 1, None, ""), (4, 1, "u", "x " * 50_000),
        (9, 0, "", ""), (9, 1, "u", "a b"), (9, 2, "u", "a b"),
    ]
    convs = {1: [("", ""), ("u", "a b"), ("u", "a b")], 2: [("", ""), ("u", "c")], 3: [("", "")], 4: [("u", "x " * 50_000)], 9: [("", ""), ("u", "a b"), ("u", "a b")]}
    assert tree(prefix_trie.build(prefix_trie.sequences(talk(spark, plain(rows))))) == slow_tree(convs)
    assert prefix_trie.build(prefix_trie.sequences(talk(spark, []))).count() == 0
    # A role is never taken for a part of the text, and turns of one number have one order.
    swapped = prefix_trie.sequences(talk(spark, plain([(1, 0, "ab", "c"), (2, 0, "a", "bc")])))
    assert prefix_trie.build(swapped).where("depth = 1").count() == 2
    tied = [(c, 0, "u", t) for c, ts in ((1, "pqr"), (2, "rqp")) for t in ts]
    assert prefix_trie.build(prefix_trie.sequences(talk(spark, plain(tied)))).where("n_convs = 2").count() == 4


def test_rebuilt_tree_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    own = {c: list(zip(g.role, g.text)) for c, g in rows.groupby("conv_id")}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    convs = {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}
    assert tree(QUERIES["op12_prefix_trie"](spark, sf)) == slow_tree(convs)


# ---- mix --------------------------------------------------------------------------------------------


def slow_seats(votes, most, total):
    out = [0] * len(votes)
    for _ in range(min(total, sum(m for v, m in zip(votes, most) if v))):
        best = max((Fraction(v) / (2 * k + 1), -i) for i, (v, k) in enumerate(zip(votes, out)) if k < most[i])
        out[-best[1]] += 1
    return out


def test_seats_go_to_the_highest_quotients():
    rng = random.Random(13)
    for _ in range(200):
        n = rng.randint(1, 9)
        votes = [rng.choice([0, 1, 3, 3, 8, 20, 57]) for _ in range(n)]
        most = [3 * v for v in votes]
        total = rng.randint(0, 3 * sum(votes))
        assert mixture.seats(votes, most, total).tolist() == slow_seats(votes, most, total), (votes, total)


def test_shards_get_the_highest_quotients(spark, monkeypatch):
    monkeypatch.setattr(mixture, "RANGE", 3)
    rng = random.Random(5)
    blocks = {n: [rng.choice([0, 1, 2, 2, 7, 7, 40]) for _ in range(rng.randint(1, 11))] for n in range(25)}
    wanted = {n: rng.randint(0, 3 * sum(b)) for n, b in blocks.items()}
    shards = spark.createDataFrame([(n, i, v) for n, b in blocks.items() for i, v in enumerate(b)], "number bigint, shard bigint, blocks bigint")
    got = {(r["number"], r["shard"]): r["quota"] for r in mixture.shard_quotas(shards, wanted, 3).collect()}
    for n, b in blocks.items():
        assert [got[n, i] for i in range(len(b))] == slow_seats(b, [3 * v for v in b], wanted[n])


def test_targets_fill_up():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 10, 100, 10_000]) for _ in range(rng.randint(1, 8))]
        weights = [1 + i % 3 for i in range(len(sizes))]
        got = mixture.targets(sizes, weights, 3)
        assert abs(got.sum() - sum(sizes)) < 1e-6
        free = [g / w for g, w, s in zip(got, weights, sizes) if g < 3 * s - 1e-9]
        assert all(g <= 3 * s + 1e-9 for g, s in zip(got, sizes))
        if free:  # all below their limit share one level, and none at its limit is below that level
            assert max(free) - min(free) < 1e-6 and all(g / w <= max(free) + 1e-6 for g, w in zip(got, weights))


def test_blocks_are_taken_by_quota():
    rng = np.random.default_rng(4)
    for _ in range(100):
        sizes = rng.integers(0, 50, rng.integers(1, 40))
        words = int(sizes.sum())
        blocks = max(1, round(words / 16)) if words else 0
        quota = int(rng.integers(0, 3 * blocks + 1))
        taken = mixture.taken_words(sizes, blocks, quota, 7)
        assert (taken >= 0).all() and (taken <= 3 * sizes).all()
        assert not blocks or abs(taken.sum() - quota * words / blocks) <= blocks
        # Word by word, from the blocks alone.
        edges = [i * words // blocks for i in range(blocks + 1)] if blocks else []
        if quota == blocks:
            assert taken.tolist() == sizes.tolist()
        assert len(edges) == (blocks + 1 if blocks else 0)


def test_mix_meets_its_targets(spark, sf):
    rows = QUERIES["op13_source_mix"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    sizes = {i: len(t.encode().split()) for i, t in docs.text.items()}
    assert dict(zip(rows.doc_id, rows["size"])) == sizes and len(rows) == len(docs)
    assert (rows.taken <= 3 * rows["size"]).all() and (rows.taken >= 0).all()
    rows["source"] = rows.doc_id.map(docs.source)
    names = sorted(docs.source.unique())
    total = rows.groupby("source")["size"].sum().reindex(names)
    goal = mixture.targets(total.to_list(), [1 + i % 3 for i in range(len(names))], 3)
    for n, s in enumerate(names):
        mine = rows[rows.source == s]
        assert (mine.source_size == total[s]).all() and np.allclose(mine.target, goal[n])
        assert abs(mine.taken.sum() - goal[n]) <= 2 * mixture.BLOCK


def test_mix_of_odd_rows(spark):
    text = lambda n: " ".join(["w"] * n)
    rows = [(1, None, "a"), (2, "", "a"), (None, text(40), "b"), (3, text(3000), None), (3, text(3000), None), (4, text(70_000), "c"), (5, text(9), ""), (6, text(100), "b")]
    rows += [(7, text(30), "hot")] * 500 + [(8, "", "hot")] * 300
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], "doc_id bigint, text string, source string, n int, size int, seed string, shard int, number int")
    run = lambda f: sorted(map(tuple, mixture.mix(f, shard=1 << 10).collect()), key=str)
    got = run(frame)
    assert got == run(frame.repartition(7, F.rand()))
    assert len(got) == len(rows)
    assert sorted((r[0] or 0, r[1]) for r in got) == sorted((i or 0, len((t or "").split())) for i, t, _ in rows)
    assert all(0 <= r[4] <= 3 * r[1] for r in got)
    goal = defaultdict(float)
    taken = defaultdict(int)
    for r in got:
        goal[r[2]], taken[r[2]] = r[3], taken[r[2]] + r[4]
    for size, target in goal.items():  # one key for each source: all sizes differ
        assert abs(taken[size] - target) <= 2 * mixture.BLOCK + size * 0.002, (size, target, taken[size])
    empty = mixture.mix(frame.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert [r["taken"] for r in mixture.mix(frame.where("doc_id < 3")).collect()] == [0, 0]
