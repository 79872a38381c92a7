"""The prefix tree of conversations by z-fast tries.

A conversation is the chain of the digests of its first 0, 1, 2, ... turns, so a node of the tree is
known by one digest wherever it is met. Each task builds compacted tries of the conversations it reads:
a compacted node is hashed at the two-fattest depth of its edge (its handle), the exit node of a
conversation is found by a fat binary search over handles, and conversations are inserted in batches.
The edges are then expanded to one partial node per depth, and the partial nodes of all tasks are added
up by digest. A node that a third of all conversations pass arrives at that sum once per trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import importable, lookup, slices, stage

ROOT = bytes(16)
TURNS = 1 << 18  # turns after which a task passes its trie on and starts a new one
SPAN = 4096  # ids that are spelled out together
WORDS = r"[^ \t-\r]++"


# ---- z-fast trie ------------------------------------------------------------------------------------


def two_fattest(a: int, b: int) -> int:
    """The number in ``(a, b]`` that the highest power of two divides."""
    return b & -(1 << (a ^ b).bit_length() - 1)


class Node:
    """A compacted node: the first ``depth`` digests of ``path``; its edge starts below its parent's depth."""

    __slots__ = ("path", "depth", "parent", "least", "members", "words")

    def __init__(self, path: list[bytes], words: list[int], depth: int, parent: Node | None):
        self.path, self.words, self.depth, self.parent = path, words, depth, parent
        self.least: int | None = None
        self.members = 0


class ZFastTrie:
    """Paths are lists of digests ``[ROOT, first turn, first two turns, ...]``; the digest of a prefix names it."""

    def __init__(self) -> None:
        self.root = Node([ROOT], [0], 0, None)
        self.handles: dict[bytes, Node] = {}
        self.below: dict[bytes, Node] = {}  # first digest of an edge to the node at its end
        self.nodes = [self.root]
        self.turns = 0

    def exit_node(self, path: list[bytes]) -> Node:
        """The deepest node whose whole path begins ``path``, by fat binary search."""
        low, high, found = 0, len(path) - 1, self.root
        while low < high:
            at = two_fattest(low, high)
            node = self.handles.get(path[at])
            if node is None:
                high = at - 1
            elif node.depth < len(path) and path[node.depth] == node.path[node.depth]:
                low, found = node.depth, node
            else:
                return node.parent
        return found

    def _hang(self, node: Node) -> None:
        top = node.parent.depth
        self.handles[node.path[two_fattest(top, node.depth)]] = node
        self.below[node.path[top + 1]] = node

    def _cut(self, edge: Node, depth: int) -> Node:
        """A new node inside an edge."""
        mid = Node(edge.path, edge.words, depth, edge.parent)
        edge.parent = mid
        self._hang(mid)
        self._hang(edge)
        self.nodes.append(mid)
        return mid

    def locate(self, path: list[bytes], words: list[int]) -> Node:
        """The node at the end of ``path``, which is added if it is missing."""
        node = self.exit_node(path)
        last = len(path) - 1
        if node.depth < last and (edge := self.below.get(path[node.depth + 1])):
            low, high = node.depth + 1, min(edge.depth, last)
            while low < high:  # equal digests are equal prefixes, so the common part can be halved
                at = (low + high + 1) // 2
                low, high = (at, high) if path[at] == edge.path[at] else (low, at - 1)
            node = self._cut(edge, low)
        if node.depth < last:
            node = Node(path, words, last, node)
            self._hang(node)
            self.nodes.append(node)
            self.turns += last
        return node

    def insert(self, batch: list[tuple[int, list[bytes], list[int]]]) -> None:
        """Conversations ``id, path, words``; those of one path are added up before the trie is searched."""
        ends: dict[bytes, list] = {}
        for conv, path, words in batch:
            end = ends.setdefault(path[-1], [conv, 0, path, words])
            end[0] = min(end[0], conv)
            end[1] += 1
        for least, members, path, words in ends.values():
            node = self.locate(path, words)
            node.members += members
            node.least = least if node.least is None else min(node.least, least)

    def expanded(self) -> Iterator[tuple[bytes, bytes | None, int, int, int, int]]:
        """``node, parent, depth, conv_id, n_convs, words`` of every depth of every edge."""
        for node in sorted(self.nodes, key=lambda x: -x.depth):  # children before parents
            up = node.parent
            if up is not None:
                up.members += node.members
                up.least = node.least if up.least is None else min(up.least, node.least)
            for depth in range(up.depth + 1 if up else 0, node.depth + 1):
                parent = node.path[depth - 1] if depth else None
                yield node.path[depth], parent, depth, node.least, node.members, node.words[depth]


# ---- conversations -----------------------------------------------------------------------------------


def sequences(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """``conv_id, turns`` with digest and words of every turn, in order; texts stay where they are read.

    Turns go by ``turn``, null first, and turns of one number by their digest. A null role or text is the
    empty one. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    spelled = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    one = F.struct(
        F.col("turn").alias("turn"), F.unhex(F.md5(spelled.cast("binary"))).alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("words")
    )
    rows = turns.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("conv_id"), one.alias("one"))
    ordered = F.transform(F.sort_array(F.collect_list("one")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """``conv_id, path, words, sums``: digests of all prefixes, the empty one first, words of their last turns and words so far."""
    importable(convs.sparkSession)
    kind = dict(convs.dtypes)["conv_id"]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found, words, sums = [], [], []
                for turns in part.column("turns").to_pylist():
                    path = [ROOT]
                    for t in turns:
                        path.append(hashlib.md5(path[-1] + t["digest"]).digest())
                    found.append(path)
                    words.append([0, *(t["words"] for t in turns)])
                    sums.append(list(accumulate(words[-1])))
                columns = [part.column("conv_id"), pa.array(found, pa.list_(pa.binary())), *(pa.array(x, pa.list_(pa.int64())) for x in (words, sums))]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "path", "words", "sums"])

    return convs.select("conv_id", "turns").mapInArrow(chain, f"conv_id {kind}, path array<binary>, words array<bigint>, sums array<bigint>")


def partial_nodes(found: DataFrame, turns: int = TURNS) -> DataFrame:
    """The expanded nodes of the tries of all tasks; a trie is passed on when it holds ``turns`` turns."""
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["node", "parent", "depth", "conv_id", "n_convs", "words"]

    def rows(trie: ZFastTrie) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        for row in trie.expanded():
            block.append(row)
            if len(block) == 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block), kinds)], names)
                block = []
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block), kinds)], names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie()
        for batch in batches:
            for part in slices(batch):
                trie.insert(list(zip(*(part.column(c).to_pylist() for c in ("conv_id", "path", "words")))))
                if trie.turns >= turns:
                    yield from rows(trie)
                    trie = ZFastTrie()
        if trie.root.members or len(trie.nodes) > 1:
            yield from rows(trie)

    return found.mapInArrow(build, "node binary, parent binary, depth bigint, conv_id bigint, n_convs bigint, words bigint")


def _spelled_ends(found: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of the nodes where conversations end: SHA-256 of their ids, ascending, comma-joined.

    The ids of a span of numbers are sorted and joined in one bounded group; a node's spans are then hashed
    one after the other as they stream by, so a node where very many conversations end is held nowhere.
    """
    ends = found.select(F.element_at("path", -1).alias("node"), "conv_id", F.floor(F.col("conv_id") / SPAN).alias("span"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    spans = ends.groupBy("node", "span").agg(joined.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            nodes, done = batch.column("node").to_pylist(), ([], [])
            for key, ids in zip(nodes, batch.column("ids").to_pylist()):
                if key != node:
                    if running is not None:
                        done[0].append(node)
                        done[1].append(running.hexdigest())
                    node, running = key, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["node", "ends_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["node", "ends_sha256"])

    ordered = spans.repartition("node").sortWithinPartitions("node", "span").select("node", "ids")
    return ordered.mapInArrow(digest, "node binary, ends_sha256 string")


def build(convs: DataFrame, turns: int = TURNS) -> DataFrame:
    """All nodes of the prefix tree of ``convs`` (``conv_id``, an integer and unique, and ``turns``).

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. A conversation without turns is a member of the
    root only; without conversations there is no node. Equal conversations share every node.

    Sums over subtrees come from the conversations, not from walks up the tree: a conversation saves the
    words of those of its turns whose node has a smaller member, and a childless node counts for all
    prefixes of its smallest member.
    """
    found = stage(paths(convs.withColumn("conv_id", F.col("conv_id").cast("bigint"))), "paths")
    merged = partial_nodes(found, turns).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent")
    )
    nodes = stage(merged, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    # The nodes whose smallest member is c are the end of c's path: where it starts, and whether it ends childless.
    owned = nodes.join(children, "node", "left").groupBy("conv_id").agg(
        F.min("depth").alias("first"), F.max(F.struct("depth", F.col("n_children").isNull().alias("leaf"))).alias("last")
    )
    own = found.join(owned, "conv_id", "left").select(
        "path", F.coalesce("first", F.size("path")).cast("int").alias("first"), F.coalesce("last.leaf", F.lit(False)).alias("leaf"),
        "sums",
    )
    reach = F.when(F.col("leaf"), F.size("path")).otherwise(F.col("first"))
    passed = own.select("first", "leaf", "sums", F.posexplode(F.slice("path", F.lit(1), reach)).alias("at", "node")).select(
        "node", F.col("leaf").cast("bigint").alias("n_leaves"),
        F.when(F.col("at") < F.col("first"), F.get("sums", F.col("first") - 1) - F.coalesce(F.get("sums", F.col("at") - 1), F.lit(0))).otherwise(0).alias("saved_tokens"),
    )
    sums = passed.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    whole = stage(
        nodes.join(children, "node", "left").join(sums, "node", "left").join(_spelled_ends(found), "node", "left").select(
            "node", "parent", "conv_id", "depth", "n_convs", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        ),
        "whole",
    )
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return lookup(whole, above, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
