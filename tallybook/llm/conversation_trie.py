"""Conversation prefix trie: every distinct beginning of the conversations, with its members, leaves and savings.

Distinct turns get ids from a dictionary, a conversation is an array of ids. Distinct conversations are sorted into range
shards of about SHARD_TURNS turns, each a ternary search tree: a node holds a turn id, its smaller and larger siblings, and
the tree of what follows. Medians go in first, so sibling trees are balanced. A node is made after its parent, so one pass over
the nodes backwards sums up members, leaves and savings without recursion. Only the nodes on a shard's first and last
conversation can go on in other shards: these boundary nodes are told by a digest of their path, merged by grouped sums,
and their subtrees summed by doubling the distance to the ancestor, round by round.

Edge cases: a null role or text is an empty one; turns order by turn (null first), role, text, and repeated rows are turns each.
Rows without a conv_id are no conversation. An empty table gives an empty result, otherwise the root is a node even if all
conversations are turnless. Other columns are not read. A conversation's ids (8 bytes a turn) are one value, so one
conversation has to fit a task; groups of equal conversations don't: they are counted before they move, and the digest of their
members is taken over chunks that stream through.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.batches import small_batches
from tallybook.llm.storage import small_side, written

#: Turns of a range shard.
SHARD_TURNS = 200_000
#: Characters of a chunk of member ids.
CHUNK = 1 << 16
NO_MEMBER = sha256(b"").hexdigest()

NODES = (
    "boundary boolean, path binary, parent_path binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, chars bigint, ends_sha256 string"
)


def coded_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 1), id, chars of every turn; equal (role, text) have equal ids.

    A sort across tasks numbers the turns: a conversation of many ranges takes its offset from the ranges before.
    """
    rows = conversations.select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(k) for c, k in ((role, "role"), (text, "text"))),
        F.monotonically_increasing_id().alias("at"),
    ).where("conv_id IS NOT NULL")
    key = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")).alias("key")
    ordered = written(
        rows.sort("conv_id", F.asc_nulls_first("turn"), "role", "text", "at")
        .select("conv_id", key, F.length("text").alias("chars"), F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at"))
    )
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    offsets = sizes.select("conv_id", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("offset"))
    dictionary = written(ordered.groupBy("key").agg(F.max("chars").alias("chars")).withColumn("id", F.monotonically_increasing_id()))
    placed = ordered.drop("chars").join(offsets, ["conv_id", "range"]).join(dictionary, "key")
    return written(placed.select("conv_id", (F.col("at") + F.col("offset")).alias("place"), "id", "chars"))


def with_shared_heads(turns: DataFrame, base: Column, kept: Column, most: int) -> DataFrame:
    """conv_id, ids, chars of every conversation whose first `kept` (at most `most`) turns are replaced by those of conversation `base`.

    base, kept: columns over conv_id.
    """
    turn = F.struct("place", "id", "chars")
    heads = turns.where((F.col("conv_id") == base) & (F.col("place") <= most)).groupBy(F.col("conv_id").alias("of_base")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    tails = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("place") > kept, turn))).alias("tail"))
    met = tails.join(heads, F.col("of_base") == base, "left")
    none = F.array().cast("array<struct<place:bigint,id:bigint,chars:int>>")
    rebuilt = met.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), kept), "tail").alias("turns"))
    return rebuilt.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars"))


def member_digests(members: DataFrame) -> DataFrame:
    """key, ends: the SHA-256 of the ascending, comma-joined conv_ids of every key.

    A sort across tasks joins runs of members to chunks; a key's chunks then stream through one digest.
    """

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": [key], "first": [first], "chunk": [",".join(held)]})

        for batch in batches:
            for of, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (of != key or size >= CHUNK):
                    yield closed()
                    held, size = [], 0
                if not held:
                    key, first = of, conv_id
                held.append(str(conv_id))
                size += len(held[-1]) + 1
        if held:
            yield closed()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            done = []
            for of, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                if of == key:
                    running.update(b",")
                else:
                    done.append((key, running))
                    key, running = of, sha256()
                running.update(chunk.encode())
            done = [(k, r.hexdigest()) for k, r in done if r]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["key", "ends"])
        if running:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends": [running.hexdigest()]})

    chunks = small_batches(members.select("key", "conv_id").sort("key", "conv_id")).mapInArrow(chunked, "key string, first bigint, chunk string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").select("key", "chunk").mapInArrow(digested, "key string, ends string")


class TernaryTree:
    """Ternary search trees over turn ids, one below every node; node 0 is the textless root."""

    def __init__(self) -> None:
        self.turn, self.smaller, self.larger, self.below, self.parent, self.depth, self.chars, self.members, self.least, self.ends = ([] for _ in range(10))
        self._node(0, -1, 0)

    def _node(self, turn: int, parent: int, chars: int) -> int:
        for column, value in (
            (self.turn, turn), (self.smaller, -1), (self.larger, -1), (self.below, -1), (self.parent, parent), (self.depth, self.depth[parent] + 1 if parent >= 0 else 0),
            (self.chars, chars), (self.members, 0), (self.least, None), (self.ends, None),
        ):
            column.append(value)
        return len(self.turn) - 1

    def _child(self, node: int, turn: int, chars: int) -> int:
        links, at = self.below, node
        while (to := links[at]) >= 0:
            if turn == self.turn[to]:
                return to
            links, at = self.smaller if turn < self.turn[to] else self.larger, to
        made = self._node(turn, node, chars)
        links[at] = made
        return made

    def insert(self, ids: list[int], chars: list[int], members: int, least: int, ends: str) -> list[int]:
        """Add a conversation; returns its path of nodes."""
        path = [0]
        for turn, n in zip(ids, chars):
            path.append(self._child(path[-1], turn, n))
        node = path[-1]
        self.members[node], self.least[node], self.ends[node] = members, least, ends
        return path


def tree_of(rows: list[tuple]) -> tuple[TernaryTree, list[int], list[int]]:
    """The tree of sorted distinct conversations (ids, chars, members, least, ends), medians first, and the paths of the first and the last."""
    tree, paths, spans = TernaryTree(), {}, [(0, len(rows))]
    while spans:
        a, b = spans.pop()
        if a < b:
            middle = (a + b) // 2
            path = tree.insert(*rows[middle])
            if middle in (0, len(rows) - 1):
                paths[middle] = path
            spans += [(middle + 1, b), (a, middle)]
    return tree, paths[0], paths[len(rows) - 1]


def shard_nodes(rows: list[tuple]) -> Iterator[tuple]:
    """Rows of NODES for a shard's conversations; of boundary nodes the sums over what doesn't lie on the boundary itself."""
    tree, first, last = tree_of(rows)
    count = len(tree.turn)
    paths: dict[int, bytes] = {}
    for node in [*first, *last]:
        parent = tree.parent[node]
        if node not in paths:
            paths[node] = blake2b((paths[parent] if parent >= 0 else b"") + tree.turn[node].to_bytes(8, "big", signed=True), digest_size=16).digest()
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    for node in range(count - 1, -1, -1):
        parent, boundary = tree.parent[node], node in paths
        if not boundary:
            saved[node] += (tree.members[node] - 1) * tree.chars[node]
            leaves[node] = leaves[node] or 1
        if parent >= 0:
            tree.members[parent] += tree.members[node]
            if tree.least[parent] is None or tree.least[node] < tree.least[parent]:
                tree.least[parent] = tree.least[node]
            if not boundary:
                children[parent] += 1
                leaves[parent] += leaves[node]
                saved[parent] += saved[node]
    for node in range(count):
        parent = tree.parent[node]
        inner = parent >= 0 and parent not in paths
        yield (
            node in paths, paths.get(node), paths.get(parent), tree.least[node], tree.depth[node], tree.least[parent] if inner else None, tree.members[node],
            children[node], leaves[node], saved[node], tree.chars[node], tree.ends[node],
        )


def sharded_nodes(sequences: DataFrame, shard_turns: int) -> DataFrame:
    """Rows of NODES of all shards of distinct conversations (ids, chars, members, least, ends)."""
    turns = sequences.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    names = [c.split()[0] for c in NODES.split(", ")]
    arrow = {"boolean": pa.bool_(), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
    kinds = [arrow[c.split()[1]] for c in NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), key=lambda row: row[0])
        made = []
        for node in shard_nodes(rows) if rows else ():
            made.append(node)
            if len(made) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)

    shards = max(1, -(-turns // shard_turns))
    dealt = sequences.select("ids", "chars", "members", "least", "ends").repartitionByRange(shards, "ids")
    return small_batches(dealt).mapInArrow(run, NODES)


def merged_boundary(parts: DataFrame) -> DataFrame:
    """The boundary nodes of all shards, one row each, with whole sums over their subtrees."""
    sums = parts.groupBy("path").agg(
        *(F.max(c).alias(c) for c in ("parent_path", "depth", "chars", "ends_sha256")), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    nodes = written(sums)
    under = nodes.groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("n")).where("path IS NOT NULL")
    nodes = nodes.join(under, "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("n", F.lit(0))).drop("n")
    nodes = written(
        nodes.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
        .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars"))
    )
    # Sums over descendants nearer than 2**round, and the ancestor at that distance.
    state = nodes.select("path", F.col("parent_path").alias("ancestor"), "n_leaves", "saved_tokens")
    reach, deepest = 1, nodes.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        further = state.where("ancestor IS NOT NULL").groupBy(F.col("ancestor").alias("path")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        up = state.select(F.col("path").alias("ancestor"), F.col("ancestor").alias("next"))
        state = written(
            state.join(further, "path", "left").join(up, "ancestor", "left")
            .select("path", F.col("next").alias("ancestor"), *((F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))))
        )
        reach *= 2
    return written(nodes.drop("n_leaves", "saved_tokens").join(state.drop("ancestor"), "path"))


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of conversations (conv_id, ids, chars)."""
    keyed = written(sequences.withColumn("key", F.md5(F.concat_ws(",", F.col("ids").cast("array<string>")))))
    distinct = keyed.groupBy("key", "ids", "chars").agg(F.count("*").alias("members"), F.min("conv_id").alias("least"))
    parts = written(sharded_nodes(written(distinct.join(member_digests(keyed), "key")), shard_turns))
    boundary = merged_boundary(parts.where("boundary"))
    parents = small_side(boundary.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("merged_parent")))
    nodes = parts.where("NOT boundary").unionByName(boundary.withColumn("boundary", F.lit(True)).withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    return nodes.join(parents, "parent_path", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "merged_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_MEMBER)).alias("ends_sha256"),
    )
