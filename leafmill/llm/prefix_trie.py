"""Trie of conversation prefixes, with totals of every subtree.

A node is a distinct sequence of first turns (role and text); the root is the empty one. The conversations that begin with it
are its members, and the least of them and the depth name it. A node's key is a digest made from its parent's key and its last
turn, so one pass over a conversation's turns in order gives the keys of its nodes, and one aggregate over all of them the nodes.

Subtree totals come from time-forward processing. Nodes are sorted in reverse level order; each one takes from a priority queue what its
children sent, and sends its own totals to its parent's place in the order. Nodes of more than a ``SHARDS``-th of all
conversations are the upper tree, at most ``SHARDS`` of a level. What hangs below the upper tree are the shard roots; the subtree of one
has at most that share of the conversations and is processed in one task, which sorts its rows outside memory and keeps a queue that spills.
Totals of shard roots are summed per parent, and the upper tree is processed the same way.

Turns are ordered by turn (null first), then role and text; a null role or text counts as empty; rows without a conversation
id belong to no conversation; turns may repeat; a conversation without turns is a member of the root; other columns are ignored.
Without any conversation there is no node: an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.ranking import running_number
from leafmill.session import materialise

SHARDS = 256
RUN = 1000  # turns that are numbered together
ENDS = 4096  # ids whose decimals are joined in one piece
SALTS = 32
#: Messages that a queue holds in memory.
QUEUE = 200_000
ROOT = sha256(b"").digest()
MEMBER = "long_id bigint, depth bigint, key binary, parent binary, size bigint, is_end boolean"


class SpillingQueue:
    """A priority queue of tuples that keeps at most ``most`` in memory. What is more goes as a sorted run to an unnamed
    file of the task, which nobody else reads and which is gone with the task; a task that runs again makes its own."""

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.runs, self.spilled = most, [], [], 0

    def push(self, item: tuple) -> None:
        if len(self.heap) >= self.most:
            self.heap.sort()
            half = len(self.heap) // 2
            self._spill(self.heap[half:])  # the later ones; what is left is sorted, so still a heap
            del self.heap[half:]
        heapq.heappush(self.heap, item)

    def _spill(self, items: list[tuple]) -> None:
        file = tempfile.TemporaryFile()
        for item in items:
            pickle.dump(item, file)
        file.seek(0)
        run = self._read(file)
        self.spilled += 1
        heapq.heappush(self.runs, (next(run), self.spilled, run))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield pickle.load(file)
                except EOFError:
                    return

    def first(self) -> tuple | None:
        heads = [h for h in (self.heap[:1], [r[0] for r in self.runs[:1]]) if h]
        return min(h[0] for h in heads) if heads else None

    def pop(self) -> tuple:
        if self.heap and (not self.runs or self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        item, number, run = self.runs[0]
        following = next(run, None)
        if following is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (following, number, run))
        return item


def forward(nodes: Iterator[tuple], most: int = QUEUE) -> Iterator[tuple]:
    """Totals of nodes in reverse level order. A node is (shard, depth, key, parent, value, children, leaves, saved), the last three what
    other shards sent; the result is (key, children, leaves, saved). Shards follow one another."""
    queue = SpillingQueue(most)
    for shard, depth, key, parent, value, children, leaves, saved in nodes:
        here = (shard, -depth, key)
        while (head := queue.first()) is not None and head[:3] == here:
            *_, c, n, s = queue.pop()
            children, leaves, saved = children + c, leaves + n, saved + s
        leaves += children == 0
        saved += value
        yield key, children, leaves, saved
        if parent is not None:
            queue.push((shard, 1 - depth, parent, 1, leaves, saved))


_TOTALS = "key binary, n_children bigint, n_leaves bigint, saved_tokens bigint"


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    yield from _batched(forward(rows()), [("key", pa.binary()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])


def _batched(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    for row in rows:
        out.append(row)
        if len(out) == most:
            yield batch()
            out.clear()
    if out:
        yield batch()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes on the way of every conversation, from rows sorted by conversation and place; the first row of each is the root's."""

    def rows() -> Iterator[tuple]:
        now, waiting = None, None
        for batch in batches:
            for conv, turn, size in zip(batch["conv_id"].to_pylist(), batch["turn"].to_pylist(), batch["size"].to_pylist(), strict=True):
                if waiting is not None:
                    yield (*waiting, conv != now)
                if waiting is None or conv != now:
                    now, waiting = conv, (conv, 0, ROOT, None, 0)
                else:
                    key = sha256(waiting[2] + turn).digest()
                    waiting = (conv, waiting[1] + 1, key, waiting[2], size)
        if waiting is not None:
            yield (*waiting, True)

    yield from _batched(rows(), [("long_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("size", pa.int64()), ("is_end", pa.bool_())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's pieces, comma-joined, from rows sorted by key and place."""

    def rows() -> Iterator[tuple]:
        now, state = None, None
        for batch in batches:
            for key, piece in zip(batch["key"].to_pylist(), batch["piece"].to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        yield now, state.hexdigest()
                    now, state = key, sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
        if now is not None:
            yield now, state.hexdigest()

    yield from _batched(rows(), [("key", pa.binary()), ("ends_sha256", pa.string())])


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), role, text: the turns of every conversation in order."""
    rows = conversations.select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]).where("conv_id IS NOT NULL")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return running_number(rows, ["conv_id"], order, [F.floor(F.col("turn") / RUN)], "pos").select("conv_id", "pos", "role", "text")


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", F.char_length(role).cast("string"), F.concat(role, text)).cast("binary"), 256))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations. ``turns`` has conv_id (bigint), place (sorts the turns of a conversation; the
    row with the least place is no turn and stands for the conversation itself), turn (binary, equal for equal turns), size (what a turn costs).

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    sorted_ = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "turn", "size")
    members = materialise(sorted_.mapInArrow(_members, MEMBER), "trie-members")
    nodes = members.groupBy("key", "parent", "depth", "size").agg(F.min("long_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = materialise(nodes.withColumn("value", (F.col("n_convs") - 1) * F.col("size")).drop("size"), "trie-nodes")
    convs = nodes.where("depth = 0").agg(F.sum("n_convs")).first()[0] or 0
    is_upper = F.col("n_convs") * SHARDS > convs
    nothing = [F.lit(0).cast("bigint").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]

    # the shard root of a conversation is its first node below the upper tree
    upper = nodes.where(is_upper)
    low = members.join(upper.select("key"), "key", "left_anti").groupBy("long_id").agg(F.min_by("key", "depth").alias("shard"))
    lower = materialise(nodes.where(~is_upper).join(low.withColumnRenamed("long_id", "conv_id"), "conv_id"), "trie-lower")
    in_order = lower.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "key")
    done = in_order.select("shard", "depth", "key", F.when(F.col("key") != F.col("shard"), F.col("parent")).alias("parent"), "value", *nothing)
    lower_totals = materialise(done.mapInArrow(_forward, _TOTALS), "trie-shards")

    sent = lower.where("key = shard").select("key", "parent").join(lower_totals, "key").groupBy("parent").agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    top = upper.join(sent.withColumnRenamed("parent", "key"), "key", "left").repartition(1).sortWithinPartitions(F.desc("depth"), "key")
    top = top.select(F.lit(b"").alias("shard"), "depth", "key", "parent", "value",
                     *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    every = lower_totals.unionByName(top.mapInArrow(_forward, _TOTALS))

    # ids that end at a node, in pieces of bounded size
    ends = members.where("is_end").groupBy("key", F.floor(F.col("long_id") / ENDS).alias("place")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("long_id")), lambda i: i.cast("string")), ",").alias("piece"))
    ends = ends.repartition("key").sortWithinPartitions("key", "place").select("key", "piece").mapInArrow(_digests, "key binary, ends_sha256 string")

    # a node of the upper tree may have any number of children, so these are spread
    salt = F.when(F.col("key") == F.col("shard"), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(0)
    copies = F.when(is_upper, F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).otherwise(F.array(F.lit(0).cast("bigint")))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.explode(copies).alias("salt"))
    children = lower.withColumn("salt", salt).drop("shard").unionByName(upper.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))))
    out = children.join(parents, ["parent", "salt"], "left").join(every, "key").join(ends, "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))


def shared_heads(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations rebuilt so that they share their beginnings, as rows of ``prefix_trie``: conversation c begins with the first
    h turns of conversation c - c % every, h = crc32(c) % most, and goes on with its own turns after the first h."""
    turns = materialise(turns.withColumn("turn", turn_digest(F.col("role"), F.col("text"))).withColumn("size", F.char_length("text").cast("bigint"))
                        .select("conv_id", "pos", "turn", "size"), "trie-turns")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    ids = turns.select("conv_id").distinct().withColumn("h", head)
    begin = ids.select(F.col("conv_id").alias("c"), "h", (F.col("conv_id") - F.col("conv_id") % every).alias("conv_id"))
    heads = begin.where("h > 0").join(turns.where(F.col("pos") < most), "conv_id").where("pos <= h").select(F.col("c").alias("conv_id"), F.struct(F.lit(1).alias("part"), "pos").alias("place"), "turn", "size")
    own = turns.where(F.col("pos") > head).select("conv_id", F.struct(F.lit(2).alias("part"), "pos").alias("place"), "turn", "size")
    itself = ids.select("conv_id", F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("pos")).alias("place"), F.lit(b"").alias("turn"), F.lit(0).cast("bigint").alias("size"))
    return itself.unionByName(heads).unionByName(own)
