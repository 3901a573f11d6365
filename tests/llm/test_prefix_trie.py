"""The trie against a dictionary of whole prefixes."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from leafmill.llm.prefix_trie import SpillingQueue, forward, numbered, prefix_trie, turn_digest
from leafmill.llm.queries import op13_prefix_trie
from tests.llm.helpers import table


def rebuilt(rows):
    """Conversations from (conv_id, turn, role, text), as the contract words it."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    heads = {c: crc32(str(c).encode()) % 6 for c in turns}
    return {c: turns.get(c - c % 100, [])[: heads[c]] + ts[heads[c] :] for c, ts in turns.items()}


def plain(convs):
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in children[node])
        ends = ",".join(str(c) for c in sorted(members[node]) if len(convs[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]),
                    leaves[node], saved[node], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert [f.dataType.simpleString() for f in df.schema][:7] == ["bigint"] * 7
    return sorted([tuple(r) for r in df.collect()], key=repr)


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return got(op13_prefix_trie(spark, str(tmp_path)))


def test_query_on_the_table(spark, tmp_path):
    rows = table("conversations", "conv_id, turn, role, text")
    assert run(spark, rows, tmp_path) == plain(rebuilt(rows))


def test_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    ids = [*range(90, 330), 1005, 1007, 40_000, 40_001, 8200, 8300]
    rows = [(c, rng.choice([None, *range(8)]), rng.choice(["user", "a", "", None]), rng.choice(["x", "y", "é😀", "", None, "same"]))
            for c in ids for _ in range(rng.randint(1, 9))]
    rows += [(c, 0, "user", "Hello.") for c in range(500, 900)]  # many short copies: hot nodes, some rebuilt without turns
    rows += [(None, 0, "user", "lost"), (None, None, None, None)]
    assert run(spark, rows, tmp_path) == plain(rebuilt(rows))


def test_any_conversations(spark):
    """Deep shared paths, one long conversation and a hot one, without the heads of the query."""
    rng = random.Random(6)
    rows = [(c, t, "user", rng.choice("ab")) for c in range(700) for t in range(rng.randint(1, 9))]
    rows += [(c, t, "user", "a") for c in range(700, 1100) for t in range(30)] + [(5000, t, "user", "a" * (t % 3)) for t in range(1500)]
    rows += [(c, t, r, x) for c in (6000, 6001) for t, (r, x) in enumerate([("ab", "c"), ("a", "bc"), ("", ":")])]
    turns = numbered(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    turns = turns.select("conv_id", F.col("pos").alias("place"), turn_digest(F.col("role"), F.col("text")).alias("turn"), F.char_length("text").cast("bigint").alias("size"))
    itself = turns.select("conv_id").distinct().select("conv_id", F.lit(0).cast("bigint").alias("place"), F.lit(b"").alias("turn"), F.lit(0).cast("bigint").alias("size"))
    convs = defaultdict(list)
    for c, t, r, x in sorted(rows):
        convs[c].append((r, x))
    assert got(prefix_trie(itself.unionByName(turns))) == plain(convs)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


@pytest.mark.parametrize("most", [2, 7, 1000])
def test_queue_that_spills(most):
    rng, queue, held = random.Random(most), SpillingQueue(most), []
    for _ in range(3000):
        if held and rng.random() < 0.4:
            held.sort()
            assert queue.first() == held[0]
            assert queue.pop() == held.pop(0)
        else:
            item = (rng.randint(0, 50), rng.randint(0, 9))
            queue.push(item)
            held.append(item)
    held.sort()
    assert [queue.pop() for _ in held] == held
    assert queue.first() is None


@pytest.mark.parametrize("most", [2, 5, 1000])
def test_shards_one_after_the_other(most):
    """Random forests: totals by recursion."""
    rng, nodes = random.Random(most), []
    for shard in range(6):
        depth = {0: 0}
        for k in range(1, 60):
            up = rng.randrange(k)
            depth[k] = depth[up] + 1
            nodes.append((shard, depth[k], (shard, k), (shard, up), rng.randint(0, 9), 0, 0, 0))
        nodes.append((shard, 0, (shard, 0), None, 1, 2, 5, 100))  # as if other shards had sent something
    below = defaultdict(list)
    for n in nodes:
        below[n[3]].append(n)

    def total(n):
        kids = [total(k) for k in below[n[2]]]
        children = n[5] + len(kids)
        return children, n[6] + sum(k[1] for k in kids) + (children == 0), n[7] + n[4] + sum(k[2] for k in kids)

    want = {n[2]: total(n) for n in nodes}
    order = sorted(nodes, key=lambda n: (n[0], -n[1], n[2]))
    assert {k: tuple(t) for k, *t in forward(iter(order), most)} == want
