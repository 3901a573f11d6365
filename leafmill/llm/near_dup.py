"""Jaccard join of texts on word n-grams by chosen paths.

The set of a text are its runs of five words (lower case; a word is a run of letters and digits; a text of one to
four words has one element). Texts with the same set are one class, which is handled once. Classes are then split recursively:
a node's random function orders all elements, and a set goes on to the child of its first element, for two
functions a node. Similar sets share such an element with a chance equal to their similarity, so a pair at the threshold
gets through a level with 1.6 common children on average, however deep the tree is. A node with few members is
a leaf. So is a node that keeps most of its parent's members: they are similar to each other throughout, and no split would
part them. All pairs of a leaf are compared on their whole sets, in tiles of bounded size. The members of a leaf of several
tiles go there as what sets them apart from one member, which tells any two as exactly: what sets two of them apart is in one
of their differences and not in the other. Their tiles are made in rounds, so that disk holds a few copies of a difference
at once, however large the leaf is. The tree is built in several independent runs, as many as the wanted recall for pairs at
the threshold takes.

A pair may meet in several leaves; it counts in the first of those that both have. Of leaves with the same members one is
compared. Leaves give no pairs
but, for each member, its number of links there and the first member of its component. Components are then joined by
label propagation with pointer jumping over these, one row per member.

Similarity is exact (the sets are of 64-bit hashes). Empty texts, null texts and texts without a word have no set: no links,
each alone in its group. Rows that repeat have the same set. An empty table gives an empty result. Columns besides id and
text are not read by ``links`` and passed on by ``representatives``; names that start with ``__`` are reserved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from leafmill.llm import words
from leafmill.llm.suffix_dedup import discard, written
from leafmill.session import materialise

WIDTH = 5
SIMILARITY = 0.8
RECALL = 0.999
#: Functions per node.
BRANCHES = 2
#: Members of a node that is not split.
LIMIT = 128
#: Members of a tile's block, as a multiple of those.
BLOCK = 4
#: A child with more than this share of its parent's members is not split again.
DENSE = 0.7
#: Tiles of a leaf whose blocks are up to so many places further apart are made in one round.
SPAN = 4
#: Code points whose sets are made at once, and rows that are read for it.
PIECE, PIECE_ROWS = 2**18, 1024
#: Bits of the filter that tells whose texts are read again, 8 MB at most. More classes than that only let more texts through.
FILTER_BITS = 2**26
_STEP = np.uint64(0xD6E8FEB86659FD93)


def runs_for(recall: float, similarity: float, branches: int = BRANCHES) -> int:
    """Runs after which a pair at the threshold has met in a leaf with probability ``recall``, at any depth."""
    lost = 0.0
    for _ in range(200):
        lost = (1 - similarity + similarity * lost) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def shingles(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of a slice, and where those of each text begin and end."""
    low = [t.lower() for t in texts]
    joined = "\n".join([*low, ""])
    points = words.code_points(joined)
    kind = words.classes(points)
    inside = ((kind == words.LETTER) | (kind == words.DIGIT)).astype(np.int8)
    edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))  # texts end with a sign, so words do not cross them
    begin, end = edge[::2], edge[1::2]
    word = words.word_hashes(points, begin, end)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    first = np.searchsorted(begin, starts)  # the first word of each text
    n = np.diff(first)
    grams = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = words.spread(grams, first[:-1])
    total = np.full(len(at), width, np.uint64)
    for k in range(width):
        place = np.minimum(at + k, max(0, len(word) - 1))
        short = np.repeat(n, grams) <= k  # a text of fewer words ends here
        total = total * _STEP + np.where(short, np.uint64(0), word[place] if len(word) else np.uint64(0))
    bounds = np.concatenate([[0], np.cumsum(grams)])
    return words.mixed(total), bounds


def _functions(nodes: np.ndarray, branch: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiplier and name of a function of each node."""
    seed = words.mixed(nodes + np.full(1, branch + 1, np.uint64) * _STEP)
    return seed | np.uint64(1), words.mixed(seed)


def children(hashes: np.ndarray, bounds: np.ndarray, nodes: np.ndarray, branch: int) -> np.ndarray:
    """The child of each non-empty set hashes[bounds[i]:bounds[i + 1]] in its node."""
    times, name = _functions(nodes, branch)
    order = hashes * np.repeat(times, np.diff(bounds))
    return words.mixed(np.minimum.reduceat(order, bounds[:-1]) ^ name)


def _texts(batch: pa.RecordBatch, k: int) -> list[str]:
    return ["" if t is None else t for t in batch.column(k).to_pylist()]


def _sets(texts: list[str], width: int) -> Iterator[tuple[int, int, list[np.ndarray], list[bytes | None], np.ndarray, np.ndarray]]:
    for a, b in words.slices(texts, PIECE):
        hashes, bounds = shingles(texts[a:b], width)
        sets = [np.unique(hashes[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield a, b, sets, [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], hashes, bounds


def profile(docs: DataFrame, runs: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest of the set, its size, and its children of the roots of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _few(whole, PIECE_ROWS)):
            for a, b, sets, digests, hashes, bounds in _sets(_texts(batch, 1), width):
                full = np.flatnonzero(np.diff(bounds))
                keys = np.zeros((b - a, runs * BRANCHES), np.uint64)
                ends = np.append(bounds[full], bounds[-1])
                for r in range(runs if len(full) else 0):
                    for k in range(BRANCHES):
                        keys[full, r * BRANCHES + k] = children(hashes, ends, np.full(len(full), r, np.uint64), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))], names=["doc_id", "digest", "n", "keys"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, digest binary, n bigint, keys array<bigint>")


def _perhaps(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in the column ``wanted``, and a few others, which a join leaves out. Rows do not move:
    bitmaps of bounded size tell which may be wanted."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bitmaps = wanted.select(place(wanted.columns[0]).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    marked = rows.withColumn("at", F.bitmap_bit_position(place(key)).cast("int")).withColumn("bucket", F.bitmap_bucket_number(place(key))).join(F.broadcast(bitmaps), "bucket")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.expr("at DIV 8 + 1"), F.lit(1))), 16, 10).cast("int")
    return marked.where(F.getbit(byte, F.col("at") % 8) == 1).select(rows.columns)


def _whole_sets(docs: DataFrame, classes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """digest, size, shingles: the set of each class, made again from the text of one of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _few(whole, PIECE_ROWS)):
            for _, _, sets, digests, _, _ in _sets(_texts(batch, 0), width):
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["digest", "shingles"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    texts = _perhaps(rows, "doc_id", classes.select("first_id")).select("text")
    return texts.mapInArrow(run, "digest binary, shingles binary").join(classes.select("digest", "size"), "digest").dropDuplicates(["digest"])


def _few(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in small pieces, since each row brings a whole set along."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _split(large: DataFrame) -> DataFrame:
    """parent, node, digest: the children of each member of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _few(batch):
                sets = [np.frombuffer(x, np.uint64) for x in part["shingles"].to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                hashes, nodes = np.concatenate(sets), part["node"].to_numpy().view(np.uint64)
                for k in range(BRANCHES):
                    yield pa.RecordBatch.from_arrays(
                        [part["node"], pa.array(children(hashes, bounds, nodes, k).view(np.int64)), part["digest"], part["members"]],
                        names=["parent", "node", "digest", "parent_members"])

    return large.select("node", "digest", "members", "shingles").mapInArrow(run, "parent bigint, node bigint, digest binary, parent_members bigint")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, kind, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[kind]
    column, owner = number[kind[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((m, m), np.float32)  # holds counts below 2**24
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        x = np.zeros((m, 4096), np.float32)
        x[owner[a:b], column[a:b] - start] = 1
        out += x @ x.T
    out = out.astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def compare(sets: list[np.ndarray], n: np.ndarray, leaves: list[np.ndarray], leaf: int, blocks: np.ndarray | None, sizes: np.ndarray,
            similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member to documents of other members that are counted here, and the first member of its component.
    ``sets`` are the members' sets of ``n`` elements, or the differences of all of them from one and the same set.
    With ``blocks``, only pairs of different ones are compared."""
    m = len(sets)
    rest = n - np.array([len(s) for s in sets])
    twice = rest[:, None] + rest[None, :] + 2 * common(sets)  # the elements that two sets share, doubled
    near = twice * (similarity.numerator + similarity.denominator) >= 2 * similarity.numerator * (n[:, None] + n[None, :])
    np.fill_diagonal(near, False)
    if blocks is not None:
        near &= blocks[:, None] != blocks[None, :]
    if not near.any():
        return np.zeros(m, np.int64), np.arange(m)
    near &= common([x[x < leaf] for x in leaves]) == 0  # the others count in an earlier leaf
    links = near @ sizes
    root = np.arange(m)
    while True:
        lower = np.minimum(root, np.where(near, root[None, :], m).min(axis=1))
        if (lower == root).all():
            return links, root
        root = lower


def _compare_tiles(similarity: Fraction):
    names = ["digest", "links", "root"]

    def made(rows: list[dict]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        leaves = [np.array(r["leaves"], np.int64) for r in rows]
        first, second = rows[0]["tile"]
        blocks = None if first == second else np.array([r["block"] for r in rows])
        n, sizes = np.array([r["n"] for r in rows]), np.array([r["size"] for r in rows])
        links, root = compare(sets, n, leaves, rows[0]["leaf"], blocks, sizes, similarity)
        some = np.flatnonzero((links > 0) | (root != np.arange(len(rows)))).tolist()
        if not some:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i]["digest"] for i in some], pa.binary()), pa.array(links[some], pa.int64()),
             pa.array([rows[root[i]]["digest"] for i in some], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for row in (row for batch in batches for part in _few(batch) for row in part.to_pylist()):
            if rows and (row["leaf"], row["tile"]) != (rows[0]["leaf"], rows[0]["tile"]):
                if (out := made(rows)) is not None:
                    yield out
                rows = []
            rows.append(row)
        if (out := made(rows)) is not None:
            yield out

    return run


def _compared(tiles: DataFrame, similarity: Fraction) -> DataFrame:
    """digest, links, root of the members of each tile that have any."""
    rows = tiles.select("leaf", "tile", "block", "digest", "size", "n", "shingles", "leaves").repartition("leaf", "tile").sortWithinPartitions("leaf", "tile")
    return rows.mapInArrow(_compare_tiles(similarity), "digest binary, links bigint, root binary")


def _reduced(found: DataFrame) -> DataFrame:
    """The links of each digest summed, with its least root, which takes over the others."""
    whole = found.groupBy("digest").agg(F.sum("links").alias("links"), F.sort_array(F.collect_set("root")).alias("roots"))
    least = F.col("roots")[0].alias("root")
    others = whole.select(F.explode(F.expr("slice(roots, 2, size(roots))")).alias("digest"), F.lit(0).cast("bigint").alias("links"), least)
    return whole.select("digest", "links", least).union(others.distinct())


def _once(leaves: DataFrame, limit: int) -> DataFrame:
    """``leaves`` (node, digest, members) without those of at most ``limit`` members that have the members of another one."""
    few = leaves.where(F.col("members") <= limit).groupBy("node").agg(F.sort_array(F.collect_set("digest")).alias("who"))
    few = few.groupBy("who").agg(F.min("node").alias("node"))
    few = few.select("node", F.explode("who").alias("digest"), F.size("who").cast("bigint").alias("members"))
    return few.union(leaves.where(F.col("members") > limit).select("node", "digest", "members"))


def _known(members: DataFrame, shared: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` with their sets, the sizes of these and all leaves they are in."""
    return members.join(sets.join(shared, "digest").withColumn("n", F.expr("length(shingles) DIV 8")), "digest")


def _differences(large: DataFrame, shared: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of ``large`` leaves (leaf, blocks, block, digest), where ``shingles`` are the elements that only the set of
    the member or that of the leaf's least digest has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in _few(batch)):
            pairs = zip(part["shingles"].to_pylist(), part["base"].to_pylist(), strict=True)
            apart = [np.setxor1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True).tobytes() for a, b in pairs]
            kept = part.drop_columns(["base", "shingles"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(apart, pa.binary())], names=[*kept.schema.names, "shingles"])

    # a base goes to each block, so that no task has a whole leaf
    first = large.groupBy("leaf", "blocks").agg(F.min("digest").alias("digest"))
    bases = first.join(_perhaps(sets, "digest", first.select("digest")).select("digest", F.col("shingles").alias("base")), "digest")
    bases = bases.select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "base")
    rows = _known(large, shared, _perhaps(sets, "digest", large.select("digest"))).join(bases, ["leaf", "block"]).select("leaf", "blocks", "block", "digest", "size", "n", "leaves", "shingles", "base")
    return rows.mapInArrow(run, "leaf bigint, blocks int, block int, digest binary, size bigint, n bigint, leaves array<bigint>, shingles binary")


def _tiles(differences: DataFrame, start: int) -> DataFrame:
    """The rows of the tiles of two blocks that are ``start`` to ``start + SPAN - 1`` places apart."""
    places = sorted({sign * k for k in range(start, start + SPAN) for sign in (-1, 1)})
    rows = differences.where(F.col("blocks") > start).withColumn("other", F.explode(F.array(*[F.col("block") + k for k in places])))
    return rows.where((F.col("other") >= 0) & (F.col("other") < F.col("blocks"))).withColumn(
        "tile", F.array(F.least("block", "other"), F.greatest("block", "other")))


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for the nodes of ``edges`` (a, b)."""
    # a node with many edges keeps the one to its least neighbour, which takes over the others
    least = edges.distinct().withColumn("least", F.min("b").over(Window.partitionBy("a")))
    fewer = least.select("a", F.col("least").alias("b")).union(least.where(F.col("b") != F.col("least")).select("b", "least")).distinct()
    both = materialise(fewer.union(fewer.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        lower = materialise(
            labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label")), "labels")
        ahead = lower.select(F.col("node").alias("at"), F.col("label").alias("ahead"))
        jumped = materialise(
            lower.join(ahead, lower["label"] == ahead["at"]).select("node", "old", F.col("ahead").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def _grouped(docs: DataFrame, id_col: str, text_col: str, similarity: float, recall: float, width: int, limit: int) -> DataFrame:
    """doc_id, digest, class_id, set_id, n_links: one row per row."""
    share = Fraction(str(similarity))
    runs = runs_for(recall, similarity)
    rows = written(profile(docs, runs, width, id_col, text_col), "profile")
    # the keys follow from the set, so any row of a class has them
    classes = materialise(rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("size"), F.first("keys").alias("keys")), "classes")
    wide, rows = rows, written(rows.select("doc_id", "digest"), "set-digests")
    discard(wide)
    roots = classes.select("digest", F.explode("keys").alias("node"))
    counts = roots.groupBy("node").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    members = materialise(roots.join(counts, "node"), "members")
    steps = [members]
    leaves = members.where(F.col("members") <= limit).select("node", "digest", "members")
    large = members.where(F.col("members") > limit)
    # only these sets are read level by level, the others are made again for their tiles
    sets = written(_whole_sets(docs, large.select("digest").distinct().join(classes, "digest"), width, id_col, text_col), "sets")
    while not large.isEmpty():
        below = materialise(_split(large.join(_perhaps(sets, "digest", large.select("digest")), "digest")), "children")
        counts = below.groupBy("node").agg(F.count("*").alias("members")).where(F.col("members") > 1)
        wide, below = below, written(below.join(counts, "node").select("node", "digest", "members", "parent_members"), "members")
        discard(wide)
        steps.append(below)
        done = (F.col("members") <= limit) | (F.col("members") > DENSE * F.col("parent_members"))
        leaves = leaves.union(below.where(done).select("node", "digest", "members"))
        large = below.where(~done)
    leaves = written(_once(leaves.distinct(), limit), "leaves")
    discard(*steps)
    shared = leaves.groupBy("digest").agg(F.collect_set("node").alias("leaves"))
    blocks = F.ceil(F.col("members") / (limit * BLOCK)).cast("int")
    placed = leaves.select(F.col("node").alias("leaf"), "digest", blocks.alias("blocks"), F.pmod(F.xxhash64("digest", "node"), blocks).cast("int").alias("block"))
    whole = placed.where(F.col("blocks") == 1).withColumn("tile", F.array("block", "block"))
    met = _whole_sets(docs, whole.select("digest").distinct().join(classes, "digest"), width, id_col, text_col)
    found = written(_compared(_known(whole, shared, met), share), "links")
    apart = placed.where(F.col("blocks") > 1)
    most = apart.agg(F.max("blocks")).first()[0]
    if most:
        differences = written(_differences(apart, shared, sets), "differences")
        for start in range(0, most, SPAN):
            found = found.union(written(_reduced(_compared(_tiles(differences, start), share)), "links"))
        discard(differences)
    discard(sets, leaves)
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    label = components(found.where(F.col("digest") != F.col("root")).select(F.col("digest").alias("a"), F.col("root").alias("b")))
    labelled = classes.select("digest", "first_id", "size").join(label, F.col("digest") == F.col("node"), "left").join(links, "digest", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "digest"))
    firsts = labelled.groupBy("label").agg(F.min("first_id").alias("class_id"))
    # also frees what the tiles left, which were still known to the driver when they were written
    result = written(labelled.join(firsts, "label").select(
        "digest", "class_id", F.col("first_id").alias("set_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    alone = F.col("digest").isNull()
    return rows.select("doc_id", "digest").join(result, "digest", "left").select(
        "doc_id", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL,
          width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id; class_id, the least id of all documents that links join to it; set_id, the least id
    of those with the same set; n_links, how many other documents are at least so similar."""
    return _grouped(docs, id_col, text_col, similarity, recall, width, limit).drop("digest")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                    recall: float = RECALL, width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` that stay if one document of each group does (that with the least id), with all their columns.
    Rows without a word stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _few(whole, PIECE_ROWS)):
            for a, b, _, digests, _, _ in _sets(_texts(batch, at), width):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(digests, pa.binary())], names=[*batch.schema.names, "__digest"])

    groups = _grouped(docs, id_col, text_col, similarity, recall, width, limit)
    stay = groups.where(F.col("digest").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).select(
        F.col("doc_id").alias("__id"), F.col("digest").alias("__set")).distinct()
    rows = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__digest", BinaryType())]))
    same = (rows["__digest"] == stay["__set"]) & rows[f"`{id_col}`"].eqNullSafe(stay["__id"])
    kept = rows.join(stay, same, "left_semi").dropDuplicates(["__digest", id_col])
    return kept.union(rows.where(F.col("__digest").isNull())).drop("__digest")
