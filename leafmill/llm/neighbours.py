"""Nearest neighbours by largest inner product, as a block matrix join.

Queries and candidates are cut into blocks of bounded size. Each block of candidates meets each block of
queries in one tile; a tile needs only its two blocks. In it, vectors are int8 with one scale each, and the
product of the codes, with a bound on what rounding can change (Cauchy-Schwarz on the rounding errors), gives
an interval for every inner product. A candidate stays if its interval reaches the k-th lower end of its
query. The products of those that stay are computed again in double precision from the original vectors, a heap
keeps the k best of the tile, and the tiles' lists are merged per query in the same way. The result is exact.

Vectors that are null, all zero, or hold null or non-finite components take no part. Only vectors of the same
length meet. A row is never its own neighbour. Of rows that share an id and a length one takes part (the greatest
vector); rows with a null id take no part. Ties go to the smaller id. A query without candidates has no rows; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import materialise

#: Vectors in a block.
BLOCK = 2048
_BLOCKS = "side string, block bigint, dim int, ids binary, vectors binary"


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes and scale of each row, and the length of what rounding lost."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale[scale == 0] = 1
    code = np.rint(vectors / scale[:, None]).astype(np.int8)
    return code, scale, np.linalg.norm(vectors - code * scale[:, None], axis=1)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 rows. They are sums of integers that a float holds exactly, so BLAS may add them."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its k best candidates of the block, best first, as (-score, id)."""
    q_code, q_scale, q_lost = codes(q)
    c_code, c_scale, c_lost = codes(c)
    q_size, c_size = np.linalg.norm(q, axis=1), np.linalg.norm(c_code * c_scale[:, None], axis=1)
    tiny = 1e-9 * np.outer(q_size, np.linalg.norm(c, axis=1))  # for the rounding of the bounds themselves
    # q.c = q~.c~ + (q - q~).c~ + q.(c - c~)
    bound = np.outer(q_lost, c_size) + np.outer(q_size, c_lost) + tiny
    middle = code_products(q_code, c_code) * np.outer(q_scale, c_scale)
    low = middle - bound
    own = q_ids[:, None] == c_ids[None, :]
    low[own] = -np.inf
    take = min(k, low.shape[1])
    kth = np.partition(low, low.shape[1] - take, axis=1)[:, low.shape[1] - take]
    stay = (middle + bound >= kth[:, None]) & ~own
    for i in range(len(q_ids)):
        near = np.flatnonzero(stay[i])
        scores = (c[near] * q[i]).cumsum(axis=1)[:, -1]  # from the first component to the last, for every row alike
        best = heapq.nsmallest(k, zip((-scores).tolist(), c_ids[near].tolist(), strict=True))
        yield int(q_ids[i]), best


def _block(keys: tuple, rows: pa.Table) -> pa.Table:
    """One row for the vectors of one (side, dim, block); of rows that share an id the greatest vector counts."""
    side, dim, block = (k.as_py() for k in keys)
    ids = rows["vec_id"].to_numpy()
    vectors = rows["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    last = np.append(ids[1:] != ids[:-1], True)
    return pa.table({"side": [side], "block": pa.array([block], pa.int64()), "dim": pa.array([dim], pa.int32()),
                     "ids": [ids[last].tobytes()], "vectors": [np.ascontiguousarray(vectors[last]).tobytes()]})


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
                q = np.frombuffer(row["q_vectors"], np.float64).reshape(len(q_ids), -1)
                c = np.frombuffer(row["c_vectors"], np.float64).reshape(len(c_ids), -1)
                found = [x for a in range(0, len(q_ids), 256) for x in tile(q_ids[a : a + 256], q[a : a + 256], c_ids, c, k)]
                yield _lists(found)

    return run


def _lists(found: list[tuple[int, list[tuple[float, int]]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in found], pa.int64()), pa.array([[n for _, n in best] for _, best in found], pa.list_(pa.int64())),
         pa.array([[-s for s, _ in best] for _, best in found], pa.list_(pa.float64()))], names=["query_id", "vec_ids", "scores"])


def _merge(k: int):
    """The lists of each query of a task become one; a task holds k candidates for each of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for i, ids, scores in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                new = list(zip([-s for s in scores], ids, strict=True))
                best[i] = list(islice(heapq.merge(best[i], new), k)) if i in best else new
        if best:
            yield _lists(list(best.items()))

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for every query its k nearest rows, nearest first."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = (
        vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
        .where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    )
    total = rows.agg(F.count("*").alias("c"), F.count_if("is_query").alias("q")).first()
    blocks = {side: max(1, -(-total[side] // block)) for side in ("c", "q")}
    place = F.when(F.col("side") == "c", F.lit(blocks["c"])).otherwise(F.lit(blocks["q"]))
    sides = F.when(F.col("is_query"), F.array(F.lit("c"), F.lit("q"))).otherwise(F.array(F.lit("c")))
    dealt = (
        rows.select("vec_id", "vector", F.size("vector").alias("dim"), F.explode(sides).alias("side"))
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), place)))
    packed = materialise(dealt.groupBy("side", "dim", "block").applyInArrow(_block, _BLOCKS), "blocks")
    q = packed.where("side = 'q'").select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    c = packed.where("side = 'c'").select("dim", F.col("block").alias("c_block"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"))
    # the grid holds block numbers only; the two joins bring each of its tiles the two blocks
    grid = q.select("dim", "q_block").join(c.select("dim", "c_block"), "dim")
    tiles = grid.join(q, ["dim", "q_block"]).join(c, ["dim", "c_block"])
    lists = "query_id bigint, vec_ids array<bigint>, scores array<double>"
    found = tiles.select("q_ids", "q_vectors", "c_ids", "c_vectors").mapInArrow(_tiles(k), lists)
    merged = found.repartition("query_id").mapInArrow(_merge(k), lists)
    return (
        merged.select("query_id", F.posexplode(F.arrays_zip("vec_ids", "scores")).alias("at", "one"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_ids").alias("vec_id"), F.col("one.scores").alias("score")))
