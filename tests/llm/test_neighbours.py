import math
import random

from pyspark.sql import functions as F

from leafmill.llm.neighbours import nearest


def plain(rows, k):
    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def product(v, w):
        total = 0.0
        for a, b in zip(v, w, strict=True):
            total += a * b
        return total

    best = {}
    for i, v in rows:
        if i is not None and usable(v):
            best.setdefault(len(v), {}).setdefault(i, []).append(v)
    best = {n: {i: max(vs) for i, vs in ids.items()} for n, ids in best.items()}
    out = []
    for ids in best.values():
        for q, v in ids.items():
            if q % 3 == 0:
                found = sorted((-product(v, w), c) for c, w in ids.items() if c != q)[:k]
                out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return sorted(out)


def test_against_plain(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 400)]  # ties
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [math.nan] * 8), (404, [1.0, None] * 4), (405, [math.inf] * 8), (None, [1.0] * 8)]
    rows += [(500, [1.0, 2.0]), (501, [2.0, 1.0]), (504, [5.0]), (6, rows[6][1]), (9, [9.0] * 8), (406, [1e12, -1e12] * 4), (408, [1e-12] * 8)]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id bigint, embedding array<double>, rank int, score double")
    for block in (2048, 16):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 3 == 0, k=7, block=block).collect())
        assert got == plain(rows, 7)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2.0)]
    assert nearest(df.limit(0), F.lit(True)).collect() == []
