import random
from hashlib import sha256

import numpy as np

from leafmill.llm.suffix_dedup import equal_strings, remove_repeats, suffix_array


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in [*range(30), 200, 1001]:
        for letters in (1, 2, 3, 26):
            x = rng.integers(1, letters + 1, n)
            assert suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_equal_strings():
    x = np.array([1, 2, 3, 1, 2, 3, 1, 2, 9])
    order, new = equal_strings(x, np.arange(7), 3)
    groups = np.split(order, np.flatnonzero(new)[1:])
    assert sorted(sorted(g.tolist()) for g in groups) == [[0, 3], [1, 4], [2, 5], [6]]


def plain(rows, length):
    first = {}
    for i, t in rows:
        i, b = -1 if i is None else i, (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (-1 if i is None else i):
                gone[k : k + length] = True
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdefgh é\n") for _ in range(rng.randint(30, 140))) for _ in range(8)]
    out = [(i, "".join(rng.choice([rng.choice(passages), "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 40)))]) for _ in range(rng.randint(0, 6))))
           for i in range(120)]
    return out + [(300, None), (301, ""), (302, "a" * 49), (303, "a" * 50), (304, "a" * 300), (305, "b" + "a" * 60), (7, "a" * 70), (7, out[3][1]),
                  (None, passages[0]), (None, "a" * 55), (306, out[5][1]), (306, out[5][1]), (307, passages[1] * 400)]


def run(spark, data, **options):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in data], "doc_id bigint, text string, part int, kept string")
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, **options).collect()), key=repr)


def test_against_plain(spark):
    assert run(spark, rows()) == plain(rows(), 50)


def test_small_parts_buckets_and_cut_contexts(spark):
    assert run(spark, rows(), many=2, part=700, exchange=200, bucket=400) == plain(rows(), 50)


def test_empty_table(spark):
    assert run(spark, []) == []
