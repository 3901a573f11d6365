import tracemalloc
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from leafmill.llm import packing, words
from leafmill.llm.packing import best_fit, pack, pieces
from tests.llm.helpers import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(spark, rows, length, partitions):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, bin int, fill string").repartition(partitions)
    library = Tokenizer.from_file(PATH)
    out = pack(docs, PATH, length=length).collect()
    wanted, given, sequences = defaultdict(list), defaultdict(list), defaultdict(list)
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) % length or min(len(ids), length)
        cuts = [0, *range(head, len(ids) + 1, length)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            wanted[i].append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    for r in out:
        given[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {i: sorted(x) for i, x in given.items()} == {i: sorted(x) for i, x in wanted.items()}
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= length
    total = sum(r.length for r in out)
    return len(sequences), -(-total // length)


def test_given_documents(spark):
    made, bound = check(spark, table("documents", "doc_id, text"), 2048, 9)
    assert made <= bound * 1.02 + 2


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 3000), (3, "word " * 3000), (None, "a b c"), (4, "x"), (4, "x"), (5, "one two three four five six seven")]
    made, bound = check(spark, rows, 8, 3)
    assert made <= bound + 3


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []


def test_pieces():
    assert pieces(1, 4) == [(0, 1)] and pieces(4, 4) == [(0, 4)] and pieces(8, 4) == [(0, 4), (4, 4)] and pieces(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_best_fit_takes_the_fullest_bin_that_fits():
    bins = best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert sorted(sorted(b) for b in bins) == [[0, 2], [1, 3, 4]]


def test_a_large_batch_takes_little_memory(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = pa.array(["some words of a text " * 100] * 2000)
    run = packing._cut_and_pack(PATH, 2048)
    list(run(iter([pa.record_batch([pa.array([0]), texts[:1]], names=["doc_id", "text"])])))  # the tokenizer stays
    tracemalloc.start()
    try:
        out = list(run(iter([pa.record_batch([pa.array(range(2000)), texts], names=["doc_id", "text"])])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 2000
    assert most < 50_000_000


def test_words_that_are_learned_again_keep_their_ids():
    ids = words.WordIds(lambda w: [ord(c) for c in w] * 30, kept=3000)
    texts = [" ".join(f"w{i}" for i in range(k, k + 2500)) for k in (0, 1000, 0, 4000)]
    for text in texts:
        points, bounds = words.code_points(text), words.bounds_of([text])
        begin = np.flatnonzero(words.words_with_spaces(points, bounds))
        (got,) = ids.texts(text, points, bounds, begin, np.append(begin[1:], len(points)))
        assert got.tolist() == [ord(c) for s, e in zip(begin, [*begin[1:], len(text)], strict=True) for c in text[s:e] * 30]
