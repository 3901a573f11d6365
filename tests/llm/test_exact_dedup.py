from collections import defaultdict
from hashlib import sha256

import pytest

from leafmill.llm.exact_dedup import DigestIndex

UPPER = {i: i + 32 for i in range(65, 91)}
ROWS = [(1, "A b"), (2, "a B"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "a b"), (7, "a b"), (None, "x"), (None, "x"), (8, "X"), (9, "ÀZ"),
        (10, "àz"), (11, "Àz"), (12, "word " * 30000), (13, "Word " * 30000)]


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: -1 if i is None else i)
        used = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not used, sha256(text.encode()).hexdigest()))
            used = used or i == keep
    return sorted(out, key=repr)


def run(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def test_one_batch(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    assert run(DigestIndex.create(spark).decide(docs)) == expected(ROWS)


def test_later_batch_is_held_against_the_index(spark):
    index = DigestIndex.create(spark, buckets=3)
    first = spark.createDataFrame([(5, "one"), (6, "two"), (7, "ONE")], "doc_id bigint, text string")
    index.decide(first).collect()
    second = index.decide(spark.createDataFrame([(1, "One"), (9, "one"), (2, "three"), (3, "three")], "doc_id bigint, text string"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.seen_before) for r in second.collect()}
    assert got == {1: (7, 2, False, True), 9: (7, 2, False, True), 2: (3, 2, False, False), 3: (3, 2, True, False)}
    assert index.read().count() == 3
    assert index.read().groupBy("digest").count().where("count > 1").isEmpty()


def test_a_batch_that_runs_again_decides_the_same(spark):
    index = DigestIndex.create(spark, buckets=3)
    index.decide(spark.createDataFrame([(1, "old")], "doc_id bigint, text string"))
    rows = spark.createDataFrame([(5, "one"), (6, "two"), (7, "ONE"), (8, "Old")], "doc_id bigint, text string")
    first = run(index.decide(rows))
    assert [r[3] for r in first] == [False, True, True, False]
    assert run(index.decide(rows)) == first and index.read().count() == 3
    # under another name it is another batch
    assert not any(r[3] for r in run(index.decide(rows, batch="later")))


def test_nothing_is_lost_by_a_failure_after_the_append(spark, monkeypatch):
    index = DigestIndex.create(spark, buckets=3)
    rows = spark.createDataFrame([(i, f"text {i % 30}") for i in range(50)], "doc_id bigint, text string")
    append = DigestIndex._append

    def half(self, new):
        append(self, new.where("digest < '8'"))
        raise OSError("lost")

    monkeypatch.setattr(DigestIndex, "_append", half)
    with pytest.raises(OSError):
        index.decide(rows)
    monkeypatch.undo()
    assert run(index.decide(rows)) == expected([(i, f"text {i % 30}") for i in range(50)])
    assert index.read().count() == 30


def test_a_dropped_index_leaves_its_decisions(spark):
    index = DigestIndex.create(spark)
    decided = index.decide(spark.createDataFrame(ROWS, "doc_id bigint, text string"))
    index.drop()
    assert not spark.catalog.tableExists(index.table)
    assert run(decided) == expected(ROWS)


def test_survivors_keep_all_columns(spark):
    docs = spark.createDataFrame([(i, t, "d", 1, True) for i, t in ROWS], "doc_id bigint, text string, digest string, keep_id int, kept boolean")
    left = DigestIndex.create(spark).survivors(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(
        ((i, max(t or "" for j, t in ROWS if j == i and (t or "").translate(UPPER) == text) if text else next(t for j, t in ROWS if j == i))
         for i, text in {(k, (t or "").translate(UPPER)) for k, t in ROWS} if (i, sha256(text.encode()).hexdigest()) in
         {(a, e) for a, _, _, kept, e in expected(ROWS) if kept}), key=repr)


@pytest.mark.parametrize("method", ["decide", "survivors"])
def test_empty_table(spark, method):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert getattr(DigestIndex.create(spark), method)(docs).collect() == []


def test_an_index_is_made_without_python_workers(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("rows of Python")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    for id_type in ("bigint", "string", "decimal(20,0)"):
        index = DigestIndex.create(spark, id_type)
        assert index.read().dtypes == [("digest", "string"), ("keep_id", id_type), ("batch", "string")]
        assert index.read().collect() == []
        index.drop()
