import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import near_dup
from leafmill.llm.near_dup import links, representatives, runs_for
from tests.llm.helpers import near_groups, table, word_sets


def made_rows():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefghijkl") * 2 for _ in range(rng.randint(0, 30)))) for i in range(40)]
    base = [rng.choice("mnopqrstuvwxyz") * 3 + str(k) for k in range(120)]
    for i in range(100, 160):  # one large group of near copies, some of them equal as sets
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "new" + str(i)
        rows.append((i, (" " if i % 2 else ", ").join(words)))
    return rows + [(200, None), (201, ""), (202, "!!! ..."), (203, "one two"), (204, "One, two!"), (205, "two one"), (206, "same " * 40000), (207, "same " * 7)]


def check(spark, rows, **options):
    got = {r.doc_id: (r.class_id, r.set_id, r.n_links) for r in links(spark.createDataFrame(rows, "doc_id bigint, text string"), **options).collect()}
    sets = word_sets(rows)
    near, root = near_groups(sets)
    ids = [i for i, _ in rows]
    for k, i in enumerate(ids):
        same = min(ids[j] for j in range(len(ids)) if sets[j] == sets[k]) if sets[k] else i
        assert got[i] == (ids[root[k]], same, len(near[k])), rows[k]


def test_made_rows(spark):
    check(spark, made_rows())


def test_small_leaves_and_tiles(spark):
    check(spark, made_rows(), limit=4)


def test_given_documents(spark):
    check(spark, table("documents", "doc_id, text"))


def test_signs_beyond_the_basic_letters(spark):
    clauses = ["今天天气很好", "我们去公园散步", "花儿都开了", "孩子们在唱歌", "ひるごはん", "カタカナ", "한국어 문장", "𠀀𠀁", "٣٤", "देश"]
    long = [f"{c}{k}" for k in range(6) for c in clauses]
    other = ["变" + c if k == 30 else c for k, c in enumerate(long)]
    plain = [f"word{k}" for k in range(40)]
    rows = [(1, "。".join(long)), (2, "，".join(long)), (3, "、".join(other)), (4, "\u3000".join(other) + "！"), (5, " ".join(plain)),
            (6, " ".join(w + "\U0001f600" for w in plain)), (7, "\U0001f680".join(plain[1:])), (8, "。、，"), (9, "\U0001f600 \U0001f680"), (10, "\u3000")]
    check(spark, rows)
    sets = word_sets(rows)
    assert sets[0] == sets[1] and sets[4] == sets[5] and not any(sets[7:])


def test_representatives(spark):
    rows = [(i, t, "x", i) for i, t in made_rows()] + [(150, "again " * 9, "y", 1), (None, "alone in the world it is", "z", 2), (None, "alone in the world it is", "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest string, n int")
    left = representatives(docs, limit=4)
    assert left.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    plain = [(i, t) for i, t, _, _ in rows if i is not None]
    _, root = near_groups(word_sets(plain))
    assert sorted(t or "" for i, t in kept if i is not None) == sorted(t or "" for k, (i, t) in enumerate(plain) if root[k] == k)
    assert sum(i is None for i, _ in kept) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert links(docs).collect() == [] and representatives(docs).collect() == []


@pytest.mark.parametrize(("recall", "runs"), [(0.9, 1), (0.99, 2), (0.999, 3)])
def test_runs(recall, runs):
    assert runs_for(recall, 0.8) == runs


def test_texts_do_not_move_to_make_sets_again(spark):
    """Also of ids that repeat or are null, and where the filter lets nearly all texts through."""
    rows = [(i, f"text {i} " + " ".join(f"w{i * k % 7}" for k in range(20))) for i in range(200)] + [(3, "another text of this id here"), (None, "a text without an id here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    classes = near_dup.profile(docs, 1, 5, "doc_id", "text").where("doc_id % 10 = 3 OR doc_id IS NULL").selectExpr("digest", "doc_id AS first_id", "1L AS size")
    classes = classes.dropDuplicates(["digest"]).localCheckpoint()
    want = {bytes(r.digest) for r in classes.collect()}
    auto, bits = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), near_dup.FILTER_BITS
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for near_dup.FILTER_BITS in (bits, 8):
            sets = near_dup._whole_sets(docs, classes, 5, "doc_id", "text")
            got = [bytes(r.digest) for r in sets.collect()]
            assert len(got) == len(want) == 22 and {*got} == want
        plan = sets._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan[plan.index("MapInArrow"):] and "BroadcastHashJoin" in plan
    finally:
        near_dup.FILTER_BITS = bits
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def near_copies(n, words=200):
    """One word of each differs from the others, now and then two; some are equal as sets."""
    rng = random.Random(11)
    base = [rng.choice("mnopqrstuvwxyz") * 3 + str(k) for k in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(min(i % 5, 2)):
            text[rng.randrange(words)] = f"new{i}"
        if i % 10 == 9:  # not near to all others
            for k in range(12):
                text[k * 16 + rng.randrange(3)] = f"far{i}"
        rows.append((i, " ".join(text)))
    return rows


def steps_of(monkeypatch, purpose, see):
    """What ``see`` makes of each step that is written for ``purpose``."""
    seen, plain = [], near_dup.written

    def written(df, name):
        out = plain(df, name)
        if name == purpose:
            seen.append(see(out))
        return out

    monkeypatch.setattr(near_dup, "written", written)
    return seen


def test_leaves_with_the_same_members_are_compared_once(spark, monkeypatch):
    rows = made_rows()
    seen = steps_of(monkeypatch, "leaves", lambda leaves: leaves.where("members <= 16").groupBy("node").agg(F.sort_array(F.collect_set("digest")).alias("who")).collect())
    check(spark, rows, limit=16)
    members = [tuple(map(bytes, r.who)) for r in seen[0]]
    assert len(members) == len(set(members)) > 0


def test_large_leaves_in_rounds(spark):
    check(spark, near_copies(90), limit=4)


def test_sets_of_a_large_leaf_are_not_brought_to_each_of_its_tiles(spark, monkeypatch):
    """Elements that reach the tiles of a leaf of 16 blocks or more: each set came once for each block."""
    rows = near_copies(80)

    def counted(similarity):
        def run(batches):
            for batch in batches:
                size = sum(len(x) // 8 for x in batch["shingles"].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([b"x"]), pa.array([size], pa.int64()), pa.array([b"x"])], names=["digest", "links", "root"])

        return run

    monkeypatch.setattr(near_dup, "_compare_tiles", counted)
    seen = steps_of(monkeypatch, "links", lambda found: found.agg(F.coalesce(F.sum("links"), F.lit(0))).first()[0])
    leaves = steps_of(monkeypatch, "leaves", lambda leaves: leaves.where("members > 4").count())
    links(spark.createDataFrame(rows, "doc_id bigint, text string"), limit=4).count()
    whole = leaves[0] * 196
    assert leaves[0] > 0 and sum(seen) < 8 * whole
    assert max(seen) < 3 * whole  # at once
