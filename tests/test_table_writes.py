"""Lists, references and new documents written into the table."""

import json
import os

import pytest
from pyspark.sql import functions as F

from leafmill.functions.attributes import dotted_path, variant_path
from leafmill.functions.variants import get_at, is_open, set_at
from leafmill.operators import mutations as mu
from leafmill.operators.filters import list_documents
from leafmill.sources import store
from tests.test_changes import documents

LISTS = "id string, seq int, path string, value string"


def attrs_of(df):
    return {r.id: json.loads(r.j) for r in df.select("id", F.to_json("attrs").alias("j")).collect()}


def rejected(change, *columns):
    return sorted(tuple(r) for r in change.rejects.select(*columns, "error").collect())


@pytest.mark.parametrize(("path", "found", "open_", "after"), [
    (["a", "b"], 1, True, {"a": {"b": 9}, "l": [1], "n": None}), (["a", "c", "d"], None, True, {"a": {"b": 1, "c": {"d": 9}}, "l": [1], "n": None}),
    (["l"], [1], True, {"a": {"b": 1}, "l": 9, "n": None}), (["l", "x"], None, False, {"a": {"b": 1}, "l": {"x": 9}, "n": None}),
    (["n", "x"], None, False, {"a": {"b": 1}, "l": [1], "n": {"x": 9}}), (["it's \"x\".y"], None, True, {"a": {"b": 1}, "it's \"x\".y": 9, "l": [1], "n": None})])
def test_paths(spark, path, found, open_, after):
    v, parts = F.parse_json(F.lit('{"a":{"b":1},"l":[1],"n":null}')), F.array(*map(F.lit, path))
    row = spark.range(1).select(F.to_json(get_at(v, parts)).alias("g"), is_open(v, parts).alias("o"), F.to_json(set_at(v, parts, F.lit(9).cast("variant"))).alias("s")).first()
    assert (row.g and json.loads(row.g), row.o, json.loads(row.s)) == (found, open_, after)


def test_lists_are_written_in_place(spark):
    docs = documents(spark, [("a", "inbox", "", '{"l":[1,{"x":null}],"o":{"p":3,"k":true},"t":"text"}', None, None), ("b", "inbox", "", '{"z":1}', None, None), ("c", "done", "", "{}", None, None)])
    changes = spark.createDataFrame(
        [("a", 2, "l", "two"), ("a", 1, "l", "one"), ("a", 3, "o.q.r", "deep"), ("a", 4, "o.p", "no"), ("a", 5, "t.u", "no"), ("a", 6, "t", "no"),
         ("b", 1, "it's.\"q\"", "quoted"), ("b", 2, "n.m", "first"), ("b", 3, "n", "late"), ("b", 4, "n.m.x", "late"), ("zz", 1, "l", "lost"), (None, 1, "l", "lost")], LISTS)
    done = mu.write_lists(docs, changes)
    assert done.accepted.columns == docs.columns
    assert attrs_of(done.accepted) == {
        "a": {"l": [1, {"x": None}, "one", "two"], "o": {"p": 3, "k": True, "q": {"r": ["deep"]}}, "t": "text"},
        "b": {"z": 1, "it's": {'"q"': ["quoted"]}, "n": {"m": ["first"]}}, "c": {}}
    lost = done.rejects.select(F.coalesce("id", F.lit("")).alias("id"), "seq", "path", "error").collect()
    assert sorted(map(tuple, lost)) == [
        ("", 1, "l", "Document not found"), ("a", 4, "o.p", "o.p is not a list."), ("a", 5, "t.u", "t.u is not a list."), ("a", 6, "t", "t is not a list."),
        ("b", 3, "n", "n is not a list."), ("b", 4, "n.m.x", "n.m.x is not a list."), ("zz", 1, "l", "Document not found")]


def test_items_of_any_type_and_many_of_them(spark):
    docs = documents(spark, [("a", "inbox", "", "{}", None, None)])
    typed = spark.createDataFrame([("a", i, "l", json.dumps(v)) for i, v in enumerate([1, True, None, {"x": [1]}, "s", 2.5])], LISTS).withColumn("value", F.parse_json("value"))
    assert attrs_of(mu.write_lists(docs, typed).accepted) == {"a": {"l": [1, True, None, {"x": [1]}, "s", 2.5]}}
    many = spark.range(5000).select(F.lit("a").alias("id"), F.col("id").alias("seq"), F.lit("deep.list").alias("path"), F.col("id").cast("string").alias("value"))
    assert attrs_of(mu.write_lists(docs, many).accepted) == {"a": {"deep": {"list": [str(i) for i in range(5000)]}}}


def test_a_quote_in_a_path_is_no_end(spark):
    docs = documents(spark, [("a", "inbox", "", '{"it\'s":{"x":5},"q\\"q":{"x":5}}', None, None)])
    assert list_documents(docs, ["it's.x=5"]).count() == 1
    assert list_documents(docs, ["it's.x=6"]).count() == 0
    for path in (variant_path, dotted_path):
        with pytest.raises(ValueError, match="not both"):
            path("a'\"b")
    changes = spark.createDataFrame([("a", 1, "it's.y", "one")], LISTS)
    assert [r.path for r in mu.append_to_lists(docs, changes, [F.lit(0)]).accepted.collect()] == ["it's.y"]


def refs_of(df, name):
    json_of = F.transform(name, lambda r: F.to_json(r)) if name in df.columns else F.lit(None)
    return {r.id: [json.loads(x) for x in r.refs or []] for r in df.select("id", json_of.alias("refs")).collect()}


def test_references_are_written_in_place(spark):
    docs = documents(spark, [("a", "inbox", "", "{}", [("k", "u", '"kept"')], [("f", "x.txt", "v")]), ("b", "inbox", "", "{}", None, None), ("c", "inbox", "", "{}", None, None)])
    changes = spark.createDataFrame([("a", 2, "second", " n2 "), ("a", 1, " first ", "n1"), ("b", 1, "k", "w"), ("zz", 1, "k", "u")], "id string, seq int, key string, uuid string")
    data = spark.createDataFrame([("a", 1, '{"d":1}'), ("a", 2, '{"d": [2]}'), ("a", 3, "{bad"), ("b", 1, ""), ("c", 1, "{bad"), ("yy", 1, "{}")], "id string, seq int, json string")
    done = mu.write_refs(docs, "doc_refs", changes, data)
    assert done.accepted.columns == docs.columns
    assert refs_of(done.accepted, "doc_refs") == {
        "a": [{"key": "k", "uuid": "u", "data": '"kept"'}, {"key": "first", "uuid": "n1"}, {"key": "second", "uuid": "n2", "data": '{"d":[2]}'}],
        "b": [{"key": "k", "uuid": "w", "data": "{}"}], "c": []}
    assert rejected(done, "id", "seq") == [("a", 3, "invalid JSON"), ("yy", 1, "Document not found"), ("zz", 1, "Document not found")]
    files = spark.createDataFrame([("b", 1, "f", "y.txt", "q")], "id string, seq int, key string, filename string, uuid string")
    done = mu.write_refs(docs, "file_refs", files, data)
    assert refs_of(done.accepted, "file_refs") == {
        "a": [{"key": "f", "filename": "x.txt", "uuid": "v"}], "b": [{"key": "f", "filename": "y.txt", "uuid": "q", "data": {}}], "c": []}
    none = "file data without an added file"
    assert rejected(done, "id", "seq") == [("a", 1, none), ("a", 2, none), ("a", 3, none), ("c", 1, none), ("yy", 1, "Document not found")]
    assert refs_of(mu.write_refs(docs, "file_refs", files).accepted, "file_refs")["b"] == [{"key": "f", "filename": "y.txt", "uuid": "q"}]


def test_create_nests_and_rejects(spark):
    docs = documents(spark, [("old", "done", "kept", '{"x":1}', [("k", "u", "d")], None), ("a", "done", "goes", "{}", None, None)])
    new = spark.createDataFrame([("a", None, "one", 1), ("a", "active", "two", 3), ("a", "blocked", "zzz", 2), ("b", None, None, 1)], "id string, status string, body string, seq int")
    attrs = "id string, seq int, key string, value string"
    sets = spark.createDataFrame([("a", 1, "flat.key", "v"), ("a", 2, "t", "text"), ("nobody", 1, "t", "x")], attrs)
    lists = spark.createDataFrame([("a", 2, "meta.tags", "y"), ("a", 1, "meta.tags", "x"), ("a", 3, "t.u", "no"), ("b", 1, "top", "z")], attrs)
    jsons = spark.createDataFrame([("a", 1, "n", "[1, 2]"), ("a", 2, "bad", "{bad"), ("b", 1, "top", "5")], "id string, seq int, key string, json string")
    files = spark.createDataFrame([("b", 1, "f", "y.txt", "q")], "id string, seq int, key string, filename string, uuid string")
    data = spark.createDataFrame([("b", 1, '{"k":1}'), ("a", 1, "{}")], "id string, seq int, json string")
    done = mu.create(docs, new, sets, jsons, lists, file_refs=files, file_data=data)
    assert attrs_of(done.accepted) == {"old": {"x": 1}, "a": {"flat.key": "v", "t": "text", "meta": {"tags": ["x", "y"]}, "n": [1, 2]}, "b": {"top": 5}}
    assert {r.id: (r.status, r.body) for r in done.accepted.collect()} == {"old": ("done", "kept"), "a": ("active", "two"), "b": ("inbox", "")}
    assert refs_of(done.accepted, "file_refs")["b"] == [{"key": "f", "filename": "y.txt", "uuid": "q", "data": {"k": 1}}]
    assert refs_of(done.accepted, "doc_refs")["old"] == [{"key": "k", "uuid": "u", "data": "d"}]
    assert rejected(done, "id", "seq", "part") == [
        ("a", 1, "file_refs", "file data without an added file"), ("a", 2, "json", "invalid JSON"), ("a", 3, "list", "t.u is not a list."), ("nobody", 1, "set", "Document not found")]


def test_empty_batches(spark):
    docs = documents(spark, [("a", "inbox", "", '{"x":1}', None, None)])
    none = spark.createDataFrame([], LISTS)
    assert attrs_of(mu.write_lists(docs, none).accepted) == {"a": {"x": 1}}
    refs = spark.createDataFrame([], "id string, seq int, key string, uuid string")
    done = mu.write_refs(docs, "doc_refs", refs)
    assert done.accepted.count() == 1 and done.rejects.count() == 0


def files_of(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_one_move_of_a_million_rewrites_two_folders(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_store(spark.range(1_000_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "inbox").otherwise("done").alias("status"), F.col("id").alias("n")), path)
    before = files_of(path)
    assert len(before) == 2 * store.BUCKETS
    assert store.move_status(spark, path, spark.createDataFrame([("4", "done")], "id string, new_status string")) == ["done", "inbox"]
    after = files_of(path)
    changed = {os.path.dirname(f) for f, _ in set(before.items()) ^ set(after.items())}
    assert len(changed) == 2 and {os.path.basename(os.path.dirname(d)) for d in changed} == {"status=done", "status=inbox"}
    rows = store.read_store(spark, path)
    assert rows.count() == 1_000_000 and rows.where("id = '4'").collect()[0].status == "done"
    assert rows.agg(F.sum("n")).first()[0] == 499_999_500_000


def test_a_save_writes_what_changed(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = documents(spark, [(str(i), "inbox" if i < 6 else "done", f"text {i}", f'{{"n":{i}}}', None, None) for i in range(8)]).select("id", "status", "body", "attrs")
    store.write_store(docs, path, buckets=4)
    before = files_of(path)
    assert store.save_changed(spark, path, docs) == [] and files_of(path) == before
    new = store.read_store(spark, path).withColumn("body", F.when(F.col("id") == "7", "changed").otherwise(F.col("body")))
    new = new.withColumn("status", F.when(F.col("status") == "inbox", "active").otherwise(F.col("status")))
    touched = store.save_changed(spark, path, new)
    assert {s for s, _ in touched} == {"inbox", "active", "done"} and sum(s == "done" for s, _ in touched) == 1
    want = {str(i): ("active" if i < 6 else "done", "changed" if i == 7 else f"text {i}", f'{{"n":{i}}}') for i in range(8)}
    rows = store.read_store(spark, path).select("id", "status", "body", F.to_json("attrs").alias("j")).collect()
    assert len(rows) == 8 and {r.id: (r.status, r.body, r.j) for r in rows} == want  # the inbox is empty now
    more = documents(spark, [("9", "inbox", "new", "{}", None, None), (None, "inbox", "no id", "{}", None, None)]).select("id", "status", "body", "attrs")
    store.save(spark, path, more, gone=spark.createDataFrame([("0",), ("nobody",)], "id string"))
    assert sorted(r.id for r in store.read_store(spark, path).collect()) == [str(i) for i in (1, 2, 3, 4, 5, 6, 7, 9)]
