"""Document changes, file scans and text forms on small tables of odd rows."""

import json

import pytest
from pyspark.sql import functions as F

from leafmill.functions.attributes import attribute
from leafmill.functions.globs import UnsupportedPattern, java_regex
from leafmill.operators import mutations as mu
from leafmill.operators.filters import match_expression
from leafmill.operators.requirements import AttributeCheck, attribute_check
from leafmill.operators.tasks import apply_task
from leafmill.sources import frontmatter as fm
from leafmill.sources import store
from leafmill.streaming.events import on_workflow_completed

DOCS = "id string, status string, body string, j string, doc_refs array<struct<key:string,uuid:string,data:string>>, file_refs array<struct<key:string,filename:string,uuid:string>>"


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("attrs", F.parse_json("j")).drop("j")


def test_moves_keep_one_row_per_document(spark, tmp_path):
    path = f"{tmp_path}/store"
    store.write_store(spark.createDataFrame([("a", "inbox", 1), ("b", "inbox", 2), ("c", "done", 3)], "id string, status string, n int"), path)
    moves = spark.createDataFrame([("a", "active", 1), ("a", "done", 3), ("a", "blocked", 2), ("b", "nonsense", 1), ("x", "done", 1)], "id string, new_status string, seq int")
    store.move_status(spark, path, moves)
    assert sorted((r.id, r.status, r.n) for r in store.read_store(spark, path).collect()) == [("a", "done", 1), ("b", "inbox", 2), ("c", "done", 3)]


def test_references_keep_what_they_hold(spark):
    docs = documents(spark, [("a", "inbox", "", "{}", [("k", "u", "kept")], [("f", "x.txt", "v")]), ("b", "inbox", "", "{}", [("k", "w", None)], None)])
    changes = spark.createDataFrame([("a", 1, " new ", "n1"), ("a", 2, "new", "n2"), ("zz", 1, "k", "u")], "id string, seq int, key string, uuid string")
    data = spark.createDataFrame([("a", 1, '{"d":1}'), ("b", 1, '{"d":2}')], "id string, seq int, json string")
    done = mu.add_refs(docs, "doc_refs", changes, [F.lit(0)], data)
    assert sorted(tuple(r) for r in done.accepted.select("id", "pos", "key", "uuid", "data").collect()) == [
        ("a", 1, "k", "u", "kept"), ("a", 2, "new", "n1", None), ("a", 3, "new", "n2", '{"d":1}'), ("b", 1, "k", "w", None)]
    assert [r.id for r in done.rejects.collect()] == ["zz"]
    files = spark.createDataFrame([("b", 1, "f", "y.txt", "q")], "id string, seq int, key string, filename string, uuid string")
    got = mu.add_refs(docs, "file_refs", files, [F.lit(0)]).accepted.select("id", "pos", "key", "filename", "uuid").collect()
    assert sorted(map(tuple, got)) == [("a", 1, "f", "x.txt", "v"), ("b", 1, "f", "y.txt", "q")]


def test_new_documents_leave_the_table_whole(spark):
    docs = documents(spark, [("a", "done", "old", '{"x":1}', [("k", "u", "d")], None), ("b", "done", "stays", '{"x":1}', [("k", "u", "d")], None)])
    new = spark.createDataFrame([("a", None, "again"), (None, "active", None)], "id string, status string, body string")
    lists = spark.createDataFrame([("a", 2, "tags", "two"), ("a", 1, "tags", "one")], "id string, seq int, key string, value string")
    files = spark.createDataFrame([("a", 1, "f", "n.txt", "u")], "id string, seq int, key string, filename string, uuid string")
    out = mu.create_documents(docs, new, lists=lists, file_refs=files)
    assert set(out.columns) == set(docs.columns)
    rows = {r.id: r for r in out.withColumn("attrs", F.to_json("attrs")).collect()}
    assert len(rows) == out.count() == 3
    assert rows["b"].doc_refs[0].data == "d" and rows["a"].body == "again" and rows["a"].status == "inbox"
    assert json.loads(rows["a"].attrs) == {"tags": ["one", "two"]} and rows["a"].file_refs[0].filename == "n.txt"


def test_lists_keep_their_types_and_take_any_path(spark):
    docs = documents(spark, [("a", "inbox", "", '{"l": [1, true, {"x": null}], "o": {"p": 3}, "t": "text"}', None, None)])
    changes = spark.createDataFrame([("a", 1, "l", "new"), ("a", 2, "o.q.r", "deep"), ("a", 3, "o.p", "no"), ("a", 4, "t.u", "no"), ("a", 5, "t", "no")],
                                    "id string, seq int, path string, value string")
    done = mu.append_to_lists(docs, changes, [F.lit(0)])
    got = sorted((r.path, r.pos, r.v) for r in done.accepted.withColumn("v", F.to_json("value")).collect())
    assert got == [("l", 1, "1"), ("l", 2, "true"), ("l", 3, '{"x":null}'), ("l", 4, '"new"'), ("o.q.r", 1, '"deep"')]
    assert sorted(r.path for r in done.rejects.collect()) == ["o.p", "t", "t.u"]


def test_scan_survives_bad_files(spark, tmp_path):
    base = tmp_path / "data"
    heads = {"good one": "title: x+y", "date": "day: 2024-13-45", "nan": "score: .nan", "loop": "a: &x [*x]", "yaml": "x: [1", "list": "- 1", "status": "status: nowhere"}
    for name, head in heads.items():
        folder = base / "inbox" / name
        folder.mkdir(parents=True)
        (folder / "doc.md").write_text(f"---\n{head}\n---\nbody\n")
    docs, rejects = fm.read_documents(spark, str(base))
    assert [r.id for r in docs.collect()] == ["good one"]
    assert sorted(r.path.split("/")[-2] for r in rejects.collect()) == sorted(set(heads) - {"good one"})
    stage = base / "inbox" / "good one" / "stages" / "my+stage 1" / "2"
    stage.mkdir(parents=True)
    (stage / "stage.md").write_text("---\nscore: 1\n---\n")
    assert [(r.doc_id, r.name, r.counter) for r in fm.read_stages(spark, str(base)).collect()] == [("good one", "my+stage 1", 2)]


@pytest.mark.parametrize(("base", "uri"), [("/x/y", "/x/y"), ("file:/x", "/x"), ("file:///x", "/x"), ("s3a://b/x", "s3://b/x"), ("hdfs://h/x", "hdfs://h/x")])
def test_targets(base, uri):
    assert fm.arrow_uri(base) == uri


def test_patterns_are_those_of_python(spark):
    texts = ["é٣", "abc", "abcabc", "a\n"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern, hits in ((r"^\w+$", ["é٣", "abc", "abcabc", "a\n"]), (r"\d", ["é٣"]), ("(?P<y_1>abc)(?P=y_1)", ["abcabc"]), (r"c\Z", ["abc", "abcabc"]), ("(", []), ("a{2,1}", [])):
        check = attribute_check(docs, AttributeCheck("t", "REGEX", pattern))
        assert [r.t for r in docs.where(check).collect()] == hits, pattern
    assert java_regex("[") is None


def test_patterns_of_every_kind_find_what_python_finds(spark):
    import re

    texts = ["", "x", "xxx", "xxxx", "[a", "a", "a]", "a&b", "a&&b", "&", "ab", "b", "b\r", "\r", "a\nb", "a\n", "{", "a{b", "a{1,b}", "]", "^", "-", "\\", "é", "٣", "😀", "\x00", "\x07", "aa", "q[", "c&", "a b"]
    patterns = [r"^x{,3}$", r"^x{2,}$", r"^x{,}$", "^[[a]+$", "[]]", "[^]a]", r"[a&&b]$", "^[&]+$", "^.$", "b$", r"^a.b$", r"\Aa\Z", "a{b", "a{1,b}", "^{$", r"[\]\[]", r"[\w&]b", r"\U0001F600",
                r"[\U0001F600-\U0001F64F]", r"\07", r"\0", r"[\07]", r"(?P<g>a)(?P=g)", r"(a)\1", r"(?i)A", r"(?m)^b", r"(?s)a.b", r"\d", r"[^\d\s]$", "[-^]", "[a^]", r"a{2}", "(?:a|b)$", r"(?<!a)b", r"(?x) a \ b"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    checks = [attribute_check(docs, AttributeCheck("t", "REGEX", p)) for p in patterns]
    got = docs.select("t", F.array(*checks).alias("hits")).collect()
    for i, pattern in enumerate(patterns):
        assert [r.t for r in got if r.hits[i]] == [t for t in texts if re.search(pattern, t)], pattern
    for pattern in (r"(a)?(?(1)b|c)", r"(?a)x"):
        with pytest.raises(UnsupportedPattern):
            java_regex(pattern)


def test_numbers_print_as_in_python(spark):
    numbers = [0.0005, 12345678.5, 1e16, 1.5e-5, 0.1, -0.0001, 100.0, 1e7, 123456789012345.0, 1.25e300, -2.5e-10, float("nan"), float("inf"), -float("inf"), 0.0, 12345678.0]
    docs = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r.t for r in docs.select(attribute(docs, "x").text.alias("t")).collect()] == [str(x) for x in numbers]
    values = [0.0005, 7, True, [1, 2.5, "it's", 'a"b', None, False]]
    mixed = spark.createDataFrame([(json.dumps({"v": v}),) for v in values], "j string").select(F.parse_json("j").alias("attrs"))
    assert [r.t for r in mixed.select(attribute(mixed, "v").text.alias("t")).collect()] == [str(v) for v in values]


def test_comparisons(spark):
    docs = spark.createDataFrame([(1, 2.0), (2, 3.5), (3, None), (4, float("nan"))], "id int, x double")
    found = {e: [r.id for r in docs.where(match_expression(attribute(docs, "x"), e)).collect()]
             for e in (">2", ">= 2", "<3", "<=2", "==2.0", "!=2", "> x", "==nan", "exists", ">", "=2")}
    assert found == {">2": [2], ">= 2": [1, 2], "<3": [1], "<=2": [1], "==2.0": [1], "!=2": [2, 4], "> x": [], "==nan": [], "exists": [1, 2, 4], ">": [], "=2": []}


def test_tasks_get_what_the_columns_hold(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, n int")
    seen = apply_task(rows, "t", lambda n: {"kind": type(n).__name__, "twice": "bad" if n == 7 else n and n * 2}, ["n"], "kind string, twice int", ["id"])
    got = {r.id: (r.kind, r.twice, r.error is None) for r in seen.collect()}
    assert got == {1: ("int", 10, True), 2: ("NoneType", None, True), 3: (None, None, False)}


def test_zero_is_no_document(spark):
    events = spark.createDataFrame([("workflow.completed", "w", 0), ("workflow.completed", "w", 3), ("workflow.completed", "", 4)], "event string, workflow_id string, doc_id long")
    events = events.withColumn("seq", F.lit(1)).withColumn("ts", F.lit(1))
    assert [r.doc_id for r in on_workflow_completed(events).collect()] == [3]
