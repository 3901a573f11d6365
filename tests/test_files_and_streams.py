"""Files on disk, the partitioned store, streams in several micro-batches, text and tasks."""

import os

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import drafts as dr
from leafmill.operators import evaluate as ev
from leafmill.operators import keywords as kw
from leafmill.operators.requirements import Requirements, StageDefinition
from leafmill.operators.tasks import apply_task
from leafmill.sources import frontmatter as fm
from leafmill.sources import store as st
from leafmill.streaming import events as se


def put(base, path, text):
    target = base / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")


def test_document_scan(spark, tmp_path):
    put(tmp_path, "inbox/a/doc.md", "---\nid: a\nstatus: inbox\ntitle: \"Ä: b\"\nmeta: {owner: x}\n_persisted: true\n_doc_refs:\n- {key: k, uuid: u, data: {n: 1}}\n---\nBody\n---\nmore\n")
    put(tmp_path, "done/b/doc.md", "no header at all\n")
    put(tmp_path, "done/c/doc.md", "---\nid: c\nstatus: wrong\n---\n")
    put(tmp_path, "done/d/doc.md", "---\nid: [c\n---\nx\n")
    put(tmp_path, "done/e/doc.md", "---\n- a list\n---\nx\n")
    put(tmp_path, "done/b/stages/review/1/stage.md", "---\nname: other\ncounter: 7\nstatus: done\n---\nS\n")
    put(tmp_path, "done/b/stages/review/x1/stage.md", "---\nstatus: done\n---\nS\n")
    put(tmp_path, "done/b/stages/review/2/stage.md", "---\nstatus: [\n---\nS\n")
    put(tmp_path, "done/b/plan.pdf", "12345")
    put(tmp_path, "done/b/stages/review/1/out.md", "123")
    good, bad = fm.read_documents(spark, str(tmp_path))
    rows = {r.id: r for r in good.withColumn("attrs", F.to_json("attrs")).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].attrs == '{"meta":{"owner":"x"},"title":"Ä: b"}'
    assert rows["a"].body == "Body\n---\nmore\n" and rows["a"].doc_refs[0].uuid == "u"
    assert rows["b"].body == "no header at all\n" and rows["b"].status == "inbox" and rows["b"].folder_status == "done"
    assert sorted(r.error for r in bad.collect()) == ["bad frontmatter", "bad frontmatter", "bad status"]
    stages = fm.read_stages(spark, str(tmp_path)).collect()
    assert [(s.doc_id, s.name, s.counter, s.status) for s in stages] == [("b", "review", 1, "done")]
    files = fm.attachments(spark, str(tmp_path)).collect()
    assert sorted((f.doc_id, f.stage, f.counter, f.filename, f.length) for f in files if f.stage) == [("b", "review", 1, "out.md", 3)]
    assert [(f.doc_id, f.filename, f.length) for f in files if not f.stage] == [("b", "plan.pdf", 5)]
    assert fm.read_documents(spark, str(tmp_path), ("inbox",))[0].count() == 1


def test_status_moves(spark, tmp_path):
    path = str(tmp_path / "store")
    st.write_store(spark.createDataFrame([("a", "inbox", 1), ("b", "active", 2), ("c", "done", 3)], "id string, status string, n long"), path)
    done_files = set(os.listdir(f"{path}/status=done"))
    moved = spark.createDataFrame([("a", "active"), ("b", "active"), ("zzz", "done")], "id string, new_status string")
    assert st.move_status(spark, path, moved) == ["active", "inbox"]
    assert sorted(tuple(r) for r in st.read_store(spark, path).select("id", "status", "n").collect()) == [("a", "active", 1), ("b", "active", 2), ("c", "done", 3)]
    assert set(os.listdir(f"{path}/status=done")) == done_files
    assert st.move_status(spark, path, moved) == []
    plan = st.read_store(spark, path).where("status = 'done'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan


def signal_files(spark, tmp_path, batches):
    src = str(tmp_path / "signals")
    schema = "workflow_id string, ts long, seq long, reason string, doc_id long, value long"
    seen = set()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        for f in set(os.listdir(src)) - seen:  # file streams read in order of modification time
            os.utime(f"{src}/{f}", (1000 + i, 1000 + i))
            seen.add(f)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_gate_opens_once(spark, tmp_path):
    batches = [
        [("a", 1, 1, "ready", 1, 5), ("b", 2, 2, "ready", 2, 500), ("b", 1, 9, "ready", 2, 600), ("c", 3, 3, None, 3, 5)],
        [("a", 4, 4, "cancel", 1, 5), ("b", 0, 5, "cancel", 2, 900), ("c", 6, 6, None, 3, 101)],
        [("a", 7, 7, "ready", 1, 900), ("d", 8, 8, "ready", 4, 100)],
    ]
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    stream = signal_files(spark, tmp_path, batches)
    query = se.gate_stream(stream, F.expr("value > 100"), out, ck)
    query.awaitTermination()
    rows = sorted((r.workflow_id, r.seq, r.ready, r.reason) for r in spark.read.parquet(out).collect())
    assert rows == [("a", 4, False, "cancel"), ("b", 9, True, "ready"), ("c", 6, True, "ready")]
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) == 3


GATE_BATCHES = [
    [("a", 1, 1, "ready", 1, 5), ("b", 2, 2, "ready", 2, 500), ("b", 1, 9, "ready", 2, 600), ("c", 3, 3, None, 3, 5)],
    [("a", 4, 4, "cancel", 1, 5), ("b", 0, 5, "cancel", 2, 900), ("c", 6, 6, None, 3, 101)],
    [("a", 7, 7, "ready", 1, 900), ("d", 8, 8, "ready", 4, 100)],
]


def test_keyed_gate_opens_once(spark, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    se.gate_stream_keyed(signal_files(spark, tmp_path, GATE_BATCHES), F.expr("value > 100"), out, ck).awaitTermination()
    rows = sorted((r.workflow_id, r.seq, r.ready, r.reason) for r in spark.read.parquet(out).collect())
    assert rows == [("a", 4, False, "cancel"), ("b", 9, True, "ready"), ("c", 6, True, "ready")]


def test_an_open_gate_is_forgotten_after_its_time(spark, tmp_path):
    day = 86_400
    batches = [
        [("a", 0, 1, "ready", 1, 500), ("b", 0, 2, "ready", 2, 500), ("c", 0, 3, "ready", 3, 5)],
        [("a", day // 2, 4, "ready", 1, 500), ("x", 3 * day, 5, "ready", 9, 500)],  # a is still open; the watermark passes its end
        [("x", 3 * day + 1, 6, "ready", 9, 500)],
        [("a", 3 * day + 2, 7, "ready", 1, 500), ("b", 3 * day + 2, 8, "ready", 2, 5)],  # a opens again, b has no opening signal
        [("a", 3 * day + 3, 9, "ready", 1, 500), ("x", 3 * day + 3, 10, "ready", 9, 500)],
    ]
    signals = signal_files(spark, tmp_path, batches).withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_000_000_000))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    se.gate_stream_keyed(signals, F.expr("value > 100"), out, ck, ttl="1 day").awaitTermination()
    assert sorted((r.workflow_id, r.seq) for r in spark.read.parquet(out).collect()) == [("a", 1), ("a", 7), ("b", 2), ("x", 5)]
    out, ck = str(tmp_path / "out2"), str(tmp_path / "ck2")
    se.gate_stream_keyed(signals, F.expr("value > 100"), out, ck).awaitTermination()
    assert sorted((r.workflow_id, r.seq) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2), ("x", 5)]


def test_requests_on_a_stream_start_once(spark, tmp_path):
    batches = [[("a", 1, 1, "", 1, 0), ("a", 2, 2, "", 1, 0), ("b", 1, 3, "", 1, 0)], [("a", 3, 4, "", 1, 0), ("c", 4, 5, "", 1, 0)], [("b", 5, 6, "", 1, 0), ("r", 5, 7, "", 1, 0)]]
    requests = signal_files(spark, tmp_path, batches).select(F.col("workflow_id").alias("correlation_id"), F.timestamp_seconds("ts").alias("ts"))
    running = spark.createDataFrame([("r",), ("r",)], "correlation_id string")
    out = str(tmp_path / "out")
    once = se.start_once_stream(requests, running, "1 hour")
    once.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.correlation_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("snapshot", [1, 2, 50])
def test_a_stage_starts_once_over_batches(spark, tmp_path, snapshot):
    """Five batches name the same document; the first starts its stages, and a replayed batch leaves the same."""
    batches = [[("a", i, i, "", 1, 0), ("b", i, 10 + i, "", 2 if i == 3 else 1, 0)] for i in range(5)]
    triggers = signal_files(spark, tmp_path, batches).select("doc_id")
    docs = spark.createDataFrame([(1, "inbox"), (2, "inbox")], "doc_id long, status string")
    stages = spark.createDataFrame([(1, "again", 1, "done")], "doc_id long, name string, counter long, status string")
    defs = [StageDefinition("first"), StageDefinition("second", requirements=Requirements(stages={"first": "active"})), StageDefinition("again", multiple_callable=True)]
    store = se.StageStore.create(spark, str(tmp_path / "store"), snapshot=snapshot)
    calls = []

    def evaluate(ids, started):
        calls.append(sorted((r.doc_id, r.name) for r in started.collect()))
        named = docs.join(ids, "doc_id", "left_semi")
        return ev.evaluate_stages(named, stages.unionByName(started), defs, allow_rerun=True).outcomes

    out = str(tmp_path / "out")
    se.evaluate_and_start(triggers, evaluate, store, out, str(tmp_path / "ck")).awaitTermination()
    want = [(1, "again", 2), (1, "first", 1), (1, "second", 1), (2, "again", 1), (2, "first", 1), (2, "second", 1)]
    assert sorted((r.doc_id, r.name, r.counter) for r in store.read().collect()) == want
    assert [len(c) for c in calls] == [0, 3, 3, 3, 6]
    # the batch that started document 2 runs again, after later ones
    assert sorted((r.doc_id, r.name) for r in store.before(3).collect()) == calls[3]
    store.write(ev.started_stages(evaluate(spark.createDataFrame([(1,), (2,)], "doc_id long"), store.before(3))), 3)
    assert sorted((r.doc_id, r.name, r.counter) for r in store.read().collect()) == want


def test_route(spark):
    d = spark.createDataFrame([("a", "cancel", 1), ("b", "ready", 2)], "workflow_id string, reason string, doc_id long")
    rows = {r.workflow_id: r for r in se.route(d, {"docId": "x", "m": "y"}).collect()}
    assert (rows["a"].action, rows["a"].inputs) == ("failed", None)
    assert (rows["b"].action, rows["b"].inputs) == ("start", '{"m":"y","docId":"2"}')


def test_evaluation_of_an_unknown_stage(spark):
    docs = spark.createDataFrame([(1, "inbox")], "doc_id long, status string")
    stages = spark.createDataFrame([], "doc_id long, name string, counter long, status string")
    with pytest.raises(ev.UnknownStage):
        ev.evaluate_stages(docs, stages, [StageDefinition("a")], stage="b")
    with pytest.raises(ev.UnknownStage):
        ev.evaluate_stages(docs, stages, [StageDefinition("a", active=False)])


def test_evaluation_order_and_rerun(spark):
    docs = spark.createDataFrame([(1, "inbox"), (2, "done"), (3, "inbox")], "doc_id long, status string")
    stages = spark.createDataFrame([(1, "b", 1, "done"), (1, "b", 2, "blocked"), (2, "b", 1, "scheduled"), (2, "b", 2, "active")],
                                   "doc_id long, name string, counter long, status string")
    defs = [StageDefinition("a", requirements=Requirements(stages={"b": "active"})), StageDefinition("b", multiple_callable=True)]

    def run(**options):
        done = ev.evaluate_stages(docs, stages, defs, **options)
        return {(r.doc_id, r["pass"], r.definition): (r.outcome, r.reason, r.counter) for r in done.outcomes.collect()}, {
            r.doc_id: (r.status, r.status_changed) for r in done.documents.collect()}

    got, after = run(allow_rerun=True, passes=2)
    assert got[(1, 1, "a")] == ("skipped", "requirements not met", None)
    assert got[(1, 1, "b")] == ("started", None, 3)
    assert got[(1, 2, "a")] == ("started", None, 1)
    assert got[(1, 2, "b")] == ("skipped", "already has active stage (status: active)", None)
    assert got[(2, 1, "b")] == ("skipped", "already has active stage (status: scheduled)", None)
    assert (2, 2, "a") not in got
    assert got[(3, 1, "b")] == ("started", None, 1)
    assert after == {1: ("active", True), 2: ("done", False), 3: ("active", True)}
    got, _ = run()
    assert got[(1, 1, "b")] == ("skipped", "already exists (use --allow-rerun to rerun completed stages)", None)


def test_prompts(spark):
    d = spark.createDataFrame([("a", None)], "x string, y string")
    assert d.select(tx.render_prompt("{{{x}}} {x}{x}", {"x": F.col("x")})).first()[0] == "{a} aa"
    assert d.select(tx.render_prompt("{y}", {"y": F.col("y")})).first()[0] is None
    with pytest.raises(ValueError):
        tx.render_prompt("{z}", {"x": F.col("x")})


@pytest.mark.parametrize("text,kind", [
    ("12", "number"), ("007", "text"), ("1_000", "number"), ("-1.5e3", "number"), ("True", "boolean"), ("NULL", "null"), ("None", "null"), ("[1, 'a']", "list"),
    ("{'a': 1}", "object"), ("'x'", "string"), ("x y", "text"), ("", "text")])
def test_literals(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(tx.literal_kind(F.col("t"))).first()[0] == kind


def test_keywords_against_brute_force(spark):
    import math
    import re

    texts = {1: "Big data big Data engines, the data", 2: "engines run; data stays", 3: "", 4: "a I x"}
    grams = {}
    for k, t in texts.items():
        words = [w for w in re.findall(r"\w{2,}", t.lower()) if w not in kw.STOP_WORDS]
        grams[k] = words + [" ".join(p) for p in zip(words, words[1:])]
    want = {}
    for k, terms in grams.items():
        for t in set(terms):
            df = sum(t in g for g in grams.values())
            want[(k, t)] = round(terms.count(t) / len(terms) * (math.log((1 + 4) / (1 + df)) + 1), 9)
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {(r.id, r.term): r.score for r in kw.score_candidates(docs, "id", "text").collect()}
    assert got == pytest.approx(want) and set(got) == set(want)
    # the terms that are left out cannot be among the best
    long = {k: " ".join(["common"] * (40 if k < 5 else 0) + [f"w{i}" for i in range(k * 7) for _ in range(i % 13 + 1)]) for k in range(12)}
    docs = spark.createDataFrame(list(long.items()), "id long, text string")
    whole, part = kw.score_candidates(docs, "id", "text"), kw.score_candidates(docs, "id", "text", best=4)
    assert part.count() < whole.count()
    assert sorted(map(tuple, kw.top_keywords(whole, "id", 4).collect())) == sorted(map(tuple, kw.top_keywords(part, "id", 4).collect()))


def test_titles_of_many_results(spark):
    titles = {1: ["A x"] * 2500 + ["B y"] * 700, 2: ["none"], 3: ["A", "A and B"], 4: [None, "B", "A"]}
    rows = [(k, no, t) for k, ts in titles.items() for no, t in enumerate(ts)]
    findings = spark.createDataFrame(rows, "doc_id long, no long, title string")
    got = {r.doc_id: r.title for r in dr.title_rule(findings, ("A", "B"), "both", "<{}>", "default", [F.expr("no DIV 100")]).collect()}
    assert got == {1: "<" + " vs. ".join(["A"] * 2500 + ["B"] * 700) + ">", 2: "default", 3: "both", 4: "<B vs. A>"}
    pieces = dr.title_pieces(findings, ("A", "B"), [F.expr("no DIV 100")])
    assert pieces.where("doc_id = 1").count() == 4


def test_highlight(spark):
    d = spark.createDataFrame([("The den, DEN; garden étude den", ["den", "étude den"])], "t string, k array<string>")
    assert d.select(kw.highlight(F.col("t"), F.col("k"))).first()[0] == "The **den**, **DEN**; garden **étude den**"


def test_task_errors_stay_in_their_row(spark):
    d = spark.createDataFrame([(1, 2), (2, 0)], "id long, n long")
    rows = apply_task(d, "divide", lambda n: {"q": 10 // n}, ["n"], "q bigint", keep=["id"]).collect()
    assert {(r.id, r.q) for r in rows} == {(1, 5), (2, None)}
    assert [r.error for r in rows if r.id == 2][0].startswith("divide failed")
