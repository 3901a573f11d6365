"""Queries: workflow fan-out and barriers, event handlers and the trigger gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import evaluate as ev
from leafmill.operators import workflow as wf
from leafmill.operators.tasks import apply_task, rule_expression
from leafmill.plans.evaluation import OPEN_DOCS, _outcomes_sql, _scope, numbered
from leafmill.plans.inputs import (
    DEFINITIONS,
    DOCS_SQL,
    NUMBERED_STAGES_SQL,
    SIGNALS_SQL,
    STAGES_SQL,
    as_signals,
    as_stages,
    ctes,
    docs,
    stages,
    table,
)
from leafmill.plans.registry import query
from leafmill.session import shared_folder
from leafmill.streaming import events as st

# -- fan-out --------------------------------------------------------------------------------

CATALOG_SQL = """catalog AS (SELECT w.name, max(p_size) AS version FROM part p JOIN (VALUES ('collect_ideas', 'ECONOMY'), ('write_draft', 'PROMO'),
  ('ship', 'SMALL'), ('send_form', 'STANDARD')) AS w(name, kind) ON w.kind = p.p_type GROUP BY w.name)"""
BRANCHES_SQL = """branches AS (SELECT * FROM (VALUES ('research', 1, 'collect_ideas'), ('draft', 1, 'write_draft'), ('draft', 2, 'check_links'),
  ('review', 1, 'peer_review'), ('signup', 1, 'send_form'), ('purchase', 1, 'invoice'), ('purchase', 2, 'ship'), ('purchase', 3, 'notify')) AS b(stage, branch_no, workflow))"""


def _catalog(spark, sf_dir):
    """Workflow versions: the greatest part size of a type is the version of the workflow named here."""
    names = {"ECONOMY": "collect_ideas", "PROMO": "write_draft", "SMALL": "ship", "STANDARD": "send_form"}
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("p_type")]
    return table(spark, sf_dir, "part").select(name.alias("name"), F.col("p_size").alias("version")).where("name IS NOT NULL")


def _starts(spark, sf_dir):
    d, s = _scope(spark, sf_dir)
    return ev.started_stages(ev.evaluate_stages(d, s, DEFINITIONS, order="seq").outcomes)


@query("fan_out_tasks", _outcomes_sql(OPEN_DOCS) + f""", {CATALOG_SQL}, {BRANCHES_SQL}
SELECT o.doc_id, b.stage, o.counter, b.branch_no, 'wrap_' || b.workflow || '_' || b.branch_no AS reference, b.workflow, coalesce(c.version, 1) AS version,
  CASE b.workflow WHEN 'collect_ideas' THEN 'corpus,web' END AS research_methods, CASE b.workflow WHEN 'write_draft' THEN 'long' END AS template,
  CAST(o.counter AS VARCHAR) AS stage_counter
FROM outcomes o JOIN branches b ON b.stage = o.definition LEFT JOIN catalog c ON c.name = b.workflow WHERE o.outcome = 'started'""")
def fan_out_tasks(spark, sf_dir):
    t = wf.fan_out(_starts(spark, sf_dir), DEFINITIONS, _catalog(spark, sf_dir))
    return t.select("doc_id", "stage", "counter", "branch_no", "reference", "workflow", "version",
                    F.col("inputs")["research_methods"].alias("research_methods"), F.col("inputs")["template"].alias("template"),
                    F.col("inputs")["stageCounter"].alias("stage_counter"))


@query("workflow_versions", f"WITH {CATALOG_SQL}" + """, names AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ship' WHEN 'O' THEN 'send_form' ELSE 'unknown' END AS name FROM orders)
SELECT o_orderkey, n.name, coalesce(version, 1) AS version FROM names n LEFT JOIN catalog c USING (name)""")
def workflow_versions(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE o_orderstatus WHEN 'F' THEN 'ship' WHEN 'O' THEN 'send_form' ELSE 'unknown' END").alias("name"))
    return wf.workflow_versions(names, _catalog(spark, sf_dir))


@query("start_requests", _outcomes_sql(OPEN_DOCS) + f""", {CATALOG_SQL}
SELECT o.doc_id, o.definition AS name, o.counter, concat_ws('-', o.doc_id, o.definition, o.counter) AS correlation_id,
  CASE o.definition WHEN 'research' THEN CASE WHEN j.idea_tag = 'blog_post_ideas' THEN 'collect_ideas:' || (SELECT version FROM catalog WHERE name = 'collect_ideas') ELSE '' END
    WHEN 'draft' THEN 'write_draft:' || (SELECT version FROM catalog WHERE name = 'write_draft') || ',check_links:1'
    WHEN 'review' THEN CASE WHEN j.priority > 0.75 THEN 'peer_review:1' ELSE '' END
    WHEN 'signup' THEN 'send_form:' || (SELECT version FROM catalog WHERE name = 'send_form')
    WHEN 'purchase' THEN 'invoice:1,ship:' || (SELECT version FROM catalog WHERE name = 'ship') || ',notify:1' END AS workflows
FROM outcomes o JOIN joined j USING (doc_id) WHERE o.outcome = 'started'""")
def start_requests(spark, sf_dir):
    r = wf.start_requests(docs(spark, sf_dir), _starts(spark, sf_dir), DEFINITIONS, _catalog(spark, sf_dir))
    flows = F.from_json("workflows", "array<struct<name:string,version:int>>")
    return r.withColumn("workflows", F.array_join(F.transform(flows, lambda w: F.concat_ws(":", w["name"], w["version"].cast("string"))), ","))


@query("correlation_id", ctes(NUMBERED_STAGES_SQL) + "SELECT stage_id, concat_ws('-', doc_id, name, counter) AS correlation_id FROM numbered")
def correlation_id(spark, sf_dir):
    return numbered(spark, sf_dir).select("stage_id", wf.correlation_id().alias("correlation_id"))


@query("start_dedup", ctes(STAGES_SQL) + """, wanted AS (SELECT DISTINCT doc_id || '-' || name || '-' || (seq % 7) AS correlation_id FROM stages WHERE status <> 'active')
SELECT correlation_id FROM wanted WHERE correlation_id NOT IN (SELECT doc_id || '-' || name || '-' || (seq % 7) FROM stages WHERE status = 'active')""")
def start_dedup(spark, sf_dir):
    s = stages(spark, sf_dir).withColumn("counter", F.col("seq") % 7).withColumn("correlation_id", wf.correlation_id())
    return wf.start_once(s.where("status <> 'active'"), s.where("status = 'active'")).select("correlation_id")


def _branch_rows(spark, sf_dir):
    """Order lines as branches of a stage instance: the line state gives the state of the branch."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit("build").alias("name"), F.lit(1).alias("counter"),
        F.concat(F.lit("wrap_b_"), "l_linenumber").alias("reference"), F.when(F.col("l_linestatus") == "F", "done").otherwise("active").alias("status"),
        F.concat_ws("/", "l_partkey", "l_suppkey").alias("output"), (F.col("l_partkey") * 100000000 + F.col("l_suppkey") * 10000 + F.col("l_quantity").cast("bigint")).alias("seq"))


@query("join_barrier", """SELECT l_orderkey AS doc_id, count(*) AS branches, count(*) FILTER (l_linestatus = 'F') AS finished, bool_and(l_linestatus = 'F') AS all_done
FROM lineitem GROUP BY l_orderkey""")
def join_barrier(spark, sf_dir):
    return wf.join_barrier(_branch_rows(spark, sf_dir), ["doc_id"])


@query("stage_completion_events", ctes(DOCS_SQL) + """, done AS (SELECT l_orderkey AS doc_id FROM lineitem GROUP BY 1 HAVING bool_and(l_linestatus = 'F'))
SELECT 'stage.completed' AS event, doc_id, 'build' AS stage_name, 1 AS counter, 'done' AS stage_status, status AS doc_status,
  concat_ws(',', lang, source, idea_tag) AS tags FROM done JOIN docs USING (doc_id)""")
def stage_completion_events(spark, sf_dir):
    barrier = wf.join_barrier(_branch_rows(spark, sf_dir), ["doc_id", "name", "counter"])
    return wf.stage_completions(barrier, docs(spark, sf_dir))


@query("collect_branch_results", """WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, arg_max(l_partkey || '/' || l_suppkey, l_partkey * 100000000 + l_suppkey * 10000 + l_quantity::BIGINT) AS o
  FROM lineitem GROUP BY ALL)
SELECT doc_id, """ + ", ".join(f"max(o) FILTER (n = {i}) AS wrap_b_{i}" for i in range(1, 8)) + " FROM b GROUP BY doc_id")
def collect_branch_results(spark, sf_dir):
    return wf.collect_branch_results(_branch_rows(spark, sf_dir), ["doc_id"], [f"wrap_b_{i}" for i in range(1, 8)])


# -- events ---------------------------------------------------------------------------------

_KIND = "CASE event_type WHEN 'view' THEN 'doc.changed' WHEN 'click' THEN 'stage.completed' ELSE 'workflow.completed' END"
_TYPE = "CASE event_type WHEN 'error' THEN 'stage_workflow' ELSE 'other' END"
_EMPTY_DOC = "CASE WHEN value < 5 THEN '' WHEN value < 10 THEN NULL ELSE props END"
EVENTS_SQL = f"""ev AS (SELECT event_id AS seq, ts, {_KIND} AS event, CAST(user_id AS VARCHAR) AS workflow_id, {_TYPE} AS workflow_type,
  CASE WHEN value > 100 THEN NULL ELSE 'gate' END AS task_ref_name, CASE WHEN value < 20 THEN NULL ELSE user_id END AS doc_id, {_EMPTY_DOC} AS doc,
  CASE WHEN value > 50 THEN 'build' END AS stage, 'changed' AS reason FROM events)"""


def _event_stream(spark, sf_dir):
    """The events table as a stream of files. Its schema comes from the table itself."""
    path = f"{sf_dir}/events*.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _as_events(e):
    return e.select(
        F.col("event_id").alias("seq"), "ts", F.expr(_KIND).alias("event"), F.col("user_id").cast("string").alias("workflow_id"), F.expr(_TYPE).alias("workflow_type"),
        F.when(F.col("value") <= 100, "gate").alias("task_ref_name"), F.when(F.col("value") >= 20, F.col("user_id")).alias("doc_id"),
        F.expr(_EMPTY_DOC).alias("doc"), F.when(F.col("value") > 50, "build").alias("stage"), F.lit("changed").alias("reason"))


def _run(spark, handled, name):
    """Run a stream to the end of its input and read what it wrote."""
    out, ck = shared_folder(spark, f"{name}-out"), shared_folder(spark, f"{name}-state")
    q = handled.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(handled.schema).parquet(out)


@query("ev_doc_changed", ctes(EVENTS_SQL) + """SELECT seq, workflow_id, task_ref_name, reason, doc FROM ev WHERE event = 'doc.changed'
  AND task_ref_name IS NOT NULL AND doc <> ''""")
def ev_doc_changed(spark, sf_dir):
    return _run(spark, st.on_doc_changed(_as_events(_event_stream(spark, sf_dir))), "doc-changed").drop("ts")


@query("ev_stage_completed", ctes(EVENTS_SQL) + """SELECT seq, workflow_id, task_ref_name, 'stage_completed' AS reason, doc, stage FROM ev WHERE event = 'stage.completed'
  AND task_ref_name IS NOT NULL AND doc <> '' AND stage IS NOT NULL""")
def ev_stage_completed(spark, sf_dir):
    return _run(spark, st.on_stage_completed(_as_events(_event_stream(spark, sf_dir))), "stage-completed").drop("ts")


@query("ev_workflow_completed", ctes(EVENTS_SQL) + "SELECT seq, doc_id, workflow_id AS triggered_by FROM ev WHERE event = 'workflow.completed' AND doc_id <> 0")
def ev_workflow_completed(spark, sf_dir):
    return _run(spark, st.on_workflow_completed(_as_events(_event_stream(spark, sf_dir))), "workflow-completed").drop("ts")


@query("ev_stage_workflow_completed", _outcomes_sql(OPEN_DOCS) + f""", {EVENTS_SQL}
SELECT doc_id, definition, outcome, reason, counter FROM outcomes
WHERE doc_id IN (SELECT doc_id FROM ev WHERE event = 'workflow.completed' AND workflow_type = 'stage_workflow' AND doc_id <> 0)""")
def ev_stage_workflow_completed(spark, sf_dir):
    triggers = st.on_stage_workflow_completed(_as_events(_event_stream(spark, sf_dir)))
    out, ck = shared_folder(spark, "evaluated"), shared_folder(spark, "evaluated-state")

    def evaluate(ids):
        session = ids.sparkSession
        d, s = _scope(session, sf_dir)
        named = d.join(ids, "doc_id", "left_semi")
        theirs = s.join(ids, "doc_id", "left_semi")  # the stages of the batch, not of the whole store
        return ev.evaluate_stages(named, theirs, DEFINITIONS, order="seq").outcomes.select("doc_id", "definition", "outcome", "reason", "counter")

    st.evaluate_on_events(triggers, evaluate, out, ck).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def _pieces(spark, sf_dir, n=3):
    """The events as a stream of several micro-batches, one file each."""
    path = shared_folder(spark, "event-files")
    table(spark, sf_dir, "events").repartition(n, F.col("event_id") % n).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("ev_stage_workflow_started", _outcomes_sql(OPEN_DOCS) + f""", {EVENTS_SQL}
SELECT doc_id, definition AS name, counter, 'active' AS status FROM outcomes WHERE outcome = 'started'
AND doc_id IN (SELECT doc_id FROM ev WHERE event = 'workflow.completed' AND workflow_type = 'stage_workflow' AND doc_id <> 0)""")
def ev_stage_workflow_started(spark, sf_dir):
    """The stages that are there after several micro-batches, many of which name the same documents."""
    triggers = st.on_stage_workflow_completed(_as_events(_pieces(spark, sf_dir)))
    out, ck = shared_folder(spark, "started"), shared_folder(spark, "started-state")
    store = st.StageStore.create(spark, shared_folder(spark, "stage-store"))

    def evaluate(ids, started):
        d, s = _scope(ids.sparkSession, sf_dir)
        stored = s.join(ids, "doc_id", "left_semi").select("doc_id", "name", "seq", "status")
        later = started.join(ids, "doc_id", "left_semi").select("doc_id", "name", (F.lit(1 << 40) + F.col("counter")).alias("seq"), "status")
        done = ev.evaluate_stages(d.join(ids, "doc_id", "left_semi"), stored.unionByName(later), DEFINITIONS, order="seq")
        return done.outcomes.select("doc_id", "definition", "outcome", "reason", "counter")

    st.evaluate_and_start(triggers, evaluate, store, out, ck).awaitTermination()
    return store.read()


_GATE_SQL = ctes(SIGNALS_SQL) + """, first AS (SELECT * FROM (SELECT *, value > 100 AS ready, row_number() OVER (PARTITION BY workflow_id ORDER BY ts, event_id) AS rn
  FROM signals WHERE value > 100 OR reason = 'cancel') WHERE rn = 1)"""


@query("trigger_gate", _GATE_SQL + "SELECT workflow_id, event_id AS seq, ready, reason, doc_id FROM first")
def trigger_gate(spark, sf_dir):
    signals = as_signals(_event_stream(spark, sf_dir)).withColumnRenamed("event_id", "seq")
    out, ck = shared_folder(spark, "gate"), shared_folder(spark, "gate-state")
    st.gate_stream(signals, F.expr("value > 100"), out, ck).awaitTermination()
    return spark.read.parquet(out).select("workflow_id", "seq", "ready", "reason", "doc_id")


@query("trigger_gate_keyed", _GATE_SQL + "SELECT workflow_id, event_id AS seq, ready, reason, doc_id FROM first")
def trigger_gate_keyed(spark, sf_dir):
    signals = as_signals(_event_stream(spark, sf_dir)).withColumnRenamed("event_id", "seq")
    out, ck = shared_folder(spark, "gate"), shared_folder(spark, "gate-state")
    st.gate_stream_keyed(signals, F.expr("value > 100"), out, ck).awaitTermination()
    return spark.read.parquet(out).select("workflow_id", "seq", "ready", "reason", "doc_id")


@query("trigger_gate_batch", _GATE_SQL + "SELECT workflow_id, event_id AS seq, ready, reason, doc_id FROM first")
def trigger_gate_batch(spark, sf_dir):
    signals = as_signals(table(spark, sf_dir, "events")).withColumnRenamed("event_id", "seq")
    return st.gate_decision(signals, F.expr("value > 100")).drop("ts")


@query("trigger_route", _GATE_SQL + """SELECT workflow_id, CASE WHEN reason = 'cancel' THEN 'failed' ELSE 'start' END AS action,
  CASE WHEN reason <> 'cancel' THEN '{"research_methods":"web","docId":"' || doc_id || '"}' END AS inputs FROM first""")
def trigger_route(spark, sf_dir):
    signals = as_signals(table(spark, sf_dir, "events")).withColumnRenamed("event_id", "seq")
    decided = st.gate_decision(signals, F.expr("value > 100"))
    return st.route(decided, {"research_methods": "web", "docId": "ignored"}).select("workflow_id", "action", "inputs")


@query("start_dedup_stream", ctes(STAGES_SQL) + """, wanted AS (SELECT DISTINCT doc_id || '-' || name || '-' || (seq % 7) AS correlation_id FROM stages WHERE status <> 'active')
SELECT correlation_id FROM wanted WHERE correlation_id NOT IN (SELECT doc_id || '-' || name || '-' || (seq % 7) FROM stages WHERE status = 'active')""")
def start_dedup_stream(spark, sf_dir):
    """Start requests of several micro-batches, most correlation ids in each of them."""
    def with_id(s):
        return s.withColumn("counter", F.col("seq") % 7).withColumn("correlation_id", wf.correlation_id())

    wanted = with_id(as_stages(_pieces(spark, sf_dir))).where("status <> 'active'").select("correlation_id", "ts")
    running = with_id(stages(spark, sf_dir)).where("status = 'active'")
    return _run(spark, st.start_once_stream(wanted, running, "3650 days"), "start-once").select("correlation_id")


# -- user functions -------------------------------------------------------------------------


@query("apply_task", """SELECT event_id, CASE WHEN value > 2 THEN CAST(floor(value) AS BIGINT) END AS whole, CASE WHEN value > 2 THEN upper(event_type) END AS label,
  CASE WHEN value <= 2 THEN 'measure failed: too small' END AS error FROM events""")
def apply_task_query(spark, sf_dir):
    def measure(value: float, event_type: str) -> dict:
        if value <= 2:
            raise ValueError("too small")
        return {"whole": int(value), "label": event_type.upper()}

    rows = table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    done = apply_task(rows, "measure", measure, ["value", "event_type"], "whole bigint, label string", keep=["event_id"])
    return done.select("event_id", "whole", "label", "error")


@query("rule_expr", ctes(DOCS_SQL) + "SELECT id, coalesce(status = 'active' AND priority > 0.3 AND idea_tag = 'blog_post_ideas', false) AS ok, false AS broken FROM docs")
def rule_expr(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select(
        "id", rule_expression(d, "status = 'active' AND priority > 0.3 AND array_contains(tags, 'blog_post_ideas')").alias("ok"),
        rule_expression(d, "no_such_column = 1").alias("broken"))
