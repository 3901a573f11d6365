"""Queries: requirements, stage evaluation, counters and the stage life cycle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from leafmill.operators import evaluate as ev
from leafmill.operators import requirements as req
from leafmill.operators.requirements import AttributeCheck, ListCheck, Requirements, StageDefinition
from leafmill.operators.ranking import running_number
from leafmill.plans.inputs import (
    DEFINITIONS,
    DOCS_SQL,
    FILE_REFS_SQL,
    NUMBERED_STAGES_SQL,
    STAGES_SQL,
    ctes,
    docs,
    stages,
    table,
)
from leafmill.plans.registry import query

D = ctes(DOCS_SQL)
OPEN_DOCS = "status IN ('inbox', 'active')"

# What an evaluation of every definition, in order, must give for each document.
SUMMARY_SQL = """state AS (
  SELECT doc_id,
    count(*) FILTER (name = 'signup') AS n_signup, count(*) FILTER (name = 'purchase') AS n_purchase,
    arg_min(status, seq) FILTER (name = 'signup' AND status IN ('scheduled', 'active')) AS run_signup,
    arg_min(status, seq) FILTER (name = 'purchase' AND status IN ('scheduled', 'active')) AS run_purchase,
    bool_or(name = 'signup' AND status = 'done') AS signup_done,
    count(*) AS n_stages
  FROM stages GROUP BY doc_id),
joined AS (
  SELECT d.*, coalesce(n_signup, 0) AS n_signup, coalesce(n_purchase, 0) AS n_purchase, run_signup, run_purchase,
         coalesce(signup_done, false) AS signup_done, coalesce(n_stages, 0) AS n_stages,
         idea_tag IS NOT NULL AS met_research,
         priority > 0.5 AND lang = 'en' AND NOT regexp_matches(title, '^The') AS met_review,
         doc_id % 4 >= 1 AS met_signup
  FROM docs d LEFT JOIN state s USING (doc_id))"""


def _outcomes_sql(scope: str, allow_rerun: bool = False) -> str:
    if allow_rerun:
        signup_exists = "'not marked as multiple_callable in stage definition'"
        purchase_exists = "NULL"
    else:
        signup_exists = "'already exists'"
        purchase_exists = "'already exists (use --allow-rerun to rerun completed stages)'"
    rows = {
        "core": ("'no_eval'", "false", 0),
        "research": ("NULL", "met_research", 0),
        "draft": ("NULL", "met_research", 0),
        "review": ("NULL", "met_review", 0),
        "signup": (f"""CASE WHEN run_signup IS NOT NULL THEN concat('already has active stage (status: ', run_signup, ')')
                       WHEN n_signup > 0 THEN {signup_exists} END""", "met_signup", "n_signup"),
        "purchase": (f"""CASE WHEN run_purchase IS NOT NULL THEN concat('already has active stage (status: ', run_purchase, ')')
                         WHEN n_purchase > 0 THEN {purchase_exists} END""", "signup_done", "n_purchase"),
        "publish": ("NULL", "false", 0),
    }
    selects = [
        f"SELECT doc_id, '{name}' AS definition, {blocked} AS blocked, {met} AS met, {n} AS n FROM joined WHERE {scope}"
        for name, (blocked, met, n) in rows.items()
    ]
    return ctes(DOCS_SQL, STAGES_SQL, SUMMARY_SQL, f"decided AS ({' UNION ALL '.join(selects)})", """outcomes AS (
  SELECT doc_id, definition, CASE WHEN blocked IS NULL AND met THEN 'started' ELSE 'skipped' END AS outcome,
         CASE WHEN blocked IS NULL AND met THEN NULL ELSE coalesce(blocked, 'requirements not met') END AS reason,
         blocked IS NULL AS checked, CASE WHEN blocked IS NULL AND met THEN n + 1 END::BIGINT AS counter
  FROM decided)""")


def _scope(spark, sf_dir):
    # ``seq`` orders the instances of a name; the queries that need the counter compute it.
    return ev.evaluation_guard(docs(spark, sf_dir)), stages(spark, sf_dir)


# -- requirements ---------------------------------------------------------------------------

_COUNTS = {">=": 1, "==": 1, ">": 1, "<=": 1, "<": 1, "!=": 1}


@query("file_presence", ctes(DOCS_SQL, FILE_REFS_SQL, """counts AS (
  SELECT d.id, count(f.key) AS n FROM docs d LEFT JOIN file_refs f ON f.doc_id = d.doc_id AND f.key = 'upload_file' GROUP BY d.id)""")
    + "\nUNION ALL ".join(f"SELECT '{op}' AS test, id FROM counts WHERE n {op.replace('==', '=').replace('!=', '<>')} 1" for op in _COUNTS)
    + " UNION ALL SELECT 'unknown', id FROM counts")
def file_presence(spark, sf_dir):
    d = docs(spark, sf_dir)
    tests = {op: req.FilePresence("upload_file", n, op) for op, n in _COUNTS.items()}
    tests["unknown"] = req.FilePresence("upload_file", 1, "~")
    hits = [F.when(req.file_presence(c), F.lit(t)) for t, c in tests.items()]
    return d.select(F.explode(F.array_compact(F.array(*hits))).alias("test"), "id")


@query("stage_requirement", ctes(DOCS_SQL, STAGES_SQL) + """SELECT id FROM docs d
WHERE EXISTS (SELECT 1 FROM stages s WHERE s.doc_id = d.doc_id AND name = 'signup' AND status = 'done')
  AND EXISTS (SELECT 1 FROM stages s WHERE s.doc_id = d.doc_id AND name = 'purchase' AND status = 'active')""")
def stage_requirement(spark, sf_dir):
    return req.stage_requirement(docs(spark, sf_dir), stages(spark, sf_dir), {"signup": "done", "purchase": "active"}).select("id")


@query("extras_gate", D + """SELECT 'all_there' AS test, id FROM docs WHERE lang = 'en'
UNION ALL SELECT 'none_required', id FROM docs WHERE lang = 'en'""")
def extras_gate(spark, sf_dir):
    d = docs(spark, sf_dir)
    english = (req.AttributeCheck("lang", "EQ", "en"),)
    installed = {"research", "images"}
    tests = {
        "all_there": req.Requirements(extras=("research", "images"), attribute_checks=english),
        "one_missing": req.Requirements(extras=("research", "audio"), attribute_checks=english),
        "none_required": req.Requirements(attribute_checks=english),
    }
    hits = [F.when(req.requirements_met(d, req.StageDefinition(t, requirements=r), installed), F.lit(t)) for t, r in tests.items()]
    return d.select(F.explode(F.array_compact(F.array(*hits))).alias("test"), "id")


@query("check_requirements", ctes(DOCS_SQL, STAGES_SQL) + """SELECT id FROM docs d
WHERE doc_id % 4 >= 1 AND priority > 0.25 AND lang <> 'de' AND regexp_matches(source, '^src1.*$') AND source <> 'src11'
  AND EXISTS (SELECT 1 FROM stages s WHERE s.doc_id = d.doc_id AND name = 'signup' AND status = 'done')""")
def check_requirements(spark, sf_dir):
    definition = req.StageDefinition("all", requirements=req.Requirements(
        file_presence=req.FilePresence("upload_file"),
        stages={"signup": "done"},
        attribute_checks=(req.AttributeCheck("priority", "GT", 0.25), req.AttributeCheck("lang", "NE", "de"),
                          req.AttributeCheck("source", "CP", "SRC1*", case_sensitive=False)),
        list_checks=(req.ListCheck("tags", "NOT_HAS", "src11"),),
        extras=("research",),
    ))
    base = req.with_stage_states(docs(spark, sf_dir), stages(spark, sf_dir), req.needed_states([definition]))
    return base.where(req.requirements_met(base, definition, {"research"})).select("id")


@query("requirement_rejects", D + """SELECT doc_id, 'typed' AS definition, 'rating' AS attribute FROM docs WHERE lang = 'en'""")
def requirement_rejects(spark, sf_dir):
    typed = req.StageDefinition("typed", requirements=req.Requirements(attribute_checks=(
        req.AttributeCheck("rating", "GT", 100), req.AttributeCheck("lang", "LT", "x"))))
    return req.type_conflicts(docs(spark, sf_dir), [typed])


@query("workflow_when", D + """SELECT id, 'collect_ideas' AS workflow, coalesce(idea_tag = 'blog_post_ideas', false) AS runs FROM docs
UNION ALL SELECT id, 'peer_review', priority > 0.75 FROM docs
UNION ALL SELECT id, 'send_form', true FROM docs""")
def workflow_when(spark, sf_dir):
    d = docs(spark, sf_dir)
    chosen = [w for s in DEFINITIONS for w in s.workflows if w.name in ("collect_ideas", "peer_review", "send_form")]
    cells = [F.struct(F.lit(w.name).alias("workflow"), req.workflow_condition(w).alias("runs")) for w in chosen]
    return d.select("id", F.inline(F.array(*cells)))


@query("doc_stage_matrix", ctes(DOCS_SQL, STAGES_SQL, SUMMARY_SQL) + """SELECT doc_id, 'core' AS definition, false AS met FROM joined
UNION ALL SELECT doc_id, 'research', met_research FROM joined
UNION ALL SELECT doc_id, 'draft', false FROM joined
UNION ALL SELECT doc_id, 'review', met_review FROM joined
UNION ALL SELECT doc_id, 'signup', met_signup FROM joined
UNION ALL SELECT doc_id, 'purchase', signup_done FROM joined
UNION ALL SELECT doc_id, 'publish', false FROM joined""")
def doc_stage_matrix(spark, sf_dir):
    return req.requirement_matrix(docs(spark, sf_dir), stages(spark, sf_dir), DEFINITIONS)


# -- evaluation -----------------------------------------------------------------------------


def _many_definitions():
    """Forty definitions whose requirements differ in their values; every third one needs the one before it."""
    languages = ["en", "fr", "de", "es"]
    return [StageDefinition(f"s{i}", requirements=Requirements(
        stages={f"s{i - 1}": "active"} if i % 3 == 2 else {},
        attribute_checks=(AttributeCheck("priority", "GT", i / 50), *([AttributeCheck("lang", "EQ", languages[i % 4].upper(), case_sensitive=False)] if i % 2 else [])),
        list_checks=(ListCheck("tags", "HAS", "blog_post_ideas", case_sensitive=False),) if i % 5 == 0 else ())) for i in range(40)]


def _many_sql(i: str) -> str:
    return f"""(priority > CAST({i} AS DOUBLE) / 50 AND ({i} % 2 = 0 OR lang = ['en', 'fr', 'de', 'es'][{i} % 4 + 1]) AND ({i} % 5 <> 0 OR coalesce(lower(idea_tag) = 'blog_post_ideas', false)))"""


@query("evaluate_many", D + f"""SELECT doc_id, 's' || i AS definition, CASE WHEN {_many_sql('i')} AND (i % 3 <> 2 OR {_many_sql('(i - 1)')}) THEN 'started' ELSE 'skipped' END AS outcome
FROM docs, unnest(range(40)) AS t(i) WHERE status IN ('inbox', 'active')""")
def evaluate_many(spark, sf_dir):
    d, s = _scope(spark, sf_dir)
    return ev.evaluate_stages(d, s, _many_definitions(), order="seq").outcomes.select("doc_id", "definition", "outcome")


@query("evaluate_stages", _outcomes_sql(OPEN_DOCS) + "SELECT doc_id, definition, outcome, reason, checked, counter FROM outcomes")
def evaluate_stages(spark, sf_dir):
    d, s = _scope(spark, sf_dir)
    return ev.evaluate_stages(d, s, DEFINITIONS, order="seq").outcomes.drop("pass")


@query("evaluate_rerun", _outcomes_sql(OPEN_DOCS, allow_rerun=True) + "SELECT doc_id, definition, outcome, reason, checked, counter FROM outcomes")
def evaluate_rerun(spark, sf_dir):
    d, s = _scope(spark, sf_dir)
    return ev.evaluate_stages(d, s, DEFINITIONS, order="seq", allow_rerun=True).outcomes.drop("pass")


@query("evaluate_scoped", _outcomes_sql("status = 'inbox'") + "SELECT doc_id, outcome, reason, counter FROM outcomes WHERE definition = 'signup'")
def evaluate_scoped(spark, sf_dir):
    d = ev.evaluation_scope(docs(spark, sf_dir), "inbox")
    return ev.evaluate_stages(d, stages(spark, sf_dir), DEFINITIONS, stage="signup", order="seq").outcomes.select(
        "doc_id", "outcome", "reason", "counter")


@query("evaluate_passes", ctes(DOCS_SQL) + """SELECT doc_id, 2 AS "pass", 'draft' AS definition FROM docs WHERE status IN ('inbox', 'active') AND idea_tag IS NOT NULL
UNION ALL SELECT doc_id, 1, 'research' FROM docs WHERE idea_tag IS NOT NULL""")
def evaluate_passes(spark, sf_dir):
    # The definition stands before its prerequisite, so it starts in the second pass, and only where a save evaluates.
    order = [d for d in DEFINITIONS if d.name == "draft"] + [d for d in DEFINITIONS if d.name == "research"]
    result = ev.evaluate_stages(docs(spark, sf_dir), stages(spark, sf_dir), order, order="seq", passes=3)
    return result.outcomes.where("outcome = 'started'").select("doc_id", "pass", "definition")


@query("evaluate_guard", D + "SELECT id, status FROM docs WHERE status IN ('inbox', 'active')")
def evaluate_guard(spark, sf_dir):
    return ev.evaluation_guard(docs(spark, sf_dir)).select("id", "status")


@query("evaluated_documents", _outcomes_sql(OPEN_DOCS) + """, any_started AS (SELECT DISTINCT doc_id FROM outcomes WHERE outcome = 'started')
SELECT j.doc_id, CASE WHEN status = 'inbox' AND (n_stages > 0 OR a.doc_id IS NOT NULL) THEN 'active' ELSE status END AS status,
       status = 'inbox' AND (n_stages > 0 OR a.doc_id IS NOT NULL) AS status_changed
FROM joined j LEFT JOIN any_started a USING (doc_id) WHERE status IN ('inbox', 'active')""")
def evaluated_documents(spark, sf_dir):
    d, s = _scope(spark, sf_dir)
    return ev.evaluate_stages(d, s, DEFINITIONS, order="seq").documents.select("doc_id", "status", "status_changed")


@query("evaluation_summary", _outcomes_sql(OPEN_DOCS) + """SELECT count(DISTINCT doc_id) AS documents, count_if(checked)::BIGINT AS evaluated,
  count_if(outcome = 'started')::BIGINT AS started, count_if(outcome = 'skipped')::BIGINT AS skipped FROM outcomes""")
def evaluation_summary(spark, sf_dir):
    d, s = _scope(spark, sf_dir)
    return ev.evaluation_summary(ev.evaluate_stages(d, s, DEFINITIONS, order="seq").outcomes)


@query("skip_reasons", _outcomes_sql(OPEN_DOCS) + "SELECT definition, reason, count(*) AS n FROM outcomes WHERE outcome = 'skipped' GROUP BY ALL")
def skip_reasons(spark, sf_dir):
    d, s = _scope(spark, sf_dir)
    return ev.skip_reasons(ev.evaluate_stages(d, s, DEFINITIONS, order="seq").outcomes)


@query("activate_documents", ctes(DOCS_SQL, STAGES_SQL) + """SELECT id, status, CASE WHEN status = 'inbox' AND
  EXISTS (SELECT 1 FROM stages s WHERE s.doc_id = d.doc_id) THEN 'active' ELSE status END AS new_status FROM docs d""")
def activate_documents(spark, sf_dir):
    return ev.activate_documents(docs(spark, sf_dir), stages(spark, sf_dir)).select("id", "status", "new_status")


# -- counters -------------------------------------------------------------------------------


def numbered(spark, sf_dir):
    """Stages with their counter; the hour of the time stamp splits a document with very many stages."""
    return running_number(stages(spark, sf_dir), ["doc_id", "name"], ["ts", "seq"], [F.date_trunc("hour", "ts")], "counter")


@query("next_stage_counter", ctes(STAGES_SQL) + "SELECT doc_id, name, count(*) + 1 AS next_counter FROM stages GROUP BY ALL")
def next_stage_counter(spark, sf_dir):
    return stages(spark, sf_dir).groupBy("doc_id", "name").agg((F.count("*") + 1).alias("next_counter"))


@query("assign_stage_counter", ctes(NUMBERED_STAGES_SQL) + "SELECT doc_id, name, stage_id, counter FROM numbered")
def assign_stage_counter(spark, sf_dir):
    return numbered(spark, sf_dir).select("doc_id", "name", "stage_id", "counter")


@query("get_stage", ctes(NUMBERED_STAGES_SQL) + """, third AS (SELECT doc_id, name, stage_id, status FROM numbered WHERE counter = 3)
SELECT 'by_counter' AS lookup, doc_id, name, stage_id, status FROM third
UNION ALL SELECT 'by_id', n.doc_id, n.name, n.stage_id, n.status FROM numbered n JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = n.stage_id
  WHERE o.o_orderstatus = 'P'""")
def get_stage(spark, sf_dir):
    s = numbered(spark, sf_dir)
    cols = ["doc_id", "name", "stage_id", "status"]
    wanted_ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("stage_id"))
    by_counter = s.where("counter = 3").select(F.lit("by_counter").alias("lookup"), *cols)
    by_id = s.join(wanted_ids, "stage_id").select(F.lit("by_id").alias("lookup"), *cols)
    return by_counter.unionByName(by_id)


# -- life cycle -----------------------------------------------------------------------------

_MET_SQL = """CASE s.name WHEN 'signup' THEN j.met_signup WHEN 'purchase' THEN j.signup_done END"""


@query("stage_lifecycle", ctes(DOCS_SQL, STAGES_SQL, SUMMARY_SQL) + f"""SELECT s.stage_id, j.status AS doc_status, s.status,
  CASE WHEN s.status NOT IN ('scheduled', 'active') OR j.status = 'inbox' THEN s.status
       WHEN j.status IN ('done', 'blocked', 'archived') THEN
         CASE WHEN s.status = 'scheduled' OR j.status = 'archived' THEN 'cancelled' ELSE j.status END
       WHEN s.status = 'scheduled' AND coalesce({_MET_SQL}, true) THEN 'active'
       WHEN s.status = 'active' AND NOT coalesce({_MET_SQL}, true) THEN 'cancelled'
       ELSE s.status END AS new_status
FROM stages s JOIN joined j USING (doc_id)""")
def stage_lifecycle(spark, sf_dir):
    return ev.stage_lifecycle(docs(spark, sf_dir), stages(spark, sf_dir), DEFINITIONS).select(
        "stage_id", "doc_status", "status", "new_status")


@query("stage_recheck", ctes(DOCS_SQL, STAGES_SQL, SUMMARY_SQL) + f"""SELECT s.stage_id, s.status,
  CASE WHEN s.status = 'scheduled' AND {_MET_SQL} THEN 'active'
       WHEN s.status = 'active' AND NOT {_MET_SQL} THEN 'cancelled' ELSE s.status END AS new_status
FROM stages s JOIN joined j USING (doc_id)""")
def stage_recheck(spark, sf_dir):
    return ev.stage_recheck(docs(spark, sf_dir), stages(spark, sf_dir), DEFINITIONS).select("stage_id", "status", "new_status")


@query("cancel_stages", ctes(DOCS_SQL, STAGES_SQL) + """SELECT s.stage_id, s.status,
  CASE WHEN s.status IN ('scheduled', 'active') THEN 'cancelled' ELSE s.status END AS new_status
FROM stages s JOIN docs d USING (doc_id) WHERE d.status = 'done'""")
def cancel_stages(spark, sf_dir):
    dropped = docs(spark, sf_dir).where("status = 'done'")
    return ev.cancel_open_stages(stages(spark, sf_dir), dropped).select("stage_id", "status", "new_status")


# -- references -----------------------------------------------------------------------------


def _ref_edges(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", F.posexplode("doc_refs").alias("pos", "ref")).select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("ref.key").alias("key"), F.col("ref.uuid").alias("target"))


@query("resolve_doc_refs", """WITH """ + DOCS_SQL + """, edges AS (
  SELECT doc_id, k::BIGINT AS pos, CASE k WHEN 1 THEN doc_id // 2 ELSE doc_id * 2 + 1 END AS target
  FROM documents CROSS JOIN (VALUES (1), (2)) AS t(k) WHERE k <= doc_id % 3)
SELECT e.doc_id, e.pos, CAST(e.target AS VARCHAR) AS target, d.status AS target_status, d.title AS target_title
FROM edges e LEFT JOIN docs d ON d.doc_id = e.target""")
def resolve_doc_refs(spark, sf_dir):
    targets = docs(spark, sf_dir).select(
        F.col("id").alias("target"), F.col("status").alias("target_status"), F.col("title").alias("target_title"))
    return _ref_edges(spark, sf_dir).join(targets, "target", "left").select(
        "doc_id", "pos", "target", "target_status", "target_title")


@query("dangling_refs", """WITH edges AS (
  SELECT doc_id, CASE k WHEN 1 THEN doc_id // 2 ELSE doc_id * 2 + 1 END AS target
  FROM documents CROSS JOIN (VALUES (1), (2)) AS t(k) WHERE k <= doc_id % 3)
SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, CAST(target AS VARCHAR) AS missing FROM edges
WHERE target NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'stage', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR) FROM events
WHERE user_id NOT IN (SELECT doc_id FROM documents)""")
def dangling_refs(spark, sf_dir):
    d = docs(spark, sf_dir).select("id", "doc_id")
    refs = _ref_edges(spark, sf_dir).join(d.select(F.col("id").alias("target")), "target", "left_anti")
    lost = stages(spark, sf_dir).join(d.select("doc_id"), "doc_id", "left_anti")
    return refs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("target").alias("missing")).unionByName(
        lost.select(F.lit("stage").alias("kind"), F.col("stage_id").alias("id"), F.col("doc_id").cast("string").alias("missing")))
