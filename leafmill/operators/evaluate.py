"""Stage evaluation: which stages every document starts, and the life cycle of existing stages.

The existing stages are reduced to a few numbers per (document, definition) in one aggregation with
map-side combine, joined to the documents once. The facts of all definitions are one array of that
row, and the ordered passes over them one ``aggregate`` over it, so a stage started by an earlier
definition counts for a later one without another shuffle, and the plan grows in proportion to the definitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.attributes import false_if_null
from leafmill.model import OPEN_STAGE_STATUS
from leafmill.operators.requirements import RuleTable, StageDefinition, needed_states, quoted, requirements_met, sql_text

# Outcome texts of an evaluation.
REASON_NO_EVAL = "no_eval"
REASON_RUNNING = "already has active stage (status: {})"
REASON_EXISTS = "already exists"
REASON_RERUN_HINT = " (use --allow-rerun to rerun completed stages)"
REASON_NOT_CALLABLE = "not marked as multiple_callable in stage definition"
REASON_UNMET = "requirements not met"

STARTED = "started"
SKIPPED = "skipped"

@dataclass(frozen=True)
class Evaluation:
    """``outcomes``: (doc_id, pass, definition, outcome, reason, checked, counter);
    ``documents``: the input documents with their new status and ``status_changed``."""

    outcomes: DataFrame
    documents: DataFrame


class UnknownStage(ValueError):
    """The requested stage has no definition."""


def _n(name: str) -> str:
    return f"_n:{name}"


def _run(name: str) -> str:
    return f"_run:{name}"


def _has(name: str, status: str) -> str:
    return f"_has:{name}:{status}"


def stage_summary(
    stages: DataFrame, definitions: list[StageDefinition], order: str = "counter"
) -> DataFrame:
    """Per document: count of all its stages (also of those without a definition), stage count and first open
    instance of every definition, required states.

    All aggregates are numbers or booleans, so a document with most of the stages is reduced inside
    the map tasks. The first open instance is the least of ``2 * order + (status is active)``.
    """
    # as SQL text: one call each, however many definitions there are
    is_open = f"status IN ({', '.join(map(sql_text, OPEN_STAGE_STATUS))})"
    first_open = f"`{order}` * 2 + CAST(status = 'active' AS INT)"
    aggregates = []
    for name in [d.name for d in definitions]:
        mine = f"name = {sql_text(name)}"
        aggregates.append(F.expr(f"count(CASE WHEN {mine} THEN 1 END)").alias(_n(name)))
        aggregates.append(F.expr(f"min(CASE WHEN {mine} AND {is_open} THEN {first_open} END)").alias(_run(name)))
    for name, status in needed_states(definitions):
        aggregates.append(F.expr(f"max(name = {sql_text(name)} AND status = {sql_text(status)})").alias(_has(name, status)))
    aggregates.append(F.count("*").alias("_stages"))
    return stages.groupBy("doc_id").agg(*aggregates)


def with_stage_summary(
    docs: DataFrame, stages: DataFrame, definitions: list[StageDefinition], order: str = "counter"
) -> DataFrame:
    summary = stage_summary(stages, definitions, order)
    joined = docs.join(summary, "doc_id", "left")
    # documents without stages have no row there
    empty = {_n(d.name): "0" for d in definitions} | {"_stages": "0"} | {_has(n, s): "false" for n, s in needed_states(definitions)}
    given = [F.expr(f"coalesce({quoted(c)}, {empty[c]})").alias(c) if c in empty else F.expr(quoted(c)) for c in summary.columns if c != "doc_id"]
    return joined.select(*[F.expr(quoted(c)) for c in docs.columns], *given)


_STATE = "struct<started:array<string>,status:string,stages:bigint,outcomes:array<struct<pass:int,definition:string,outcome:string,reason:string,checked:boolean,counter:bigint>>>"


def _facts(rules: RuleTable, hits: str, definitions: list[StageDefinition], installed) -> Column:
    """One struct per definition: what is stored, and whether the requirements that no start changes are met."""

    def needs(d: StageDefinition) -> str:
        # a stage that starts here is active; no other state of it comes about
        given = [f"named_struct('stored', {quoted(_has(n, s))}, 'starts', {sql_text(n) if s == 'active' else 'CAST(NULL AS STRING)'})"
                 for n, s in (d.requirements.stages.items() if d.requirements else ())]
        return f"array({', '.join(given)})" if given else "CAST(array() AS ARRAY<STRUCT<stored: BOOLEAN, starts: STRING>>)"

    rows = [
        f"named_struct('name', {sql_text(d.name)}, 'n', CAST({quoted(_n(d.name))} AS BIGINT), 'run', CAST({quoted(_run(d.name))} AS BIGINT), "
        f"'met', {rules.met(d, hits, installed)}, 'needs', {needs(d)}, 'no_eval', {str(d.no_eval).lower()}, 'multiple', {str(d.multiple_callable).lower()})"
        for d in definitions]
    return F.expr(f"array({', '.join(rows)})")


def _decide(state: Column, cell: Column, allow_rerun: bool) -> Column:
    """The state after one definition. ``started`` has a name for every start of this evaluation."""
    at_once, f = cell["pass"] == 1, F.get(F.col("_facts"), cell["no"])
    settled = F.get(F.col("_facts_active"), cell["no"])
    before, after = REASON_RUNNING.split("{}")
    times = F.size(F.filter(state["started"], lambda x: x == f["name"]))
    n = f["n"] + times
    open_status = F.when((times > 0) | (f["run"] % 2 == 1), F.lit("active")).when(f["run"].isNotNull(), F.lit("scheduled"))
    exists = F.concat(F.lit(REASON_EXISTS), F.when(f["multiple"], F.lit(REASON_RERUN_HINT)).otherwise(F.lit("")))
    rerun = at_once if allow_rerun else F.lit(False)
    blocked = (
        F.when(open_status.isNotNull(), F.concat(F.lit(before), open_status, F.lit(after)))
        .when((n > 0) & ~rerun, exists).when((n > 0) & ~f["multiple"], F.lit(REASON_NOT_CALLABLE)).when(f["no_eval"], F.lit(REASON_NO_EVAL)))
    needs = F.forall(f["needs"], lambda x: x["stored"] | F.coalesce(F.array_contains(state["started"], x["starts"]), F.lit(False)))
    met = F.when(state["status"] == F.col("_old_status"), f["met"]).otherwise(settled["met"]) & needs
    # the passes of a save look at inbox and active documents only
    in_scope = at_once | false_if_null(state["status"].isin("inbox", "active"))

    def moved(x: Column) -> Column:
        started = in_scope & x["blocked"].isNull() & x["met"]
        outcome = F.struct(
            cell["pass"].alias("pass"), f["name"].alias("definition"), F.when(started, F.lit(STARTED)).otherwise(F.lit(SKIPPED)).alias("outcome"),
            F.when(~started, F.coalesce(x["blocked"], F.lit(REASON_UNMET))).alias("reason"), x["blocked"].isNull().alias("checked"),
            F.when(started, x["n"] + 1).alias("counter"))
        stages = state["stages"] + started.cast("bigint")
        # any stage, new or old, makes an inbox document active: a new one at once, an old one after the pass
        wakes = (state["status"] == "inbox") & (started | (cell["last"] & (stages > 0)))
        return F.struct(
            F.when(started, F.array_append(state["started"], f["name"])).otherwise(state["started"]).alias("started"),
            F.when(wakes, F.lit("active")).otherwise(state["status"]).alias("status"), stages.alias("stages"),
            F.when(in_scope, F.array_append(state["outcomes"], outcome)).otherwise(state["outcomes"]).alias("outcomes")).cast(_STATE)

    # a one-element array binds what is used several times to a name
    return F.transform(F.array(F.struct(blocked.alias("blocked"), met.alias("met"), n.alias("n"))), moved)[0]


def evaluate_stages(
    docs: DataFrame,
    stages: DataFrame,
    definitions: list[StageDefinition],
    installed: set[str] = frozenset(),
    stage: str | None = None,
    allow_rerun: bool = False,
    passes: int = 1,
    order: str = "counter",
) -> Evaluation:
    """Evaluate the active definitions, in order, for every document.

    ``stage`` limits the evaluation to one definition. ``passes=3`` repeats the pass the way a
    command that also saves the document does: a definition listed before its prerequisite then
    starts in a later pass. The guard "inbox and active documents only" is ``evaluation_scope``.
    """
    active = [d for d in definitions if d.active]
    if stage is not None:
        if stage not in [d.name for d in active]:
            raise UnknownStage(f"Stage '{stage}' not found; available: {', '.join(d.name for d in active)}")
    chosen = [d for d in active if stage is None or d.name == stage]
    if not chosen:
        raise UnknownStage("No stage definitions found")
    involved = active if passes > 1 else chosen
    rows = with_stage_summary(docs, stages, involved, order).withColumn("_old_status", F.col("status"))
    rules = RuleTable(docs, involved)
    rows = rows.withColumn("_hits", rules.hits).withColumn("_facts", _facts(rules, "_hits", involved, installed))
    if any(c.attribute == "status" for d in involved if d.requirements for c in d.requirements.attribute_checks):
        # a requirement on the status is met or not as the status goes from inbox to active
        rows = rows.withColumn("status", F.lit("active")).withColumn("_hits_active", rules.hits).withColumn("status", F.col("_old_status"))
        rows = rows.withColumn("_facts_active", _facts(rules, "_hits_active", involved, installed))
    else:
        rows = rows.withColumn("_facts_active", F.col("_facts"))
    place = {d.name: i for i, d in enumerate(involved)}
    cells = []
    for p in range(1, passes + 1):
        looked_at = active if p > 1 else chosen
        cells += [f"named_struct('pass', {p}, 'no', {place[d.name]}, 'last', {str(d is looked_at[-1]).lower()})" for d in looked_at]
    start = F.struct(F.expr("CAST(array() AS ARRAY<STRING>)").alias("started"), F.col("status").alias("status"), F.col("_stages").cast("bigint").alias("stages"),
                     F.array().cast("array<struct<pass:int,definition:string,outcome:string,reason:string,checked:boolean,counter:bigint>>").alias("outcomes"))
    rows = rows.withColumn("_end", F.aggregate(F.expr(f"array({', '.join(cells)})"), start, lambda state, cell: _decide(state, cell, allow_rerun)))
    # not ``inline``: its test for an empty list would be pushed below and evaluate everything a second time
    outcomes = rows.select("doc_id", F.inline_outer("_end.outcomes")).where("definition IS NOT NULL")
    kept = [F.col("_end.status").alias("status") if c == "status" else F.col(f"`{c}`") for c in docs.columns]
    return Evaluation(outcomes, rows.select(*kept, (F.col("_end.status") != F.col("_old_status")).alias("status_changed")))


def evaluation_scope(docs: DataFrame, status: str | None = "inbox", doc_id=None) -> DataFrame:
    """Documents of a status, or one document whatever its status."""
    if doc_id is not None:
        return docs.where(F.col("doc_id") == doc_id)
    return docs.where(F.col("status") == status)


def evaluation_guard(docs: DataFrame) -> DataFrame:
    """Only inbox and active documents are evaluated by themselves on a save."""
    return docs.where(F.col("status").isin("inbox", "active"))


def evaluation_summary(outcomes: DataFrame) -> DataFrame:
    """Totals: documents, stage evaluations, started, skipped. One row."""
    return outcomes.agg(
        F.count_distinct("doc_id").alias("documents"),
        F.count_if("checked").alias("evaluated"),
        F.count_if(F.col("outcome") == STARTED).alias("started"),
        F.count_if(F.col("outcome") == SKIPPED).alias("skipped"),
    )


def skip_reasons(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome") == SKIPPED).groupBy("definition", "reason").agg(F.count("*").alias("n"))


def started_stages(outcomes: DataFrame) -> DataFrame:
    """New stage rows of an evaluation, all active."""
    return outcomes.where(F.col("outcome") == STARTED).select(
        "doc_id", F.col("definition").alias("name"), "counter", F.lit("active").alias("status")
    )


def activate_documents(docs: DataFrame, stages: DataFrame) -> DataFrame:
    """Inbox documents with any stage become active."""
    have = stages.select("doc_id").distinct().withColumn("_has", F.lit(True))
    joined = docs.join(have, "doc_id", "left")
    new = F.when((F.col("status") == "inbox") & F.col("_has"), F.lit("active")).otherwise(F.col("status"))
    return joined.withColumn("new_status", new).drop("_has")


# -- life cycle of existing stages ----------------------------------------------------------


def _met_per_document(docs: DataFrame, stages: DataFrame, definitions, installed) -> DataFrame:
    """Documents with one boolean per definition: ``_met:<name>``."""
    from leafmill.operators.requirements import with_stage_states

    active = [d for d in definitions if d.active]
    base = with_stage_states(docs, stages, needed_states(active))
    return base.select(
        "doc_id",
        F.col("status").alias("doc_status"),
        F.map_from_arrays(
            F.array(*[F.lit(d.name) for d in active]), F.array(*[requirements_met(base, d, installed) for d in active])
        ).alias("_met"),
    )


def _join_documents(stages: DataFrame, met: DataFrame) -> DataFrame:
    return stages.join(met, "doc_id")


def stage_lifecycle(
    docs: DataFrame, stages: DataFrame, definitions: list[StageDefinition], installed: set[str] = frozenset()
) -> DataFrame:
    """New status of every open stage from the status of its document; other stages unchanged.

    A stage without a definition counts as having its requirements met.
    """
    joined = _join_documents(stages, _met_per_document(docs, stages, definitions, installed))
    met = F.coalesce(F.col("_met")[F.col("name")], F.lit(True))
    doc, old = F.col("doc_status"), F.col("status")
    final = doc.isin("done", "blocked", "archived")
    new = (
        F.when(final & (old == "scheduled"), F.lit("cancelled"))
        .when(final & (old == "active"), F.when(doc == "archived", F.lit("cancelled")).otherwise(doc))
        .when((doc == "active") & (old == "scheduled") & met, F.lit("active"))
        .when((doc == "active") & (old == "active") & ~met, F.lit("cancelled"))
        .otherwise(old)
    )
    return joined.withColumn("new_status", new).drop("_met")


def stage_recheck(
    docs: DataFrame, stages: DataFrame, definitions: list[StageDefinition], installed: set[str] = frozenset()
) -> DataFrame:
    """New status of stages that are saved: open stages follow their requirements whatever the
    status of the document; final stages and stages without a definition stay."""
    joined = _join_documents(stages, _met_per_document(docs, stages, definitions, installed))
    met = F.col("_met")[F.col("name")]
    old = F.col("status")
    new = (
        F.when(met & (old == "scheduled"), F.lit("active"))
        .when(~met & (old == "active"), F.lit("cancelled"))
        .otherwise(old)
    )
    return joined.withColumn("new_status", new).drop("_met")


def cancel_open_stages(stages: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Stages of documents about to be dropped: the open ones are cancelled."""
    mine = stages.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    new = F.when(F.col("status").isin(*OPEN_STAGE_STATUS), F.lit("cancelled")).otherwise(F.col("status"))
    return mine.withColumn("new_status", new)
