"""Workflow fan-out, start requests, the join barrier and result collection as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.model import OPEN_STAGE_STATUS
from leafmill.operators.requirements import StageDefinition, workflow_condition

STAGE_COMPLETED = "stage.completed"
WRAPPER = "wrap_stage_subworkflow"  # fixed value: name of the workflow that wraps every branch


def correlation_id(doc: str = "doc_id", stage: str = "name", counter: str = "counter") -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in (doc, stage, counter)])


def workflow_versions(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, version): the version of the catalog, 1 where the catalog has none."""
    known = catalog.groupBy("name").agg(F.max("version").alias("_v"))
    return names.join(known, "name", "left").withColumn("version", F.coalesce("_v", F.lit(1))).drop("_v")


def _branches(definitions: list[StageDefinition]) -> Column:
    """stage name -> [(branch_no, workflow, when, inputs)], a literal map of the definitions."""
    pairs = []
    for d in definitions:
        if not d.active:
            continue
        branches = [
            F.struct(
                F.lit(i).alias("branch_no"),
                F.lit(w.name).alias("workflow"),
                F.create_map(*[F.lit(x) for kv in w.inputs.items() for x in kv]).cast("map<string,string>").alias("inputs"),
            )
            for i, w in enumerate(d.workflows, 1)
        ]
        if branches:
            pairs += [F.lit(d.name), F.array(*branches)]
    return F.create_map(*pairs)


def fan_out(starts: DataFrame, definitions: list[StageDefinition], catalog: DataFrame) -> DataFrame:
    """One task row per workflow of every started stage (doc_id, name, counter).

    The branch is ``wrap_<workflow>_<i>`` with i from 1; its inputs are the common ones, then those of
    the definition. A stage without a definition gives no row.
    """
    rows = starts.select("doc_id", F.col("name").alias("stage"), "counter", F.inline(_branches(definitions)[F.col("name")]))
    versions = {r["name"]: r["version"] for r in _definition_versions(definitions, catalog)}
    version = F.coalesce(F.create_map(*[F.lit(x) for kv in versions.items() for x in kv])[F.col("workflow")], F.lit(1)) if versions else F.lit(1)
    ref = F.concat(F.lit("wrap_"), "workflow", F.lit("_"), F.col("branch_no").cast("string"))
    common = F.create_map(
        F.lit("docId"), F.col("doc_id").cast("string"), F.lit("stageName"), F.col("stage"),
        F.lit("stageCounter"), F.col("counter").cast("string"), F.lit("subworkflow_name"), F.col("workflow"),
        F.lit("subworkflow_version"), version.cast("string"))
    merged = F.map_concat(F.map_filter(common, lambda k, v: ~F.map_contains_key("inputs", k)), "inputs")
    return rows.select(
        "doc_id", "stage", "counter", "branch_no", ref.alias("reference"), F.lit(WRAPPER).alias("wrapper"), "workflow",
        version.alias("version"), merged.alias("inputs"))


def _definition_versions(definitions: list[StageDefinition], catalog: DataFrame) -> list:
    """Versions of the workflows that the definitions name: at most one row per such workflow."""
    names = sorted({w.name for d in definitions for w in d.workflows})
    return catalog.where(F.col("name").isin(names)).groupBy("name").agg(F.max("version").alias("version")).collect()


def start_requests(docs: DataFrame, starts: DataFrame, definitions: list[StageDefinition], catalog: DataFrame) -> DataFrame:
    """One request per started stage: ids, the correlation id and the workflows as JSON.

    ``when`` conditions are evaluated on the document; only workflows whose condition holds are asked for.
    """
    versions = {r["name"]: r["version"] for r in _definition_versions(definitions, catalog)}
    cells = []
    for d in definitions:
        flows = [
            F.when(workflow_condition(w), F.struct(
                F.lit(w.name).alias("name"), F.lit(versions.get(w.name, 1)).alias("version"),
                F.create_map(*[F.lit(x) for kv in w.inputs.items() for x in kv]).cast("map<string,string>").alias("inputs"),
                F.lit(w.when).alias("when")))
            for w in d.workflows
        ]
        if d.active and flows:
            cells += [F.lit(d.name), F.array_compact(F.array(*flows))]
    flows = docs.select("doc_id", F.create_map(*cells).alias("_flows"))
    return starts.join(flows, "doc_id").select(
        "doc_id", "name", "counter", correlation_id().alias("correlation_id"),
        F.to_json(F.col("_flows")[F.col("name")]).alias("workflows"))


def start_once(requests: DataFrame, running: DataFrame) -> DataFrame:
    """Requests whose correlation id is not running already; duplicates in the batch start once."""
    return requests.dropDuplicates(["correlation_id"]).join(running.select("correlation_id").distinct(), "correlation_id", "left_anti")


def join_barrier(branches: DataFrame, keys: list[str]) -> DataFrame:
    """Per stage instance: number of branches, finished ones, and whether all are finished."""
    return branches.groupBy(*keys).agg(
        F.count("*").alias("branches"),
        F.count_if(F.col("status") == "done").alias("finished"),
        F.bool_and(F.coalesce(F.col("status") == "done", F.lit(False))).alias("all_done"),
    )


def stage_completions(barrier: DataFrame, docs: DataFrame) -> DataFrame:
    """Completion event records of the stages whose barrier is open."""
    done = barrier.where("all_done").select("doc_id", F.col("name").alias("stage_name"), "counter")
    found = done.join(docs.select("doc_id", F.col("status").alias("doc_status"), "tags"), "doc_id")
    return found.select(
        F.lit(STAGE_COMPLETED).alias("event"), "doc_id", "stage_name", "counter",
        F.lit("done").alias("stage_status"), "doc_status", F.array_join("tags", ",").alias("tags"))


def collect_branch_results(results: DataFrame, keys: list[str], references: list[str]) -> DataFrame:
    """Result of every branch in a column of its own, by reference name.

    The references of a stage are known from its definition, so the aggregate has a fixed size.
    A branch that reported more than once counts with its last result (``seq``).
    """
    return results.groupBy(*keys).agg(
        *[F.max_by(F.when(F.col("reference") == r, F.col("output")), F.when(F.col("reference") == r, F.col("seq"))).alias(r) for r in references]
    )


def undeclared_results(results: DataFrame, references: list[str]) -> DataFrame:
    """What ``collect_branch_results`` leaves out: results of a reference that the definition does not name."""
    known = F.coalesce(F.col("reference").isin(references), F.lit(False))
    return results.where(~known).withColumn("error", F.concat(F.lit("undeclared reference "), F.coalesce("reference", F.lit("null"))))


def open_stages(stages: DataFrame) -> DataFrame:
    return stages.where(F.col("status").isin(*OPEN_STAGE_STATUS))
