"""Views over the test tables, in Spark and as SQL for the checks.

``docs``      documents with status, attributes (typed columns and VARIANT), tags and references
``stages``    every event as a stage instance of its user's document
``signals``   every event as a signal to the trigger gate
``layers``    every order line as one file of a layered catalog; the order is the entry's name
``local_wf``  workflow versions known locally (order lines not returned)
``remote_wf`` workflow versions known remotely (order lines of any other flag)
``runs``      every order as a workflow run of its customer
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.requirements import (
    AttributeCheck,
    FilePresence,
    ListCheck,
    Requirements,
    StageDefinition,
    Workflow,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- documents ------------------------------------------------------------------------------


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    d = d.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("id"),
        F.expr("CASE doc_id % 5 WHEN 0 THEN 'inbox' WHEN 1 THEN 'active' WHEN 2 THEN 'done' "
               "WHEN 3 THEN 'blocked' ELSE 'archived' END").alias("status"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("body"),
        "lang",
        "source",
        "n_chars",
        F.expr("CAST(doc_id % 100 AS DOUBLE) / 100").alias("priority"),
        "quality",
        "toxic",
        F.expr("array_compact(array(lang, source, CASE WHEN doc_id % 6 = 0 THEN 'Blog_Post_Ideas' "
               "WHEN doc_id % 3 = 0 THEN 'blog_post_ideas' END))").alias("tags"),
    )
    d = d.withColumn(
        "doc_refs",
        F.expr("""slice(array(
            named_struct('key', 'research_source', 'uuid', CAST(doc_id DIV 2 AS STRING)),
            named_struct('key', 'related_document', 'uuid', CAST(doc_id * 2 + 1 AS STRING))), 1, CAST(doc_id % 3 AS INT))"""),
    ).withColumn(
        "file_refs",
        F.expr("""transform(slice(array(0, 1, 2), 1, CAST(doc_id % 4 AS INT)), k -> named_struct(
            'key', if(k % 2 = 0, 'upload_file', 'content'),
            'filename', concat('file_', k, '.txt'),
            'uuid', concat('f', doc_id, '_', k)))"""),
    )
    # The same attributes as a VARIANT; ``rating`` has another type in every language.
    return d.withColumn(
        "attrs",
        F.to_variant_object(
            F.struct(
                "title", "lang", "source", "priority", "quality", "toxic", "tags",
                F.expr("named_struct('owner', source, 'flags', named_struct('hot', priority > 0.5, 'lang', lang))").alias("meta"),
                F.concat("lang", F.lit("/"), "source").alias("meta.owner"),
                F.expr("""CASE lang WHEN 'en' THEN CAST(CAST(n_chars AS STRING) AS VARIANT)
                          WHEN 'fr' THEN CAST(n_chars AS VARIANT)
                          WHEN 'de' THEN CAST(priority > 0.5 AS VARIANT) END""").alias("rating"),
            )
        ),
    )


DOCS_SQL = """docs AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id,
         CASE d.doc_id % 5 WHEN 0 THEN 'inbox' WHEN 1 THEN 'active' WHEN 2 THEN 'done'
                           WHEN 3 THEN 'blocked' ELSE 'archived' END AS status,
         split_part(d.text, chr(10), 1) AS title, d.text AS body, d.lang, d.source, d.n_chars,
         CAST(d.doc_id % 100 AS DOUBLE) / 100 AS priority, l.quality, l.toxic,
         CASE WHEN d.doc_id % 6 = 0 THEN 'Blog_Post_Ideas'
              WHEN d.doc_id % 3 = 0 THEN 'blog_post_ideas' END AS idea_tag
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

DOC_TAGS_SQL = """doc_tags AS (
  SELECT doc_id, 1 AS pos, lang AS tag FROM docs
  UNION ALL SELECT doc_id, 2, source FROM docs
  UNION ALL SELECT doc_id, 3, idea_tag FROM docs WHERE idea_tag IS NOT NULL)"""

DOC_REFS_SQL = """doc_refs AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, k AS pos,
         CASE k WHEN 1 THEN 'research_source' ELSE 'related_document' END AS key,
         CASE k WHEN 1 THEN doc_id // 2 ELSE doc_id * 2 + 1 END AS target
  FROM documents CROSS JOIN (VALUES (1), (2)) AS t(k) WHERE k <= doc_id % 3)"""

FILE_REFS_SQL = """file_refs AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, k, CASE WHEN k % 2 = 0 THEN 'upload_file' ELSE 'content' END AS key,
         concat('file_', k, '.txt') AS filename, concat('f', doc_id, '_', k) AS uuid
  FROM documents CROSS JOIN (VALUES (0), (1), (2)) AS t(k) WHERE k < doc_id % 4)"""


# -- stages ---------------------------------------------------------------------------------

_STAGE_STATUS = """CASE WHEN value > 200 THEN 'scheduled' WHEN value > 150 THEN 'active'
                        WHEN value > 60 THEN 'done' WHEN value > 30 THEN 'blocked' ELSE 'cancelled' END"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage instances in arrival order; ``seq`` orders the instances of a (document, name)."""
    return as_stages(table(spark, sf_dir, "events"))


def as_stages(events: DataFrame) -> DataFrame:
    """Events, batch or stream, as stage instances."""
    return events.select(
        F.col("user_id").alias("doc_id"),
        F.col("event_type").alias("name"),
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("stage_id"),
        "ts",
        F.expr(_STAGE_STATUS).alias("status"),
    )


STAGES_SQL = f"""stages AS (
  SELECT user_id AS doc_id, event_type AS name, event_id AS seq, CAST(event_id AS VARCHAR) AS stage_id, ts,
         {_STAGE_STATUS} AS status
  FROM events)"""

NUMBERED_STAGES_SQL = f"""{STAGES_SQL}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY ts, seq) AS counter FROM stages)"""


# Stage definitions of the evaluation queries, in evaluation order.
DEFINITIONS = [
    StageDefinition("core", no_eval=True, workflows=(Workflow("stage_runner"), Workflow("stage_wrapper"))),
    StageDefinition(
        "research",
        workflows=(Workflow("collect_ideas", when="array_contains(tags, 'blog_post_ideas')",
                            inputs={"research_methods": "corpus,web"}),),
        requirements=Requirements(list_checks=(ListCheck("tags", "HAS", "blog_post_ideas", case_sensitive=False),)),
    ),
    StageDefinition(
        "draft",
        workflows=(Workflow("write_draft", inputs={"template": "long"}), Workflow("check_links")),
        requirements=Requirements(stages={"research": "active"}),
    ),
    StageDefinition(
        "review",
        workflows=(Workflow("peer_review", when="priority > 0.75"),),
        requirements=Requirements(
            attribute_checks=(
                AttributeCheck("priority", "GT", 0.5),
                AttributeCheck("lang", "EQ", "EN", case_sensitive=False),
                AttributeCheck("title", "NOT_REGEX", "^The"),
            )
        ),
    ),
    StageDefinition(
        "signup",
        workflows=(Workflow("send_form"),),
        requirements=Requirements(file_presence=FilePresence("upload_file", 1, ">=")),
    ),
    StageDefinition(
        "purchase",
        multiple_callable=True,
        workflows=(Workflow("invoice"), Workflow("ship"), Workflow("notify")),
        requirements=Requirements(stages={"signup": "done"}),
    ),
    StageDefinition(
        "publish",
        workflows=(Workflow("publish_page"),),
        requirements=Requirements(extras=("missing_extra",)),
    ),
]

# -- signals --------------------------------------------------------------------------------

_TASK_REF = "CASE WHEN event_type = 'view' THEN NULL ELSE 'gate' END"
_REASON = "CASE WHEN event_type = 'error' AND value < 2 THEN 'cancel' ELSE 'ready' END"


def as_signals(events: DataFrame) -> DataFrame:
    """Events, batch or stream, as signals to waiting workflows."""
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("workflow_id"),
        F.col("user_id").alias("doc_id"),
        "value",
        "event_type",
        F.expr(_TASK_REF).alias("task_ref_name"),
        F.expr(_REASON).alias("reason"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_signals(table(spark, sf_dir, "events"))


SIGNALS_SQL = f"""signals AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS workflow_id, user_id AS doc_id, value, event_type,
         {_TASK_REF} AS task_ref_name, {_REASON} AS reason
  FROM events)"""

# -- layered catalogs -----------------------------------------------------------------------

_LAYER = """CASE WHEN l_returnflag = 'N' THEN 'lib' WHEN l_returnflag = 'R' THEN 'project'
                 WHEN l_linestatus = 'F' THEN 'vendor_f' ELSE 'vendor_o' END"""
_LAYER_RANK = """CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_returnflag = 'R' THEN 3
                      WHEN l_linestatus = 'F' THEN 1 ELSE 2 END"""


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per catalog file. Files of one layer apply in (line, part, supplier, price) order."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr(_LAYER).alias("layer"),
        F.expr(_LAYER_RANK).alias("layer_rank"),
        F.col("l_orderkey").alias("name"),
        F.col("l_linenumber").alias("file_no"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
    )


FILE_ORDER = ["layer_rank", "file_no", "part", "supplier", "price"]

LAYERS_SQL = f"""layers AS (
  SELECT {_LAYER} AS layer, {_LAYER_RANK} AS layer_rank, l_orderkey AS name, l_linenumber AS file_no,
         l_partkey AS part, l_suppkey AS supplier, l_extendedprice AS price, l_quantity AS quantity,
         l_discount AS discount
  FROM lineitem)"""


def local_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    return li.select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("version")).distinct()


def remote_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    return li.select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("version")).distinct()


LOCAL_SQL = """local_wf AS (SELECT DISTINCT l_orderkey AS name, l_linenumber AS version
  FROM lineitem WHERE l_returnflag <> 'R')"""
REMOTE_SQL = """remote_wf AS (SELECT DISTINCT l_orderkey AS name, l_linenumber AS version
  FROM lineitem WHERE l_returnflag <> 'N')"""

_RUN_STATUS = """CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'PENDING'
                 ELSE CASE WHEN o_totalprice > 250000 THEN 'RUNNING' ELSE 'FAILED' END END"""
_RUN_VERSION = "CAST(substr(o_orderpriority, 1, 1) AS INT)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as workflow runs: the order key names the workflow, the priority digit its version."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderkey").alias("name"),
        F.expr(_RUN_VERSION).alias("version"),
        F.expr(_RUN_STATUS).alias("status"),
        F.col("o_custkey").alias("customer"),
    )


RUNS_SQL = f"""runs AS (
  SELECT o_orderkey AS run_id, o_orderkey AS name, {_RUN_VERSION} AS version, {_RUN_STATUS} AS status,
         o_custkey AS customer
  FROM orders)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
