"""Definition and workflow catalogs read from YAML and JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.frontmatter import read_bundled_texts, read_texts, yaml_to_json

EVENT_HANDLERS = "event_handlers.json"
# Fixed value: how a source file names its task.
TASK_NAME = r"@worker_task\(task_definition_name='([^']+)'\)"


def definition_catalog(texts: DataFrame) -> DataFrame:
    """YAML stage files as ``(path, name, active, definition VARIANT)``; only active ones, broken files are skipped."""
    parsed = texts.select("path", yaml_to_json("value").alias("json")).select("path", F.try_parse_json("json").alias("definition")).where("definition IS NOT NULL")
    get = lambda key, kind: F.try_variant_get("definition", f"$.{key}", kind)
    rows = parsed.select("path", get("name", "string").alias("name"), F.coalesce(get("active", "boolean"), F.lit(True)).alias("active"), "definition")
    return rows.where("name IS NOT NULL AND active")


def workflow_catalog(texts: DataFrame, default_owner: str) -> DataFrame:
    """JSON workflow files as ``(path, name, version, owner, tasks, definition)``; event handlers and bad JSON are skipped."""
    from leafmill.functions.attributes import try_json

    files = texts.where(~F.col("path").endswith(f"/{EVENT_HANDLERS}"))
    parsed = files.select("path", try_json(F.col("value")).alias("definition")).where("definition IS NOT NULL")
    get = lambda key, kind: F.try_variant_get("definition", f"$.{key}", kind)
    return parsed.select(
        "path", get("name", "string").alias("name"), F.coalesce(get("version", "int"), F.lit(1)).alias("version"),
        F.coalesce(get("ownerEmail", "string"), F.lit(default_owner)).alias("owner"),
        F.from_json(F.to_json(get("tasks", "variant")), "array<struct<name:string,taskReferenceName:string,type:string>>").alias("tasks"), "definition")


def _read(spark: SparkSession, base: str, pattern: str, bundled: bool) -> DataFrame:
    return read_bundled_texts(spark, base, pattern) if bundled else read_texts(spark, f"{base}/{pattern}")


def read_definitions(spark: SparkSession, base: str, bundled: bool = False) -> DataFrame:
    return definition_catalog(_read(spark, base, "stages/*.yml", bundled))


def read_workflows(spark: SparkSession, base: str, default_owner: str, bundled: bool = False) -> DataFrame:
    return workflow_catalog(_read(spark, base, "workflows/*/*.json", bundled), default_owner)


def name_from_json_key(key: str) -> Column:
    return F.try_variant_get(F.try_parse_json("value"), f"$.{key}", "string")


def name_from_yaml_key(key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(yaml_to_json("value")), f"$.{key}", "string")


def name_from_stem() -> Column:
    return F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)


def name_from_regex(pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract("value", pattern, group), F.lit(""))


def task_names(texts: DataFrame) -> DataFrame:
    """Task of every Python file that declares one; a declaration without a plain name gives the file stem."""
    declared = texts.where(F.contains("value", F.lit("@worker_task")))
    return declared.select("path", F.coalesce(name_from_regex(TASK_NAME), name_from_stem()).alias("name"))
