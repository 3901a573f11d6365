"""Listing columns, dotted access, attribute unpivot, public records, paths and reference lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.attributes import attribute, dotted_path, variant_path

BODY_PREVIEW = 100
# Keys of a document that are not public attributes.
INTERNAL_KEYS = ("_doc_dir", "_doc_file", "_data_dir", "_stages", "_original_status", "_persisted")


def preview(text: Column, length: int = BODY_PREVIEW) -> Column:
    """Cut to ``length`` characters and mark the cut with three dots."""
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def listing(docs: DataFrame, columns: list[str] = ("id",)) -> DataFrame:
    """Chosen columns as text; an absent attribute is ``""`` and ``body`` is cut."""
    out = []
    for name in columns:
        if name == "doc-keys":
            value = ref_keys("doc_refs")
        elif name == "file-keys":
            value = ref_keys("file_refs")
        elif name == "body":
            value = preview(F.col("body"))
        else:
            value = attribute(docs, name).text
        out.append(F.coalesce(value, F.lit("")).alias(name))
    return docs.select(*out)


def as_json_lines(listed: DataFrame) -> DataFrame:
    """One JSON object per row, the form of a listing with several columns."""
    return listed.select(F.to_json(F.struct(*listed.columns)).alias("line"))


def ref_keys(refs: str) -> Column:
    return F.array_join(F.transform(F.col(refs), lambda r: r["key"]), ",")


def get(docs: DataFrame, name: str, default=None) -> Column:
    """Flat attribute as text, or ``default``."""
    return F.coalesce(attribute(docs, name).text, F.lit(default))


def get_path(path: str, kind: str = "string", source: str = "attrs") -> Column:
    """Value at a dotted path through nested objects; null if a step is missing."""
    return F.try_variant_get(source, dotted_path(path), kind)


def get_flat(key: str, kind: str = "string", source: str = "attrs") -> Column:
    """Value of a flat key that may itself contain dots."""
    return F.try_variant_get(source, variant_path(key), kind)


def unpivot_attributes(docs: DataFrame, skip: tuple[str, ...] = ("id", "status")) -> DataFrame:
    """``(id, key, value)`` for every attribute; the value is JSON text."""
    pairs = docs.lateralJoin(
        docs.sparkSession.tvf.variant_explode(F.col("attrs").outer())
    )
    return pairs.where(~F.col("key").isin(*skip)).select("id", "key", F.to_json("value").alias("value"))


def public_record(docs: DataFrame) -> DataFrame:
    """Drop internal columns and serialise the references under their stored names."""
    keep = [c for c in docs.columns if c not in INTERNAL_KEYS and c not in ("doc_refs", "file_refs")]
    return docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.to_json("doc_refs").alias("_doc_refs"),
        F.to_json("file_refs").alias("_file_refs"),
    )


def public_stage_record(stages: DataFrame) -> DataFrame:
    """The same for stages: the parent object goes, its id stays."""
    return stages.drop("parent", *INTERNAL_KEYS).withColumn("parent_id", F.col("doc_id").cast("string"))


def document_path(base: str) -> Column:
    return F.concat_ws("/", F.lit(base), "status", "id", F.lit("doc.md"))


def stage_path(base: str, doc_status: str = "doc_status") -> Column:
    return F.concat_ws("/", F.lit(base), F.col(doc_status), F.col("doc_id").cast("string"), F.lit("stages"), "name",
                       F.col("counter").cast("string"), F.lit("stage.md"))


def list_refs(docs: DataFrame, refs: str) -> DataFrame:
    """One row per reference with its position, ``(id, pos, key, uuid, ...)``."""
    rows = docs.select("id", F.posexplode(refs).alias("pos", "ref"))
    return rows.select("id", (F.col("pos") + 1).cast("bigint").alias("pos"), "ref.*")
