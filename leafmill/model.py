"""Data model: status values, reference types and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Status words of documents and of stages, in lookup order.
DOCUMENT_STATUS = ("inbox", "active", "done", "blocked", "archived")
STAGE_STATUS = ("scheduled", "active", "done", "blocked", "cancelled")
OPEN_STAGE_STATUS = ("scheduled", "active")
DROPPABLE_STATUS = ("inbox", "active", "done", "archived", "all")

DEFAULT_DOCUMENT_STATUS = "inbox"
DEFAULT_STAGE_STATUS = "scheduled"

DOC_REF = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("data", T.VariantType()),
    ]
)
FILE_REF = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("data", T.VariantType()),
    ]
)
DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("attrs", T.VariantType()),
        T.StructField("body", T.StringType()),
        T.StructField("doc_refs", T.ArrayType(DOC_REF)),
        T.StructField("file_refs", T.ArrayType(FILE_REF)),
    ]
)
