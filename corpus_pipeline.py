"""Cleaning and packing of the documents for training, in five stages.

Each stage takes all that the one before kept and gives rows with the columns of ``documents``, the last one the packed
pieces. ``run`` writes what a stage gives as Parquet to the shared folder and reads it back for the next.

* language_id: documents without any letter have no language and go; ``lang`` becomes the predicted language.
* exact_dedup: of texts that are equal but for the case of A-Z the one with the largest id stays.
* near_dedup: of documents joined by a similarity of 0.8 or more on five-word runs the one with the least id stays.
* pii: personal values become pseudonyms; ``n_chars`` follows where a text changed its length.
* packing: the texts as token sequences of 2048.

Null texts go with the first stage. Columns besides those read are passed on up to the last stage. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.exact_dedup import DigestIndex
from leafmill.llm.language import UNKNOWN, learn, predict
from leafmill.llm.near_dup import representatives
from leafmill.llm.packing import pack
from leafmill.llm.pii import pseudonymise
from leafmill.llm.queries import PII_KEY
from leafmill.plans.registry import query
from leafmill.session import materialise

#: Not expressible: parsing by automata, hash trees and packing have no SQL form.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    languages = learn(docs, F.lit(True))
    if not languages.names:  # nothing to learn from: only texts without a letter are rejected
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = predict(docs, languages, pred_col="__lang", score_col="__score")
    return found.where(F.col("__lang") != UNKNOWN).withColumn("lang", F.col("__lang")).select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return DigestIndex.create(spark, docs.schema["doc_id"].dataType.simpleString()).survivors(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return representatives(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    changed = pseudonymise(docs.withColumn("__before", F.char_length("text")), PII_KEY)
    size = F.when(F.char_length("text") != F.col("__before"), F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", size).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
