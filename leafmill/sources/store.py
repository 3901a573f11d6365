"""The store of documents (or stages), partitioned by status and by a hash of the key, and the store of stage results."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.model import DOCUMENT_STATUS
from leafmill.operators.mutations import changed_rows
from leafmill.operators.ranking import last_per_key
from leafmill.session import materialise

BUCKETS = 16
_NAME = "bucket_of_"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_store(rows: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """One folder per status, so a status filter reads only its folder, and in it one per hash bucket of the key, so a change
    rewrites little. The number of buckets is in the folders' names; choose it so that a bucket of one status is a good file."""
    name = f"{_NAME}{buckets}"
    placed = rows.withColumn(name, _bucket(key, buckets))
    placed.repartition("status", name).write.mode("overwrite").partitionBy("status", name).parquet(path)


def read_store(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    store = spark.read.parquet(path)
    return store.where(F.col(key).isNotNull()).drop(_bucket_column(store)[0])


def _bucket_column(store: DataFrame) -> tuple[str, int]:
    """Name and number of the buckets of a store."""
    name = next(c for c in store.columns if re.fullmatch(_NAME + "[0-9]+", c))
    return name, int(name[len(_NAME):])


def save(spark: SparkSession, path: str, rows: DataFrame, keys: tuple[str, ...] = ("id",), gone: DataFrame | None = None) -> list[tuple[str, int]]:
    """Put ``rows`` in the place of the stored rows of the same keys, whatever status these had; take away the keys of ``gone``.

    Only the (status, bucket) folders that lose or gain a row are written, in one write that replaces a folder
    as its last step: a failure before that leaves the store as it was, and ``rows`` may be made from the store itself. Each of these folders gets one
    row without a key, which ``read_store`` leaves out, so one that lost its last row is replaced too. Returns the folders, at most one
    name for every status and bucket. The first key column is the one that the store was written by.
    """
    store = spark.read.parquet(path)
    name, buckets = _bucket_column(store)
    # made once, since what follows reads the rows several times
    new = materialise(rows.where(F.col(keys[0]).isNotNull()).withColumn(name, _bucket(keys[0], buckets)).select(*store.columns), "save")
    replaced = new.select(*keys, name)
    if gone is not None:
        replaced = replaced.unionByName(gone.select(*keys).withColumn(name, _bucket(keys[0], buckets)))
    # the bucket is part of the join, so only its folders are read
    mine = [r[0] for r in replaced.select(name).distinct().collect()]
    near = store.where(F.col(name).isin(mine))
    held = near.select(*keys, "status", name).join(replaced.select(*keys, name).distinct(), [*keys, name])
    touched = sorted({(r.status, r[name]) for r in held.select("status", name).unionByName(new.select("status", name)).distinct().collect()})
    if not touched:
        return []
    by_status = {s: [b for t, b in touched if t == s] for s, _ in touched}
    hit = reduce(Column.__or__, [(F.col("status") == s) & F.col(name).isin(b) for s, b in by_status.items()])
    kept = near.where(hit & F.col(keys[0]).isNotNull()).join(replaced.select(*keys), list(keys), "left_anti")
    marks = spark.createDataFrame(touched, f"status string, {name} int")
    out = kept.unionByName(new).unionByName(marks, allowMissingColumns=True)
    out.repartition("status", name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("status", name).parquet(path)
    return touched


def save_changed(spark: SparkSession, path: str, rows: DataFrame, keys: tuple[str, ...] = ("id",)) -> list[tuple[str, int]]:
    """Save those of ``rows`` that differ from what is stored; the folders of all others stay as they are."""
    stored = read_store(spark, path, keys[0])
    return save(spark, path, changed_rows(stored, rows.select(*stored.columns), list(keys)), keys)


def move_status(spark: SparkSession, path: str, moves: DataFrame) -> list[str]:
    """Give documents ``(id, new_status)`` their new status and partition; no copy stays behind.

    Of several moves of one document the one with the greatest ``seq`` counts (without that column the status that is
    last in the life of a document). A move to no known status is left out. Returns the statuses of the rewritten folders.
    """
    life = F.array_position(F.array(*[F.lit(s) for s in DOCUMENT_STATUS]), F.col("new_status"))
    valid = moves.where(F.col("new_status").isin(*DOCUMENT_STATUS)).withColumn("_life", life)
    order = [F.col(c) for c in ("seq", "_life") if c in valid.columns]
    last = last_per_key(valid.select("id", "new_status", "_life", *[c for c in ("seq",) if c in moves.columns]), ["id"], order)
    store = read_store(spark, path)
    moved = store.join(last.select("id", "new_status"), "id").where("status <> new_status").withColumn("status", F.col("new_status")).drop("new_status")
    return sorted({s for s, _ in save(spark, path, moved)})


def append_results(results: DataFrame, path: str) -> None:
    """Add stage results ``(doc_id, stage, counter, name, seq, header, body)``."""
    results.write.mode("append").parquet(path)


def latest_results(spark: SparkSession, path: str) -> DataFrame:
    """The last written result of every (document, stage, counter, name)."""
    return last_per_key(spark.read.parquet(path), ["doc_id", "stage", "counter", "name"], [F.col("seq")])
