"""Exact dedup over a persistent index of text digests.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest, held against
the index by a sort-merge anti-join, and the digests that are new are appended with the name of the batch. What a batch decides:

* a digest that the index has from another batch: every row of the batch goes, ``keep_id`` is the id the index has;
* a digest that is new, or that an earlier try of the same batch has appended: the row with the largest id stays (a null id is smaller than any other).

So a batch that runs again, whether or not its first try got as far as the append, decides the same and appends
only what is not there yet. A batch is known by the name that the caller gives, or by a digest of its ids and texts.

Rows that share id and text are copies of each other: exactly one of them stays. A null text counts as the
empty text, and empty texts are equal. An empty batch gives an empty result and leaves the index as it is.
Columns besides id and text are ignored by ``decide`` and passed on by ``survivors``; names that start with
``__`` are reserved.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import materialise, shared_folder


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of ASCII alone takes the short way, which gives the same."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_digest(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


class DigestIndex:
    """The persistent index: digest, keep_id. ``buckets`` is fixed when the table is made; choose it so
    that a bucket of the final index fits in a task."""

    def __init__(self, spark: SparkSession, table: str, buckets: int):
        self.spark, self.table, self.buckets = spark, table, buckets

    @classmethod
    def create(cls, spark: SparkSession, id_type: str = "bigint", table: str | None = None,
               buckets: int | None = None) -> DigestIndex:
        index = cls(spark, table or f"digest_index_{uuid.uuid4().hex}",
                    buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        # made without Python, whose workers would stay beside those of the step before
        empty = spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (("digest", "string"), ("keep_id", id_type), ("batch", "string"))])
        index._writer(empty).option("path", shared_folder(spark, "digest-index")).saveAsTable(index.table)
        return index

    def _writer(self, df: DataFrame):
        return df.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")

    def read(self) -> DataFrame:
        return self.spark.read.table(self.table)

    def drop(self) -> None:
        """Take the index away, files and all; decisions that it gave stay."""
        files = self.read().inputFiles()
        if files:
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
        self.spark.sql(f"DROP TABLE `{self.table}`")

    def _groups(self, rows: DataFrame, batch: str | None) -> DataFrame:
        """One row per digest of the batch with the id that stays; the new ones are then in the index."""
        groups = materialise(
            rows.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.sum("n").alias("group_size")), "groups")
        if batch is None:
            # a sum does not depend on the order of rows
            parts = F.struct(*[F.sum(F.xxhash64(F.lit(seed), "digest", "last_id", "group_size").cast("decimal(38,0)")) for seed in (1, 2)], F.count("*"))
            batch = str(groups.agg(F.sha2(F.to_json(parts), 256).alias("name")).first().name)
        held = self.read().hint("merge")
        before = materialise(  # read before the append: what other batches had said when this one came
            groups.join(held.where(F.col("batch") != batch).select("digest", "keep_id", F.lit(True).alias("known")), "digest", "left")
            .select("digest", "group_size", F.coalesce("known", F.lit(False)).alias("known"),
                    F.when(F.col("known"), F.col("keep_id")).otherwise(F.col("last_id")).alias("keep_id")), "winners")
        new = groups.join(held, "digest", "left_anti")
        self._append(new.select("digest", F.col("last_id").alias("keep_id"), F.lit(batch).alias("batch")))
        return before

    def _append(self, new: DataFrame) -> None:
        self._writer(new.repartition(self.buckets, "digest")).mode("append").saveAsTable(self.table)

    def _decided(self, docs: DataFrame, id_col: str, text_col: str, batch: str | None) -> DataFrame:
        """One row per id and text with ``n``, how many rows have both; ``stays`` if one of them does."""
        rows = materialise(
            docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_digest(F.col(f"`{text_col}`")).alias("digest"))
            .groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "digests")
        winners = self._groups(rows, batch)
        return rows.join(winners, "digest").withColumn("stays", ~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id")))

    def decide(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """One row per row of ``docs``: doc_id, keep_id, group_size (rows of the batch with that text), kept,
        text_sha256, seen_before (the text came in an earlier batch). The batch enters the index."""
        return (
            self._decided(docs, id_col, text_col, batch).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
            .select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), F.col("digest").alias("text_sha256"),
                    F.col("known").alias("seen_before")))

    def survivors(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """The rows of ``docs`` that stay, with all their columns. Only rows that share id and text move a second time."""
        keep = self._decided(docs, id_col, text_col, batch).where("stays").select(
            F.col("digest").alias("__keep"), F.col("doc_id").alias("__id"), (F.col("n") > 1).alias("__copies"))
        rows = docs.withColumn("__digest", text_digest(F.col(f"`{text_col}`")))
        same = (rows["__digest"] == keep["__keep"]) & rows[f"`{id_col}`"].eqNullSafe(keep["__id"])
        kept = rows.join(keep, same).drop("__keep", "__id")
        once = kept.where("NOT __copies").unionByName(kept.where("__copies").dropDuplicates(["__digest"]))
        return once.drop("__digest", "__copies")
