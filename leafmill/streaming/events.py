"""Event handlers on a stream (or a batch) of events, and the trigger gate.

An event row has (event, workflow_id, workflow_type, task_ref_name, doc_id, doc, stage, reason, ts, seq).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import NumericType

from leafmill.functions.attributes import false_if_null
from leafmill.operators.evaluate import started_stages
from leafmill.operators.ranking import last_per_key

DOC_CHANGED = "doc.changed"
STAGE_COMPLETED = "stage.completed"
WORKFLOW_COMPLETED = "workflow.completed"
STAGE_WORKFLOW = "stage_workflow"


def _filled(events: DataFrame, *names: str) -> Column:
    """All of them given: null, empty text and the number 0 are not."""
    test = F.lit(True)
    for n in names:
        nothing = F.lit(0) if isinstance(events.schema[n].dataType, NumericType) else F.lit("")
        value = F.col(n) if isinstance(events.schema[n].dataType, NumericType) else F.col(n).cast("string")
        test = test & value.isNotNull() & (value != nothing)
    return false_if_null(test)


def on_doc_changed(events: DataFrame) -> DataFrame:
    """Wake the waiting task of the event's workflow."""
    hit = (F.col("event") == DOC_CHANGED) & _filled(events, "workflow_id", "task_ref_name", "doc")
    return events.where(hit).select("seq", "ts", "workflow_id", "task_ref_name", "reason", "doc")


def on_stage_completed(events: DataFrame) -> DataFrame:
    """The same for completed stages, with a fixed reason."""
    hit = (F.col("event") == STAGE_COMPLETED) & _filled(events, "workflow_id", "task_ref_name", "doc", "stage")
    return events.where(hit).select("seq", "ts", "workflow_id", "task_ref_name", F.lit("stage_completed").alias("reason"), "doc", "stage")


def on_workflow_completed(events: DataFrame) -> DataFrame:
    """Documents to evaluate after any workflow of theirs has ended."""
    hit = (F.col("event") == WORKFLOW_COMPLETED) & _filled(events, "workflow_id", "doc_id")
    return events.where(hit).select("seq", "ts", "doc_id", F.col("workflow_id").alias("triggered_by"))


def on_stage_workflow_completed(events: DataFrame) -> DataFrame:
    """The same for stage workflows only."""
    return on_workflow_completed(events.where(F.col("workflow_type") == STAGE_WORKFLOW))


def evaluate_on_events(
    triggers: DataFrame, evaluate: Callable[[DataFrame], DataFrame], target: str, checkpoint: str
) -> StreamingQuery:
    """Evaluate the documents named by each micro-batch of ``triggers`` (doc_id, ...).

    ``evaluate`` maps a batch of distinct doc ids to result rows. Each batch overwrites the folder
    of its own id, so a batch that runs again after a failure leaves the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        evaluate(batch.select("doc_id").distinct()).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return triggers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- stages that batches start ----------------------------------------------------------------


@dataclass(frozen=True)
class StageStore:
    """Stages ``(doc_id, name, counter, status)`` that the micro-batches of one stream have started, in a folder.

    Every batch has a partition of its own, which it overwrites when it runs again, and reads those of earlier batches
    only, so a replayed batch sees and leaves the same rows. Every ``SNAPSHOT`` batches the rows so far are
    written together, and older partitions are not read any more. Of several rows of one stage the last batch's counts.
    """

    spark: SparkSession
    path: str
    snapshot: int = 50

    _KEYS = ("doc_id", "name", "counter")

    @classmethod
    def create(cls, spark: SparkSession, path: str, doc_id_type: str = "bigint", snapshot: int = 50) -> StageStore:
        store = cls(spark, path, snapshot)
        nothing = spark.createDataFrame([], f"doc_id {doc_id_type}, name string, counter bigint, status string")
        nothing.write.parquet(f"{path}/rows/batch=-1")
        nothing.withColumn("batch", F.lit(-1)).write.parquet(f"{path}/whole/upto=-1")
        return store

    def _rows(self, start: int, end: int) -> DataFrame:
        """Rows of the batches from ``start`` on and before ``end``, with those of the snapshot at ``start``."""
        batches = self.spark.read.parquet(f"{self.path}/rows").where((F.col("batch") >= start) & (F.col("batch") < end))
        whole = self.spark.read.parquet(f"{self.path}/whole").where(F.col("upto") == start).drop("upto")
        return last_per_key(whole.unionByName(batches), list(self._KEYS), [F.col("batch")])

    def before(self, batch_id: int) -> DataFrame:
        """The stages that batches before ``batch_id`` have left."""
        start = batch_id // self.snapshot * self.snapshot
        if start == batch_id and start > 0:
            earlier = self._rows(start - self.snapshot, start)
            earlier.select(*self._KEYS, "status", "batch").write.mode("overwrite").parquet(f"{self.path}/whole/upto={start}")
        return self._rows(start, batch_id).drop("batch")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*self._KEYS, "status").write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")

    def read(self) -> DataFrame:
        """All stages, after any number of batches."""
        return last_per_key(self.spark.read.parquet(f"{self.path}/rows"), list(self._KEYS), [F.col("batch")]).drop("batch")


def evaluate_and_start(
    triggers: DataFrame, evaluate: Callable[[DataFrame, DataFrame], DataFrame], store: StageStore, target: str, checkpoint: str
) -> StreamingQuery:
    """``evaluate_on_events`` whose starts stay: what a batch starts, the later ones see.

    ``evaluate`` maps the distinct doc ids of a batch and the stages started before to outcome rows. These go to
    the batch's folder in ``target``, the started stages to its partition of the store.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ids, folder = batch.select("doc_id").distinct(), f"{target}/batch={batch_id}"
        outcomes = evaluate(ids, store.before(batch_id))
        outcomes.write.mode("overwrite").parquet(folder)
        store.write(started_stages(batch.sparkSession.read.schema(outcomes.schema).parquet(folder)), batch_id)

    return triggers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- the gate -------------------------------------------------------------------------------


def opens_gate(rule: Column, reason: str = "reason") -> Column:
    """A signal ends the wait if its document satisfies the rule or its reason is cancel."""
    return false_if_null(rule) | false_if_null(F.col(reason) == "cancel")


def gate_decision(signals: DataFrame, rule: Column, key: str = "workflow_id") -> DataFrame:
    """First signal (by ts, seq) per waiting key that opens its gate.

    An aggregate with map-side combine: a key with most of the signals is no problem.
    """
    opening = signals.where(opens_gate(rule)).withColumn("ready", false_if_null(rule))
    first = F.min(F.struct("ts", "seq", "ready", F.coalesce("reason", F.lit("ready")).alias("reason"), "doc_id"))
    return opening.groupBy(key).agg(first.alias("s")).select(key, "s.ts", "s.seq", "s.ready", "s.reason", "s.doc_id")


def gate_stream(signals: DataFrame, rule: Column, target: str, checkpoint: str, key: str = "workflow_id") -> StreamingQuery:
    """The gate on a stream: every key is written once, in the micro-batch that opens it.

    The state per key is one aggregate row. It keeps the time of the batch that opened the gate, so
    only keys opened in the current batch pass on; later signals of an open gate change nothing.
    State is kept for ever, as a gate has no timeout; ``gate_stream_keyed`` offers one.
    """
    opening = signals.where(opens_gate(rule)).withColumn("ready", false_if_null(rule))
    batch_time = F.current_timestamp()  # one value per micro-batch
    opening = opening.withColumn("opened", batch_time)
    seen = F.struct("opened", "ts", "seq", "ready", F.coalesce("reason", F.lit("ready")).alias("reason"), "doc_id")
    state = opening.groupBy(key).agg(F.min(seen).alias("s"))
    fresh = state.where(F.col("s.opened") == batch_time).select(key, "s.ts", "s.seq", "s.ready", "s.reason", "s.doc_id")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        fresh.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def gate_stream_keyed(
    signals: DataFrame, rule: Column, target: str, checkpoint: str, key: str = "workflow_id", ttl: str | None = None, late: str = "0 seconds"
) -> StreamingQuery:
    """The gate with one flag of state per open key, and an end to it if ``ttl`` (such as "1 day") is given.

    A key passes on its first opening signal (by ts, seq) and is then shut to later ones. With ``ttl`` the flag
    leaves once the watermark (``ts`` less ``late``) is so much past the signal that opened the gate; a signal after that opens
    it again. Only signals that can open a gate reach the state, and those of one key pass through it piece by piece.
    """
    opening = signals.where(opens_gate(rule)).select(
        key, "ts", "seq", false_if_null(rule).alias("ready"), F.coalesce("reason", F.lit("ready")).alias("reason"), "doc_id")
    out = opening.schema
    millis = None
    if ttl is not None:
        timed = opening.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        opening, out = timed.withColumn("_ms", F.unix_millis("ts")), timed.schema
        millis = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def open_once(_: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            if millis is not None:  # a timeout lasts for one call only
                state.setTimeoutTimestamp(max(state.get[0], state.getCurrentWatermarkMs() + 1))
            return
        firsts = [piece.sort_values(["ts", "seq"]).head(1) for piece in pieces]
        first = pd.concat(firsts).sort_values(["ts", "seq"]).head(1)
        ends = 0
        if millis is not None:
            ends = int(first["_ms"].iloc[0]) + millis
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        state.update((ends,))
        yield first[out.names]

    timeout = GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.EventTimeTimeout
    fresh = opening.groupBy(key).applyInPandasWithState(open_once, out, "ends bigint", "append", timeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        fresh.writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def start_once_stream(requests: DataFrame, running: DataFrame, again: str) -> DataFrame:
    """Start requests ``(correlation_id, ts, ...)`` on a stream, each correlation id once and none that is running.

    A request that comes again within ``again`` (such as "1 hour") of the first one is dropped; the state of a request
    leaves after that time. ``running`` is a table and read anew for every micro-batch.
    """
    once = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", again).dropDuplicatesWithinWatermark(["correlation_id"])
    return once.join(running.select("correlation_id").distinct(), "correlation_id", "left_anti")


def route(decisions: DataFrame, inputs: dict[str, str]) -> DataFrame:
    """A cancelled gate fails; any other starts its target with the input template and the document id."""
    given = [x for k, v in inputs.items() if k != "docId" for x in (F.lit(k), F.lit(v))]
    merged = F.create_map(*given, F.lit("docId"), F.col("doc_id").cast("string"))
    cancelled = F.col("reason") == "cancel"
    return decisions.select(
        "*", F.when(cancelled, "failed").otherwise("start").alias("action"), F.when(~cancelled, F.to_json(merged)).alias("inputs"))
