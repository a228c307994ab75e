"""States of batches as a stream over the log: each row is a transition of its batch, and rows that make none are rejects.

``current_batches`` reads the whole log to say where each batch stands. Here a stateful stream keeps one state per batch and
reads only new rows. A load that is repeated runs again, whatever its state; everything else has one way.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from firmlake.operators.latest import latest_per_key
from firmlake.schemas import INGESTION_LOG

# States of a batch, and those that may follow each; the empty text stands for a batch that has none yet.
FOLLOWS = {
    "": ["running", "paused"],
    "running": ["running", "paused", "completed", "completed_with_errors", "failed"],
    "paused": ["running", "paused"],
    "completed": ["running"],
    "completed_with_errors": ["running"],
    "failed": ["running"],
}
TRANSITIONS = "batch_id string, status string, previous string, logged_micros long, reject string"


def _order(row: tuple) -> tuple:
    """By time, then state; missing ones first."""
    micros, status = row
    return micros is not None, micros or 0, status is not None, status or ""


class Transitions(StatefulProcessor):
    """Keeps a batch's state and its time; gives a row per log row, with a reason if it is no transition."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, logged_micros long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, at = self.state.get() if self.state.exists() else ("", None)
        # A batch has few rows in a micro-batch: building a frame for each batch would cost more than all else.
        for micros, new in sorted(((r["logged_micros"], r["status"]) for r in rows), key=_order):
            reason = None
            if micros is None or new is None:
                reason = "no state or time"
            elif at is not None and micros < at:
                reason = "late"
            elif new not in FOLLOWS[status]:
                reason = f"{new} after {status or 'nothing'}"
            yield Row(batch_id=key[0], status=new, previous=status, logged_micros=micros, reject=reason)
            if reason is None:
                status, at = new, micros
        if at is not None:
            self.state.update((status, at))

    def close(self) -> None:
        pass


def follow(spark: SparkSession, log: str, states: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Take in what was logged since the last call: transitions and rejects are added to the folder ``states``.

    Rows of one micro-batch are ordered by their time, whatever file they come from.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.readStream.schema(INGESTION_LOG).option("maxFilesPerTrigger", files_per_batch).parquet(log)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', logged_at)")
    moves = rows.select("batch_id", "status", micros.alias("logged_micros")).groupBy("batch_id").transformWithState(
        statefulProcessor=Transitions(), outputStructType=TRANSITIONS, outputMode="Append", timeMode="None"
    )

    def store(found: DataFrame, epoch: int) -> None:
        found.write.mode("overwrite").parquet(f"{states.rstrip('/')}/epoch={epoch}")  # a repeated epoch replaces its rows

    moves.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def transitions(spark: SparkSession, states: str) -> DataFrame:
    stamp = F.expr("timestampadd(MICROSECOND, logged_micros, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return spark.read.schema(f"{TRANSITIONS}, epoch long").parquet(states).withColumn("logged_at", stamp)


def batch_states(spark: SparkSession, states: str) -> DataFrame:
    """``batch_id, status, logged_at``: where each batch stands."""
    done = transitions(spark, states).where("reject is null")
    order = ["logged_micros", "epoch"]
    return latest_per_key(done, ["batch_id"], order).select("batch_id", "status", "logged_at")


def rejected_rows(spark: SparkSession, states: str) -> DataFrame:
    """``batch_id, status, previous, logged_at, reject``: log rows that are no transition."""
    return transitions(spark, states).where("reject is not null").select("batch_id", "status", "previous", "logged_at", "reject")
