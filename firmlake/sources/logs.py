"""Append-only logs: one folder of small Parquet files each, so reading a log is one listing.

A state that is written twice, by a repeated task or run, counts once: reading keeps the last row of a batch's state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake.operators.latest import latest_per_key
from firmlake.schemas import FILE_LOG, INGESTION_LOG, MERGE_LOG


def _append(spark: SparkSession, folder: str, schema: T.StructType, row: dict) -> None:
    values = tuple(row.get(f.name) for f in schema)
    spark.createDataFrame([values], schema).coalesce(1).write.mode("append").parquet(folder)


def _read(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def log_batch(spark: SparkSession, folder: str, row: dict) -> None:
    """Record a batch state: running (with its progress), paused, completed, completed_with_errors or failed."""
    _append(spark, folder, INGESTION_LOG, row)


def ingestion_log(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each state of each batch."""
    return latest_per_key(_read(spark, folder, INGESTION_LOG), ["batch_id", "status"], ["logged_at"])


def log_merge(spark: SparkSession, folder: str, row: dict) -> None:
    _append(spark, folder, MERGE_LOG, row)


def merge_log(spark: SparkSession, folder: str) -> DataFrame:
    """The last merge of each batch."""
    return latest_per_key(_read(spark, folder, MERGE_LOG), ["batch_id"], ["merged_at"])


def log_files(files: DataFrame, folder: str) -> None:
    """Record files of a batch as a frame of FILE_LOG's columns."""
    files.select(*FILE_LOG.names).coalesce(1).write.mode("append").parquet(folder)


def file_log(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each file of each batch."""
    return latest_per_key(_read(spark, folder, FILE_LOG), ["batch_id", "file"], ["logged_at"])


def current_batches(log: DataFrame) -> DataFrame:
    """Latest state of every batch."""
    return latest_per_key(log, ["batch_id"], ["logged_at"])


def last_batch(log: DataFrame, status: str | None = None) -> DataFrame:
    """The most recently started batch, or the most recent one in a given state."""
    batches = current_batches(log)
    if status:
        batches = batches.where(F.col("status") == status)
    return batches.orderBy(F.desc_nulls_last("started_at"), "batch_id").limit(1)
