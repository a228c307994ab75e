import datetime as dt
import os

from firmlake.plans.promotion import Tables
from firmlake.sources.logs import current_batches, ingestion_log, log_batch
from firmlake.streaming.states import batch_states, follow, rejected_rows


def at(n):
    return dt.datetime(2026, 1, 1, 0, 0, n)


def test_states_follow_the_log(spark, folder):
    t = Tables.below(spark, os.path.join(folder, "tables"))
    log, states, checkpoint = t.ingestion_log, os.path.join(folder, "states"), os.path.join(folder, "checkpoint")

    def write(batch, status, n):
        log_batch(spark, log, {"batch_id": batch, "status": status, "started_at": at(0), "logged_at": at(n)})

    for n, (batch, status) in enumerate([("a", "running"), ("b", "running"), ("a", "running"), ("a", "completed"), ("c", "paused")]):
        write(batch, status, n)
    follow(spark, log, states, checkpoint)

    def now():
        return {r["batch_id"]: (r["status"], r["logged_at"]) for r in batch_states(spark, states).collect()}

    def logged():
        return {r["batch_id"]: (r["status"], r["logged_at"]) for r in current_batches(ingestion_log(spark, log)).collect()}

    assert now() == logged() and rejected_rows(spark, states).count() == 0
    write("b", "failed", 10)
    write("c", "running", 11)
    write("c", "completed_with_errors", 12)
    follow(spark, log, states, checkpoint)
    assert now() == logged() == {"a": ("completed", at(3)), "b": ("failed", at(10)), "c": ("completed_with_errors", at(12))}
    write("a", "paused", 13)  # a batch that is done cannot pause
    write("b", "completed", 14)  # nor can a failed one complete
    write("d", "completed", 15)  # or one that never ran
    write("c", "running", 5)  # this was overtaken
    follow(spark, log, states, checkpoint)
    follow(spark, log, states, checkpoint)
    assert now() == {"a": ("completed", at(3)), "b": ("failed", at(10)), "c": ("completed_with_errors", at(12))}
    bad = sorted((r["batch_id"], r["reject"]) for r in rejected_rows(spark, states).collect())
    assert bad == [("a", "paused after completed"), ("b", "completed after failed"), ("c", "late"), ("d", "completed after nothing")]
    write("a", "running", 16)  # a repeated load
    follow(spark, log, states, checkpoint)
    assert now()["a"] == ("running", at(16))


def test_rows_of_one_micro_batch_are_ordered_whole(spark, folder):
    """Whatever pieces they reach the task in, and whatever their order in the file."""
    rows = spark.range(60, numPartitions=1).selectExpr(
        "'a' AS batch_id", "CASE WHEN id % 2 = 0 THEN 'paused' ELSE 'running' END AS status", "TIMESTAMP_NTZ'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, 100 - id) AS logged_at"
    )
    rows.write.parquet(f"{folder}/log")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        follow(spark, f"{folder}/log", f"{folder}/states", f"{folder}/checkpoint")
    finally:
        spark.conf.set(key, before)
    assert rejected_rows(spark, f"{folder}/states").count() == 0
    assert batch_states(spark, f"{folder}/states").first()["logged_at"] == dt.datetime(2026, 1, 1, 0, 1, 40)
