import datetime as dt
import os
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from firmlake.operators.expectations import contact_rules, financial_rules, split
from firmlake.operators.joins import flag_existing, guard_orphans, orphans
from firmlake.operators.latest import latest_per_key
from firmlake.operators.upsert import changes, upsert
from firmlake.sources.tables import KeyedTable

TARGET = "k string, v string, data_hash string, change_detected boolean, batch_id string, first_seen string"


def load(spark, rows):
    return spark.createDataFrame([(k, f"v-{h}", h) for k, h in rows], "k string, v string, data_hash string")


def apply(spark, state, rows, batch):
    got = upsert(state, load(spark, rows), ["k"], stamps={"batch_id": F.lit(batch), "first_seen": F.lit(batch)},
                 kept=["first_seen"]).collect()
    actions = {r["k"]: r["action"] for r in got}
    return spark.createDataFrame([tuple(r)[:-1] for r in got], TARGET), actions


def test_upsert_sequence(spark):
    state = spark.createDataFrame([], TARGET)
    state, actions = apply(spark, state, [("1", "h1"), ("2", "h2")], "b1")
    assert actions == {"1": "insert", "2": "insert"}
    state, actions = apply(spark, state, [("1", "h1"), ("2", "h2x"), ("3", "h3")], "b2")
    assert actions == {"1": "skip", "2": "update", "3": "insert"}
    expected = {("1", "h1", "b1", False, "b1"), ("2", "h2x", "b2", True, "b1"), ("3", "h3", "b2", False, "b2")}
    seen = lambda s: {(r["k"], r["data_hash"], r["batch_id"], r["change_detected"], r["first_seen"]) for r in s.collect()}
    assert seen(state) == expected
    state, actions = apply(spark, state, [("1", "h1"), ("2", "h2x"), ("3", "h3")], "b2")
    assert set(actions.values()) == {"skip"} and seen(state) == expected
    state, actions = apply(spark, state, [("3", "h3")], "b3")
    assert actions == {"1": "keep", "2": "keep", "3": "skip"} and seen(state) == expected


loads = st.lists(st.dictionaries(st.sampled_from("abcde"), st.sampled_from("xyz"), max_size=5), min_size=1, max_size=3)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(loads)
def test_upsert_is_a_fold_and_table_agrees(spark, folder, batches):
    import uuid

    table = KeyedTable(spark, f"{folder}/{uuid.uuid4().hex}", spark.createDataFrame([], TARGET).schema, ["k"])
    state = {}
    for n, batch in enumerate(batches):
        name = f"b{n}"
        stamps = {"batch_id": F.lit(name), "first_seen": F.lit(name)}
        rows = changes(table.read(), load(spark, list(batch.items())), ["k"], stamps=stamps, kept=["first_seen"])
        table.write_changes(rows.where("action in ('insert', 'update')"), name)
        if n == 1:
            table.compact()
        for k, h in batch.items():
            if k not in state:
                state[k] = (h, name, False, name)
            elif state[k][0] != h:
                state[k] = (h, name, True, state[k][3])
    got = {r["k"]: (r["data_hash"], r["batch_id"], r["change_detected"], r["first_seen"]) for r in table.read().collect()}
    assert got == state


def test_table_repeats_and_ignores_unfinished_writes(spark, folder):
    schema = spark.createDataFrame([], "k string, v string").schema
    table = KeyedTable(spark, f"{folder}/t", schema, ["k"])
    assert table.read().count() == 0 and table.version_for("x") == 1
    rows = spark.createDataFrame([("a", "1")], schema)
    assert table.write_changes(rows, "x") == 1 and table.write_changes(rows, "x") == 1
    os.makedirs(f"{folder}/t/changes-000000002-broken")
    assert table.write_changes(spark.createDataFrame([("a", "2"), (None, "n")], schema), "y") == 3
    assert sorted(map(tuple, table.read().collect()), key=str) == [("a", "2"), (None, "n")]
    assert [tuple(r) for r in table.read(before=3).collect()] == [("a", "1")]
    assert table.compact() and not table.compact()
    table.write_changes(spark.createDataFrame([(None, "m")], schema), "z")
    assert sorted(map(tuple, table.read().collect()), key=str) == [("a", "2"), (None, "m")]


def test_a_repeat_after_compaction_is_stored(spark, folder):
    schema = spark.createDataFrame([], "k string, v string").schema
    table = KeyedTable(spark, f"{folder}/t", schema, ["k"])
    assert table.write_changes(spark.createDataFrame([("a", "1"), ("b", "1")], schema), "b1") == 1
    assert table.compact()
    assert table.write_changes(spark.createDataFrame([("a", "2")], schema), "b1") == 2
    assert sorted(map(tuple, table.read().collect())) == [("a", "2"), ("b", "1")]
    assert table.write_changes(spark.createDataFrame([("a", "3")], schema), "b1") == 2  # not covered yet: replaced
    assert table.compact() and sorted(map(tuple, table.read().collect())) == [("a", "3"), ("b", "1")]
    table.write_changes(spark.createDataFrame([("c", "1")], schema), "b3")
    assert table.compact() and len(table.read().collect()) == 3
    assert sorted(os.listdir(f"{folder}/t")) == ["changes-000000003-b3", "full-000000002", "full-000000003"]


def test_the_first_change_set_is_not_sorted(spark, folder, capsys):
    schema = spark.createDataFrame([], "k string, v string").schema
    table = KeyedTable(spark, f"{folder}/t", schema, ["k"])
    table.read().join(spark.range(5), F.col("k") == F.col("id")).explain()
    assert "Join" not in capsys.readouterr().out  # an empty table is known to be empty
    sets = [[("a", "1"), ("b", "1"), (None, "1")], [("a", "2"), (None, "2")], [("a", "3"), ("c", "3")]]
    table.write_changes(spark.createDataFrame(sets[0], schema), "changes-1")
    table.write_changes(spark.createDataFrame(sets[1], schema), "changes-2")
    table.read().explain()
    assert "Window" not in capsys.readouterr().out
    table.write_changes(spark.createDataFrame(sets[2], schema), "x")
    assert sorted(map(tuple, table.read().collect()), key=str) == [("a", "3"), ("b", "1"), ("c", "3"), (None, "2")]
    assert sorted(map(tuple, table.read(before=3).collect()), key=str) == [("a", "2"), ("b", "1"), (None, "2")]


def test_versions_of_any_length(spark, folder):
    schema = spark.createDataFrame([], "k string").schema
    table = KeyedTable(spark, f"{folder}/t", schema, ["k"])
    spark.createDataFrame([("a",)], schema).write.parquet(f"{folder}/t/changes-9999999999-x")
    assert table.write_changes(spark.createDataFrame([("b",)], schema), "y") == 10_000_000_000
    assert sorted(r["k"] for r in table.read().collect()) == ["a", "b"]


def test_adaptive_execution_splits_a_hot_parent(spark):
    many = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 9000).cast("string")).alias("company_number"), "id", F.lit("x" * 40).alias("pad"))
    one = spark.range(9000).select(F.col("id").cast("string").alias("company_number")).union(spark.createDataFrame([("hot",)], "company_number string"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        kept = guard_orphans(many, one)
        assert len(kept.collect()) == 300_000
        assert "skewed" in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_orphans_and_flags(spark):
    rows = spark.createDataFrame([("1", 1), ("9", 2), (None, 3)], "company_number string, n int")
    parents = spark.createDataFrame([("1",), ("2",)], "company_number string")
    assert [r["n"] for r in guard_orphans(rows, parents).collect()] == [1]
    assert sorted(r["n"] for r in orphans(rows, parents).collect()) == [2, 3]
    flagged = flag_existing(rows, parents.union(parents), "company_number", "known").collect()
    assert {r["n"]: r["known"] for r in flagged} == {1: True, 2: False, 3: False}


def test_latest_runs_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    latest = latest_per_key(df, ["k"], ["id"])
    assert {(r["k"], r["id"]) for r in latest.collect()} == {(0, 99), (1, 97), (2, 98)}
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_expectations(spark):
    rows = [("1", dt.date(2020, 1, 1), dt.date(2020, 1, 1), "x"), ("1", dt.date(2019, 1, 1), dt.date(2020, 1, 1), "x"), ("1", None, dt.date(2020, 1, 1), "x")]
    df = spark.createDataFrame(rows, "company_number string, period_start date, period_end date, source string")
    good, bad = split(df, financial_rules(df))
    assert good.count() == 1
    assert sorted(r["violations"][0] for r in bad.collect()) == ["period_not_positive", "period_start_missing"]
    contacts = spark.createDataFrame([(Decimal("0.49"), "a"), (Decimal("0.50"), "a")], "confidence_score decimal(3,2), source string")
    assert split(contacts, contact_rules(contacts))[1].count() == 1
