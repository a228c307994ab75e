import datetime as dt
import os
import random

from pyspark.sql import functions as F

from firmlake import schemas
from firmlake.operators.maintain import Summary
from firmlake.plans import reports
from firmlake.plans.maintained import Reports
from firmlake.plans.promotion import Tables
from firmlake.plans.search import active_officers
from firmlake.schemas import conform
from firmlake.sources.tables import KeyedTable

SCHEMA = "k long, colour string, day date, payload string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def whole(table):
    return rows_of(table.read().where("colour <> 'none'").groupBy("colour", "day").agg(F.count("*").alias("n_rows")))


def test_counts_follow_inserts_updates_and_repeats(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    table = KeyedTable(spark, os.path.join(folder, "t"), schema, ["k"], ["colour", "day"])
    summary = Summary(table, os.path.join(folder, "s"), {"colour": "colour", "day": "day"}, "colour <> 'none'")
    rng = random.Random(5)

    def load(label, n=25):
        rows = [(k, rng.choice(["red", "blue", "none", None]), dt.date(2024, 1, rng.randint(1, 3)), label) for k in rng.sample(range(60), n)]
        table.write_changes(spark.createDataFrame(rows + ([(None, "red", None, "x")] if n > 20 else []), schema), label)

    load("a")
    assert summary.refresh() == "table"  # nothing is known yet
    for step, label in enumerate(["b", "c", "c", "d"]):  # c is loaded twice
        load(label)
        assert summary.refresh() == "changes", label
        assert rows_of(summary.read()) == whole(table), label
        assert summary.refresh() == "nothing"
    load("e", 5)
    load("f", 5)
    assert summary.refresh() == "changes" and rows_of(summary.read()) == whole(table)
    load("b")  # an old load again, with others after it
    assert summary.refresh() == "table" and rows_of(summary.read()) == whole(table)
    load("g")
    assert table.compact()
    load("h")
    assert summary.refresh() == "changes" and rows_of(summary.read()) == whole(table)
    assert summary.compact(1) and rows_of(summary.read()) == whole(table)
    load("i")
    table.compact()
    load("j")
    table.compact()
    load("k")
    table.compact()  # the change set of i is gone now
    assert summary.refresh() == "table" and rows_of(summary.read()) == whole(table)


def test_a_refresh_reads_change_sets_only(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    table = KeyedTable(spark, os.path.join(folder, "t"), schema, ["k"], ["colour", "day"])
    summary = Summary(table, os.path.join(folder, "s"), {"colour": "colour"})
    table.write_changes(spark.createDataFrame([(k, "red", None, "") for k in range(50)], schema), "a")
    table.compact()
    summary.refresh()
    table.write_changes(spark.createDataFrame([(1, "blue", None, ""), (99, "blue", None, "")], schema), "b")
    _, sets = table.change_sets()
    _, label, after, before = sets[-1]
    read = {os.path.basename(os.path.dirname(f)) for f in summary._difference(after, before).inputFiles()}
    assert label == "b" and all(r.startswith(("changes-", "before-")) and r.endswith("-b") for r in read) and len(read) == 2
    assert summary.refresh() == "changes" and rows_of(summary.read()) == [("blue", 2), ("red", 49)]


def test_a_change_set_without_the_rows_before_is_counted_anew(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    table = KeyedTable(spark, os.path.join(folder, "t"), schema, ["k"])
    summary = Summary(table, os.path.join(folder, "s"), {"colour": "colour"})
    table.write_changes(spark.createDataFrame([(1, "red", None, "")], schema), "a")
    assert summary.refresh() == "table"
    table.write_changes(spark.createDataFrame([(1, "blue", None, "")], schema), "b")
    assert summary.refresh() == "table" and rows_of(summary.read()) == [("blue", 1)]


def test_reports_equal_the_counted_ones(spark, folder):
    t = Tables.below(spark, os.path.join(folder, "tables"))
    r = Reports.of(t, os.path.join(folder, "reports"))
    at = lambda n: dt.datetime(2024, 1, n)

    def companies(rows):
        df = spark.createDataFrame(rows, "company_number string, company_name string, locality string, sic_codes array<string>, needs_review boolean, "
                                   "merged_at timestamp_ntz, change_detected boolean, ingested_at timestamp_ntz, last_updated timestamp_ntz")  # fmt: skip
        return conform(df, schemas.STAGING_COMPANIES)

    t.companies.write_changes(companies([(f"{k}", "N" if k % 3 else "", "L" if k % 2 else None, [], k == 4, None, False, at(1), at(k + 1)) for k in range(8)]), "a")
    officers = spark.createDataFrame([(f"{k % 3}", f"O{k}", None if k % 2 else dt.date(2024, 1, 1)) for k in range(9)], "company_number string, officer_name string, resigned_on date")
    t.officers.write_changes(conform(officers, schemas.STAGING_OFFICERS), "a")
    t.financials.write_changes(conform(spark.createDataFrame([("1", dt.date(2024, 1, 1), at(3))], "company_number string, period_end date, ingested_at timestamp_ntz"), schemas.STAGING_FINANCIALS), "a")
    r.refresh()
    t.companies.write_changes(companies([("7", "N", "L", ["1"], False, at(9), True, at(1), at(2)), ("9", None, None, None, None, None, None, None, None)]), "b")
    t.officers.write_changes(conform(officers.where("officer_name <= 'O1'").withColumn("resigned_on", F.lit(dt.date(2024, 2, 2))), schemas.STAGING_OFFICERS), "b")
    assert r.refresh() == ["changes", "nothing", "changes", "changes"]
    c, o, f = t.companies.read(), t.officers.read(), t.financials.read()
    assert rows_of(r.data_quality()) == rows_of(reports.data_quality(c))  # the newest row's time is gone and the one before counts
    assert rows_of(r.pending_merge()) == rows_of(reports.pending_merge(c, f))
    assert rows_of(r.table_status()) == rows_of(reports.table_status(c, o, f))
    assert rows_of(r.active_officers()) == rows_of(active_officers(o).where("active_officers > 0"))
