import glob
import hashlib
import json
import os
import shutil
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from firmlake.plans.products import ACCOUNTS, COMPANY, PSC
from firmlake.plans.promotion import Tables
from firmlake.plans.reports import processed_per_product
from firmlake.session import shared_folder
from firmlake.sources.logs import current_batches, file_log, ingestion_log, last_batch
from firmlake.streaming import ingest
from firmlake.streaming.ingest import ingest_available, load_files, load_manifest, pause, watch, watch_entries
from tests.test_products import INLINE, PSC_LINES, make_zip


def companies_zip(path, *rows):
    return make_zip(path, **{"c.csv": "CompanyNumber,CompanyName,CompanyStatus\n" + "".join(",".join(r) + "\n" for r in rows)})


def state(tables):
    rows = tables.companies.read().collect()
    return {r["company_number"]: (r["company_name"], r["change_detected"], r["batch_id"][-1]) for r in rows}


def test_incremental_files(spark, folder):
    landing, checkpoint = os.path.join(folder, "landing"), os.path.join(folder, "checkpoint")
    os.makedirs(landing)
    t = Tables.below(spark, os.path.join(folder, "tables"))
    companies_zip(os.path.join(landing, "a.zip"), ("00000001", "ONE", "Active"), ("00000002", "TWO", "Active"))
    with open(os.path.join(landing, "b.zip"), "wb") as f:
        f.write(b"broken")
    ingest_available(spark, t, COMPANY, landing, checkpoint)
    first = {"00000001": ("ONE", False, "0"), "00000002": ("TWO", False, "0")}
    assert state(t) == first
    log = current_batches(ingestion_log(spark, t.ingestion_log)).collect()
    assert [(r["status"], r["files_total"], r["files_completed"], r["companies_count"]) for r in log] == [("completed_with_errors", 2, 1, 2)]
    assert json.loads(log[0]["metadata"]) == {"rows": 3, "rejects": 1, "inserted": 2, "updated": 0, "skipped": 0}
    rejected = spark.read.parquet(f"{t.rejects}/load-{log[0]['batch_id']}").collect()
    assert len(rejected) == 1 and rejected[0]["archive"].endswith("b.zip")

    ingest_available(spark, t, COMPANY, landing, checkpoint)  # nothing new has landed
    assert state(t) == first and current_batches(ingestion_log(spark, t.ingestion_log)).count() == 1

    companies_zip(os.path.join(landing, "c.zip"), ("00000001", "ONE", "Active"), ("00000002", "TWO B", "Active"), ("00000003", "THREE", ""))
    ingest_available(spark, t, COMPANY, landing, checkpoint, compact_after=2)
    assert state(t) == {"00000001": ("ONE", False, "0"), "00000002": ("TWO B", True, "1"), "00000003": ("THREE", False, "1")}

    officers, oc = os.path.join(folder, "psc"), os.path.join(folder, "psc-checkpoint")
    os.makedirs(officers)
    make_zip(os.path.join(officers, "p.zip"), **{"p.json": "\n".join(PSC_LINES)})
    query = watch(spark, t, PSC, officers, oc)
    query.awaitTermination()
    assert {r["officer_name"] for r in t.officers.read().collect()} == {"Ms Ann Example", "Beta Holdings", "X", "Odd"}


def test_streams_with_checkpoints_of_one_name(spark, folder):
    """Neither another stream nor a new checkpoint at an old path may replace what was loaded."""
    t = Tables.below(spark, os.path.join(folder, "tables"))
    for name in ("a", "b"):
        os.makedirs(os.path.join(folder, name))
        companies_zip(os.path.join(folder, name, "f.zip"), (f"0000000{name}", name, "Active"))
        ingest_available(spark, t, COMPANY, os.path.join(folder, name), os.path.join(folder, f"cp{name}", "checkpoint"))
    assert {r["company_number"] for r in t.companies.read().collect()} == {"0000000a", "0000000b"}
    shutil.rmtree(os.path.join(folder, "cpa"))
    os.makedirs(os.path.join(folder, "c"))
    companies_zip(os.path.join(folder, "c", "f.zip"), ("0000000c", "c", "Active"))
    ingest_available(spark, t, COMPANY, os.path.join(folder, "c"), os.path.join(folder, "cpa", "checkpoint"))
    assert {r["company_number"] for r in t.companies.read().collect()} == {"0000000a", "0000000b", "0000000c"}
    assert len({r["batch_id"] for r in ingestion_log(spark, t.ingestion_log).collect()}) == 3


def test_progress_and_files_are_logged(spark, folder):
    t = Tables.below(spark, os.path.join(folder, "tables"))
    files = [companies_zip(os.path.join(folder, f"f{i}.zip"), *[(f"{i}{k:07d}", "N", "Active") for k in range(i + 1)]) for i in range(5)]
    with open(os.path.join(folder, "bad.zip"), "wb") as f:
        f.write(b"junk")
    paths = spark.createDataFrame([(p,) for p in [*files, os.path.join(folder, "bad.zip")]], "path string")
    seen = []
    old = ingest.log_batch
    ingest.log_batch = lambda s, f, row: (seen.append((row["status"], row["files_completed"], row.get("current_file"))), old(s, f, row))
    try:
        load_files(spark, t, COMPANY, paths, "b1", files_per_step=2)
    finally:
        ingest.log_batch = old
    assert [x[0] for x in seen] == ["running"] * (len(seen) - 1) + ["completed_with_errors"] and len(seen) > 2
    done = [x[1] for x in seen]
    assert done == sorted(done) and done[0] == 0 and done[-1] == 5 and 0 < done[1] < 5 and seen[1][2]
    logged = file_log(spark, t.file_log)
    assert {os.path.basename(r["file"]): (r["status"], r["rows"]) for r in logged.collect()} == {
        **{f"f{i}.zip": ("completed", i + 1) for i in range(5)}, "bad.zip": ("failed", 0)}
    assert processed_per_product(logged).first()["processed"] == 15
    left = glob.glob(f"{shared_folder(spark)}/firmlake/parsed-company-*")
    load_files(spark, t, COMPANY, paths.limit(2), "b2")
    assert glob.glob(f"{shared_folder(spark)}/firmlake/parsed-company-*") == left  # nothing of the load stays behind


def test_one_file_at_a_time_equals_one_batch(spark, folder):
    files = [[("00000001", "A", "Active"), ("00000002", "B", "Active")], [("00000001", "A2", "Active")], [("00000003", "C", "x"), ("00000002", "B", "Active")]]
    results = []
    for name, per_batch in (("single", 1), ("together", 10)):
        landing = os.path.join(folder, name)
        os.makedirs(landing)
        for i, rows in enumerate(files):
            path = companies_zip(os.path.join(landing, f"f{i}.zip"), *rows)
            os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
        t = Tables.below(spark, os.path.join(folder, f"{name}-tables"))
        ingest_available(spark, t, COMPANY, landing, os.path.join(folder, f"{name}-cp"), files_per_batch=per_batch)
        results.append({r["company_number"]: (r["company_name"], r["data_hash"]) for r in t.companies.read().collect()})
    assert results[0] == results[1] and results[0]["00000001"][0] == "A2"


def test_pause_then_resume(spark, folder):
    landing, checkpoint = os.path.join(folder, "landing"), os.path.join(folder, "checkpoint")
    os.makedirs(landing)
    for i in range(3):
        companies_zip(os.path.join(landing, f"f{i}.zip"), (f"0000000{i}", f"C{i}", "Active"))
    t = Tables.below(spark, os.path.join(folder, "tables"))
    paused = pause(spark, t, watch(spark, t, COMPANY, landing, checkpoint, files_per_batch=1))
    states = {r["batch_id"]: r["status"] for r in current_batches(ingestion_log(spark, t.ingestion_log)).collect()}
    assert paused and states[paused] == "paused" and set(states.values()) <= {"paused", "completed"}
    assert last_batch(ingestion_log(spark, t.ingestion_log), "paused").first()["batch_id"] == paused
    ingest_available(spark, t, COMPANY, landing, checkpoint, files_per_batch=1)
    assert {r["company_name"] for r in t.companies.read().collect()} == {"C0", "C1", "C2"}
    states = {r["batch_id"]: r["status"] for r in current_batches(ingestion_log(spark, t.ingestion_log)).collect()}
    assert states[paused] == "completed" and set(states.values()) == {"completed"}
    ended = watch(spark, t, COMPANY, landing, checkpoint)
    ended.awaitTermination()
    assert pause(spark, t, ended) is None


def test_custom_product(spark, folder):
    """A product with its own transform and hash fields."""
    c = companies_zip(os.path.join(folder, "c.zip"), ("00000001", "one", "Active"))
    paths = spark.createDataFrame([(c,)], "path string")
    upper = replace(COMPANY, transform=lambda df: df.withColumn("company_name", F.upper("company_name")), hash_fields=["company_name"])
    t = Tables.below(spark, os.path.join(folder, "tables"))
    load_files(spark, t, upper, paths, "b1")
    row = t.companies.read().first()
    assert (row["company_name"], row["data_hash"]) == ("ONE", hashlib.md5(b"ONE").hexdigest())


def test_manifest_load(spark, folder):
    t = Tables.below(spark, os.path.join(folder, "tables"))
    c = companies_zip(os.path.join(folder, "c.zip"), ("00000001", "ONE", "Active"), ("09652609", "NINE", "Active"))
    p = make_zip(os.path.join(folder, "p.zip"), **{"p.json": "\n".join(PSC_LINES)})
    a = make_zip(os.path.join(folder, "a.zip"), **{"Prod223_2125_09652609_20180331.html": INLINE})
    rows = [("accounts", a), ("psc", p), ("company", c), ("other", "x"), ("company", None)]
    states, bad = load_manifest(spark, t, spark.createDataFrame(rows, "product string, url string"), "b1")
    assert [s["status"] for s in states] == ["completed"] * 3
    assert sorted(r["violations"][0] for r in bad.collect()) == ["unknown_product", "url_missing"]
    assert [r["officer_name"] for r in t.officers.read().collect()] == ["Ms Ann Example"]
    assert t.financials.read().first()["company_number"] == "09652609"
    assert ACCOUNTS.name == "accounts"


def filings_zip(path, names):
    return make_zip(path, **{f"Prod223_2125_{n:08d}_20180331.html": INLINE for n in names})


def test_a_load_goes_on_inside_an_archive(spark, folder, monkeypatch):
    """A load that breaks off between entries repeats one batch of them, and ends as one load would."""
    landing = os.path.join(folder, "landing")
    os.makedirs(landing)
    filings_zip(os.path.join(landing, "a.zip"), range(1, 31))
    filings_zip(os.path.join(landing, "b.zip"), range(25, 41))
    with open(os.path.join(landing, "c.zip"), "wb") as f:
        f.write(b"junk")
    tables = [Tables.below(spark, os.path.join(folder, n)) for n in ("whole", "broken")]
    for t in tables:
        c = companies_zip(os.path.join(folder, "companies.zip"), *[(f"{n:08d}", "N", "Active") for n in range(1, 41)])
        load_files(spark, t, COMPANY, spark.createDataFrame([(c,)], "path string"), "c")
    ingest_available(spark, tables[0], ACCOUNTS, landing, os.path.join(folder, "cp0"))
    options = {"entries_per_block": 7, "blocks_per_batch": 1}
    listed, old = [], ingest.load_listed

    def broken(s, t, p, listing, batch_id):
        rows = [(r["archive"], r["entry"]) for r in listing.collect()]
        listed.append(rows)
        if len(listed) == 3:
            raise RuntimeError("the power is gone")
        return old(s, t, p, listing, batch_id)

    monkeypatch.setattr(ingest, "load_listed", broken)
    with pytest.raises(Exception, match="the power is gone"):
        watch_entries(spark, tables[1], ACCOUNTS, landing, os.path.join(folder, "cp1"), **options)
    done = tables[1].financials.read().count()
    assert 0 < done <= 14
    watch_entries(spark, tables[1], ACCOUNTS, landing, os.path.join(folder, "cp1"), **options)
    assert listed[2] == listed[3] and max(len(x) for x in listed) <= 7  # the broken batch again, the finished ones not
    flat = [x for k, rows in enumerate(listed) if k != 2 for x in rows]
    assert len(flat) == len(set(flat)) == 30 + 16 + 1
    want, got = ({(r["company_number"], str(r["period_end"]), r["data_hash"]) for r in t.financials.read().collect()} for t in tables)
    assert got == want and len(got) >= 40
    before = len(listed)
    watch_entries(spark, tables[1], ACCOUNTS, landing, os.path.join(folder, "cp1"), **options)
    assert len(listed) == before  # nothing is left to do
    with pytest.raises(ValueError):
        watch_entries(spark, tables[1], COMPANY, landing, os.path.join(folder, "cp2"))


def test_every_step_has_its_share(spark, folder):
    """Whatever the files are called, a step takes as many as it may, and the log moves with each step."""
    for name in ("a", "zz", "Q7"):
        t = Tables.below(spark, os.path.join(folder, name, "tables"))
        os.makedirs(os.path.join(folder, name, name))
        files = [companies_zip(os.path.join(folder, name, name, f"{name}{i}.zip"), (f"{i:08d}", "N", "Active")) for i in range(7)]
        load_files(spark, t, COMPANY, spark.createDataFrame([(p,) for p in files], "path string"), "b", files_per_step=3)
        logged = spark.read.parquet(t.ingestion_log).orderBy("logged_at").collect()
        assert [r["files_completed"] for r in logged] == [0, 3, 6, 7]
        times = [r["logged_at"] for r in file_log(spark, t.file_log).orderBy("logged_at").collect()]
        assert [sum(x <= r["logged_at"] for x in times) for r in logged[1:]] == [3, 6, 7]  # as the file log has it at each step


def test_loads_of_nothing(spark, folder):
    """Only junk, no files at all, no companies for the children: a load ends and says so."""
    t = Tables.below(spark, os.path.join(folder, "tables"))
    with open(os.path.join(folder, "bad.zip"), "wb") as f:
        f.write(b"junk")
    filed = filings_zip(os.path.join(folder, "good.zip"), [1])
    bad = spark.createDataFrame([(os.path.join(folder, "bad.zip"),)], "path string")
    assert load_files(spark, t, COMPANY, bad, "b1")["status"] == "completed_with_errors"
    assert load_files(spark, t, ACCOUNTS, bad, "b2")["status"] == "completed_with_errors"
    assert load_files(spark, t, ACCOUNTS, bad.limit(0), "b3")["status"] == "completed"
    orphaned = load_files(spark, t, ACCOUNTS, spark.createDataFrame([(filed,)], "path string"), "b4")
    assert json.loads(orphaned["metadata"]) == {"rows": 1, "rejects": 0, "inserted": 0, "updated": 0, "skipped": 1}
