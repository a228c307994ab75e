import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from firmlake import schemas
from firmlake.plans import promotion, reports, validation
from firmlake.plans import search as s
from firmlake.plans.search import Filters
from firmlake.schemas import conform
from firmlake.sources.logs import ingestion_log, last_batch, log_batch, merge_log
from firmlake.sources.manifest import choose, manifest

NOW = dt.datetime(2026, 1, 1)


def matches(spark, schema, rows, predicate):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    kept = {r["i"] for r in df.where(predicate).collect()}
    return [i in kept for i in range(len(rows))]


def test_filters(spark):
    sic = [(["62012"],), (["47110"],), (["47110", "63110"],), ([],)]
    assert matches(spark, "sic_codes array<string>", sic, s.industry("tech")) == [True, False, True, False]
    assert matches(spark, "sic_codes array<string>", [(["62012"],), (["620"],)], s.industry("62012")) == [True, False]
    places = [("LEEDS", None), (None, "West Leeds"), (None, None)]
    assert matches(spark, "locality string, region string", places, s.location("leeds")) == [True, True, False]
    for code in ("0-1m", "1m-10m"):
        assert matches(spark, "turnover double", [(1_000_000.0,)], s.revenue(code)) == [True]
    profit = [(-10000.0,), (10000.0,), (10000.01,)]
    assert matches(spark, "profit_after_tax double", profit, s.profitability("breakeven")) == [True, True, False]
    debt = [(Decimal(30), Decimal(100)), (Decimal(30), Decimal(0))]
    assert matches(spark, "total_liabilities decimal(15,2), total_assets decimal(15,2)", debt, s.debt_level("medium")) == [True, False]
    born = [(dt.date(2021, 1, 1),), (dt.date(2023, 12, 31),), (dt.date(2024, 1, 1),)]
    assert matches(spark, "incorporation_date date", born, s.company_age("3-5", 2026)) == [True, True, False]
    assert s.revenue("nonsense") is None and s.location("") is None and s.company_status("all") is None


def tables(spark):
    companies = [(f"{i:08d}", f"COMPANY {i}", "active" if i < 8 else "dissolved", ["62012"], "b1", False) for i in range(1, 10)]
    c = conform(spark.createDataFrame(companies, "company_number string, company_name string, company_status string, sic_codes array<string>, batch_id string, needs_review boolean"), schemas.STAGING_COMPANIES)
    f = conform(spark.createDataFrame(
        [("00000001", dt.date(2019, 1, 1), dt.date(2020, 1, 1), "10"), ("00000001", dt.date(2020, 1, 1), dt.date(2021, 1, 1), "20"), ("00000002", None, dt.date(2021, 1, 1), "30")],
        "company_number string, period_start date, period_end date, turnover string"), schemas.STAGING_FINANCIALS)
    o = conform(spark.createDataFrame(
        [("00000001", "A", None, "director"), ("00000001", "B", dt.date(2020, 1, 1), ""), ("00000003", None, None, "x"), ("99999999", "Z", None, "x")],
        "company_number string, officer_name string, resigned_on date, officer_role string"), schemas.STAGING_OFFICERS)
    return c, f, o


def test_paging_and_response(spark):
    c, f, o = tables(spark)
    profiles = s.company_profiles(c, f, o)
    page = s.search_page(profiles, Filters(limit=3, offset=6)).collect()
    assert [r["company_name"] for r in page] == ["COMPANY 7"] and page[0]["active_officers_count"] == 0
    response = s.search_response(profiles, Filters(limit=3, offset=6))
    assert (response["total"], response["has_more"], len(response["companies"])) == (7, False, 1)
    assert '"company_number":"00000007"' in response["companies"][0]
    assert s.search_response(profiles, Filters(limit=3))["has_more"] is True
    assert s.search_count(profiles, Filters(employees="1-10")).first()["total"] == 2
    first = s.company_by_number(c, f, o, "00000001").first()
    assert (first["turnover"], first["active_officers_count"], first["industry_category"]) == (Decimal("20.00"), 1, "tech")
    by_turnover = s.search_page(profiles, Filters(order_by="turnover", limit=3)).collect()
    assert [r["company_number"] for r in by_turnover] == ["00000001", "00000002", "00000003"]  # NULLs last
    assert [r["company_name"] for r in s.search_page(profiles, Filters(order_by="c.company_name", limit=1)).collect()] == ["COMPANY 1"]


def test_paging_by_key_gives_the_same_pages(spark):
    c, f, o = tables(spark)
    profiles = s.company_profiles(c, f, o)
    for order, column in (("company_name", "company_name"), ("turnover", "turnover"), ("employees", "active_officers_count")):
        for descending in (False, True):
            whole = s.search_page(profiles, Filters(order_by=order, descending=descending)).collect()
            got, after = [], None
            while page := s.search_page(profiles, Filters(order_by=order, descending=descending, limit=3, after=after)).collect():
                got += page
                after = (page[-1][column], page[-1]["company_number"])
            assert [r["company_number"] for r in got] == [r["company_number"] for r in whole]


def test_review_and_scores(spark):
    c, _, o = tables(spark)
    report = validation.validate_batch(c, o, "b1")
    kinds = {i["type"]: i["severity"] for i in report["issues"]}
    assert report["companies_checked"] == 9 and report["officers_checked"] == 3
    assert kinds == {"missing_locality": "warning", "missing_officer_name": "warning", "missing_officer_role": "warning", "missing_appointment_date": "info"}
    assert report["quality_score"] == 1.0
    mixed = spark.createDataFrame([("error",), ("warning",), ("warning",)], "severity string")
    assert abs(validation.score_of(mixed).first()[0] - 2 / 3) < 1e-9
    assert validation.score_of(mixed.where("false")).first()[0] == 1.0
    unnamed = c.withColumn("company_name", F.when(F.col("company_number") != "00000002", F.col("company_name")))
    marked = validation.mark_for_review(unnamed, "b1")
    assert marked.where("marked").count() == 1
    row = marked.where("needs_review").first()
    assert row["review_notes"] == "Missing critical data: company_name "
    queue = reports.review_queue(marked, o, "b1").collect()
    assert [(r["company_number"], r["officer_count"]) for r in queue] == [("00000002", 0)]
    custom = validation.mark_for_review(c, None, {"dissolved": F.col("company_status") == "dissolved"})
    assert custom.where("marked").count() == 2


def test_promotion(spark, folder):
    t = promotion.Tables.below(spark, folder)
    c, f, o = tables(spark)
    for table, rows in ((t.companies, c), (t.financials, f), (t.officers, o)):
        table.write_changes(rows, "start")
    stamp = F.lit(NOW)
    dry = promotion.merge_batch(spark, t, "b1", stamp, dry_run=True)
    assert dry["stats"] == {"companies_merged": 9, "officers_merged": 2, "financials_merged": 3}
    assert t.production_companies.read().count() == 0
    done = promotion.merge_batch(spark, t, "b1", stamp)
    assert done["stats"] == {"companies_merged": 9, "companies_updated": 0, "officers_merged": 2, "financials_merged": 2, "contacts_merged": 0}
    assert {r["officer_role"] for r in t.production_officers.read().collect()} == {"director", "unknown"}
    assert t.companies.read().where("merged_at is null").count() == 0
    assert t.officers.read().where("merged_at is not null").count() == 2
    # A period without a start broke a rule: it is not marked, and it waits.
    assert [r["company_number"] for r in t.financials.read().where("merged_at is null").collect()] == ["00000002"]
    assert [r["batch_id"] for r in merge_log(spark, t.merge_log).collect()] == ["b1"]
    reasons = spark.read.parquet(f"{t.rejects}/promotion-b1-financials").collect()
    assert [r["reason"] for r in reasons] == ["period_start_missing"]
    again = promotion.merge_batch(spark, t, "b1", F.lit(dt.datetime(2026, 2, 1)))
    assert (again["stats"]["companies_merged"], again["stats"]["companies_updated"]) == (0, 9)  # by key: nothing comes twice
    assert t.production_companies.read().count() == 9
    c2 = c.where("company_number = '00000001'").withColumns({"company_name": F.lit("NEW NAME"), "batch_id": F.lit("b2")})
    t.companies.write_changes(c2, "second")
    done = promotion.merge_batch(spark, t, "b2", F.lit(dt.datetime(2026, 3, 1)))
    assert done["stats"]["companies_updated"] == 1
    row = t.production_companies.read().where("company_number = '00000001'").first()
    assert (row["company_name"], row["first_seen"], row["last_updated"]) == ("NEW NAME", NOW, dt.datetime(2026, 3, 1))
    bad = c.withColumns({"company_number": F.concat(F.lit("X"), "company_number"), "company_name": F.lit(None).cast("string"),
                         "locality": F.lit("L"), "batch_id": F.lit("b3")})
    t.companies.write_changes(bad, "third")
    refused = promotion.merge_batch(spark, t, "b3", stamp)
    assert refused["status"] == "failed" and refused["reason"] == "quality_score_too_low"


def test_promotion_marks_only_what_it_stored(spark, folder):
    t = promotion.Tables.below(spark, folder)
    c, f, o = tables(spark)
    c = c.withColumns({
        "company_status": F.when(F.col("company_number") != "00000004", F.col("company_status")),
        "needs_review": F.col("company_number") == "00000001", "locality": F.lit("L"),
    })
    f = f.withColumn("period_start", F.coalesce("period_start", F.lit(dt.date(2020, 6, 1))))
    f = f.unionByName(f.where("company_number = '00000002'").withColumn("company_number", F.lit("00000004")))
    for table, rows in ((t.companies, c), (t.financials, f), (t.officers, o)):
        table.write_changes(rows, "start")
    promotion.merge_batch(spark, t, "b1", F.lit(NOW))
    waiting = {r["company_number"] for r in t.companies.read().where("merged_at is null").collect()}
    assert waiting == {"00000001", "00000004"}  # one under review, one that broke a rule
    assert {r["company_number"] for r in t.financials.read().where("merged_at is null").collect()} == {"00000001", "00000004"}
    lost = spark.read.parquet(f"{t.rejects}/promotion-b1-financials").collect()
    assert [(r["company_number"], r["reason"]) for r in lost] == [("00000004", "company_not_in_production")]
    # The review is over: the same batch again picks the company and its children up.
    cleared = t.companies.read().where("company_number = '00000001'").withColumn("needs_review", F.lit(False))
    t.companies.write_changes(cleared, "review")
    again = promotion.merge_batch(spark, t, "b1", F.lit(dt.datetime(2026, 2, 1)))
    assert (again["stats"]["companies_merged"], again["stats"]["companies_updated"]) == (1, 7)
    assert t.production_companies.read().count() == 8
    assert {r["company_number"] for r in t.companies.read().where("merged_at is null").collect()} == {"00000004"}


def test_a_load_during_a_promotion_keeps_its_rows(spark, folder, monkeypatch):
    """What a load commits between selection and marks is neither overwritten nor marked; a load in hand stops the marks."""
    t = promotion.Tables.below(spark, folder)
    c, f, o = tables(spark)
    c = c.withColumns({"needs_review": F.lit(False), "locality": F.lit("L"), "company_status": F.lit("active")})
    for table, rows in ((t.companies, c), (t.financials, f), (t.officers, o)):
        table.write_changes(rows, "start")
    late = c.where("company_number = '00000002'").withColumns({"company_name": F.lit("RENAMED"), "last_updated": F.lit(dt.datetime(2026, 3, 1)).cast("timestamp_ntz")})
    old = t.production_companies.write_changes

    def meanwhile(rows, label):
        version = old(rows, label)
        t.companies.write_changes(late, "late")
        return version

    monkeypatch.setattr(t.production_companies, "write_changes", meanwhile)
    promotion.merge_batch(spark, t, "b1", F.lit(NOW))
    staged = {r["company_number"]: (r["company_name"], r["merged_at"]) for r in t.companies.read().collect()}
    assert staged["00000002"] == ("RENAMED", None)
    assert [n for n, (_, at) in staged.items() if at is None] == ["00000002"]
    monkeypatch.setattr(t.production_companies, "write_changes", old)
    os.makedirs(os.path.join(t.companies.path, "changes-000000099-other"))
    with pytest.raises(RuntimeError, match="being written"):
        promotion.merge_batch(spark, t, "b1", F.lit(NOW))
    assert t.companies.read().where("company_number = '00000002'").first()["merged_at"] is None


def test_review_marks_are_stored(spark, folder):
    t = promotion.Tables.below(spark, folder)
    c, _, _ = tables(spark)
    t.companies.write_changes(c.withColumn("company_name", F.when(F.col("company_number") != "00000002", F.col("company_name"))), "start")
    assert validation.mark_table(t.companies, "b1") == 1 and validation.mark_table(t.companies, "b9") == 0
    row = t.companies.read().where("needs_review").first()
    assert (row["company_number"], row["review_notes"]) == ("00000002", "Missing critical data: company_name ")


def test_a_backslash_is_a_letter(spark):
    df = spark.createDataFrame([("A\\B LTD",), ("AB LTD",), ("A%B",)], "company_name string")
    assert [r[0] for r in df.where(s.search_term("a\\b")).collect()] == ["A\\B LTD"]
    assert df.where(s.search_term("a_b")).count() == 2


def test_parity_keeps_addresses(spark):
    c, _, _ = tables(spark)
    stored = conform(c.withColumns({"address_line_1": F.lit("OLD"), "locality": F.lit("OLD")}), schemas.PRODUCTION_COMPANIES)
    staged = c.withColumns({"address_line_1": F.lit("NEW"), "locality": F.lit("NEW")})
    for parity, expected in ((True, ("OLD", "NEW")), (False, ("NEW", "NEW"))):
        rows, _ = promotion.promote_companies(staged, stored, "b1", F.lit(NOW), parity)
        row = rows.first()
        assert (row["address_line_1"], row["locality"]) == expected


HREFS = [
    "BasicCompanyData-2025-01-01-part1_7.zip", "psc-snapshot-2025-01-03_1of30.zip", "psc-snapshot-2025-01-09_1of30.zip",
    "Accounts_Monthly_Data-January2025.zip", "Accounts_Bulk_Data-2025-01-20.zip", "Accounts_Bulk_Data-2025-02-04.zip",
    "archive/Accounts_Monthly_Data-January2025.zip", "Accounts_Monthly_Data-Foo2025.zip", "/about.html",
]


def test_manifest(spark):
    html = "".join(f"<p><A class=x HREF='{h}'>f</a>" for h in HREFS[:4]) + "".join(f'<a href="{h}">f</a>' for h in HREFS[4:])
    pages = spark.createDataFrame([(0, html), (1, html)], "page_no int, html string")
    files = manifest(pages, "http://files.example.org/").cache()
    got = {r["filename"]: (r["product"], str(r["file_date"]), r["part"], r["total_parts"], r["is_monthly_archive"], r["url"]) for r in files.collect()}
    assert len(got) == 6 and files.count() == 6
    assert got[HREFS[0]] == ("company", "2025-01-01", 1, 7, False, f"http://files.example.org/{HREFS[0]}")
    assert got[HREFS[3]][:5] == ("accounts", "2025-01-01", None, None, True)
    chosen = [r["filename"] for r in choose(files, "2025-01-01", "2025-12-31").collect()]
    assert chosen == [HREFS[3], HREFS[5], HREFS[0], HREFS[1]]
    assert len(choose(files, "2025-01-01", "2025-12-31", monthly_only=False).collect()) == 5


def test_logs(spark, folder):
    log = f"{folder}/log"
    base = {"batch_id": "b1", "search_name": "x", "files_total": 4, "started_at": NOW}
    for hour, status in ((1, "running"), (2, "paused"), (2, "paused")):
        log_batch(spark, log, {**base, "status": status, "files_completed": hour, "logged_at": NOW.replace(hour=hour)})
    log_batch(spark, log, {**base, "batch_id": "b2", "status": "running", "files_completed": 1, "current_file": "f", "current_file_progress": 50, "logged_at": NOW})
    rows = ingestion_log(spark, log)
    assert rows.count() == 3
    assert last_batch(rows, "paused").first()["batch_id"] == "b1"
    progress = {r["batch_id"]: r["progress"] for r in reports.batch_progress(rows).collect()}
    assert progress == {"b1": 50.0, "b2": 37.5}
