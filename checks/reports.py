"""Reports, validation and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import star
from checks.registry import over, query, stamp
from firmlake.operators.expectations import (
    company_rules, contact_rules, duplicate_keys, financial_rules, manifest_rules, officer_rules, violation_counts,
)
from firmlake.operators.joins import flag_existing
from firmlake.operators.latest import latest_per_key
from firmlake.plans import reports, validation
from firmlake.plans.promotion import (
    eligible_companies, eligible_financials, eligible_officers, financial_rows,
)
from firmlake.sources.logs import current_batches, last_batch

TIE = ["financial_id"]
BATCH = "batch_building"


@query(
    "active_companies_latest",
    over("profiles", body="""SELECT company_number, company_name, company_status, company_type, locality, region,
primary_sic_code, industry_category, CAST(incorporation_date AS VARCHAR) AS incorporation_date,
CAST(latest_accounts_date AS VARCHAR) AS latest_accounts_date, CAST(turnover AS DOUBLE) AS turnover,
CAST(profit_after_tax AS DOUBLE) AS profit_after_tax, CAST(total_assets AS DOUBLE) AS total_assets,
CAST(net_worth AS DOUBLE) AS net_worth, CAST(profit_margin AS DOUBLE) AS profit_margin,
CAST(current_ratio AS DOUBLE) AS current_ratio, active_officers_count FROM profiles WHERE company_status = 'active'"""),
)
def active_companies_latest(spark, folder):
    return reports.active_companies_with_financials(
        star.production_companies(spark, folder), star.production_financials(spark, folder),
        star.officers(spark, folder), TIE,
    )


@query(
    "officers_with_contacts",
    over("companies", "officers", "contacts", body="").rstrip() + """,
-- Who is in office at a company we know; then each of their contacts, and those without any once.
holders AS (SELECT officer_id, officer_name, officer_role, company_number, company_name,
  CAST(appointed_on AS VARCHAR) AS appointed_on, is_active, nationality
  FROM officers SEMI JOIN companies USING (company_number) JOIN (SELECT company_number, company_name FROM companies) USING (company_number)
  WHERE is_active),
reachable AS (SELECT officer_id, email, email_verified, phone, phone_verified, linkedin_url,
  CAST(confidence_score AS DOUBLE) AS confidence_score, source AS contact_source FROM contacts)
SELECT * FROM holders JOIN reachable USING (officer_id)
UNION ALL BY NAME
SELECT * FROM holders ANTI JOIN reachable USING (officer_id)""",
)
def officers_with_contacts(spark, folder):
    return reports.officers_with_contacts(
        star.officers(spark, folder), star.companies(spark, folder), star.contacts(spark, folder)
    )


@query(
    "company_overview",
    over("score", "industries", "officers", "financials", "contacts", body="").rstrip() + """,
-- Every count on its own, by company.
in_office AS (SELECT company_number, SUM(CASE WHEN is_active THEN 1 ELSE 0 END) AS n FROM officers GROUP BY company_number),
periods AS (SELECT company_number, COUNT(*) AS n, MAX(period_end) AS newest FROM financials GROUP BY company_number),
reached AS (SELECT company_number, COUNT(*) AS n FROM officers JOIN
  (SELECT officer_id FROM contacts WHERE verified_at IS NOT NULL) USING (officer_id) GROUP BY company_number)
SELECT score.* EXCLUDE (sic_codes, batch_id, needs_review, review_notes, change_detected, ingested_at, last_updated, merged_at)
  REPLACE (CAST(incorporation_date AS VARCHAR) AS incorporation_date, CAST(data_quality_score AS DOUBLE) AS data_quality_score),
  sic_codes[1] AS primary_sic_code,
  (SELECT any_value(industry) FROM industries WHERE list_contains(prefixes, left(sic_codes[1], 2))) AS industry_category,
  CAST(CAST(score.incorporation_date + 270 AS DATE) AS VARCHAR) AS accounts_next_due_date,
  CAST(CAST(score.incorporation_date + 14 AS DATE) AS VARCHAR) AS conf_stm_next_due_date,
  CAST(COALESCE(in_office.n, 0) AS BIGINT) AS active_officers, COALESCE(periods.n, 0) AS financial_periods_available,
  CAST(newest AS VARCHAR) AS latest_accounts_date, COALESCE(reached.n, 0) AS verified_contacts_count
FROM score LEFT JOIN in_office USING (company_number) LEFT JOIN periods USING (company_number) LEFT JOIN reached USING (company_number)""",
)
def company_overview(spark, folder):
    return reports.company_overview(
        star.production_companies(spark, folder), star.officers(spark, folder), star.financials(spark, folder),
        star.contacts(spark, folder),
    )


def waiting(which: str, cut: str = "") -> str:
    """Companies to look at, with the size of their board counted row by row."""
    return over("companies", "officers", body="").rstrip() + f""",
board AS (SELECT company_number AS firm, 1 AS seat FROM officers),
todo AS (SELECT company_number, company_name, needs_review, review_notes, ingested_at, last_updated FROM companies WHERE {which} {cut})
SELECT todo.* REPLACE ({stamp('ingested_at')} AS ingested_at, {stamp('last_updated')} AS last_updated),
  (SELECT CAST(COALESCE(SUM(seat), 0) AS BIGINT) FROM board WHERE firm = todo.company_number) AS officer_count FROM todo"""


@query("review_queue", waiting("needs_review", "ORDER BY ingested_at DESC NULLS LAST, company_number LIMIT 100"))
def review_queue(spark, folder):
    return reports.review_queue(star.companies(spark, folder), star.officers(spark, folder))


@query("review_queue_of_batch", waiting(f"needs_review AND batch_id = '{BATCH}'"))
def review_queue_of_batch(spark, folder):
    return reports.review_queue(star.companies(spark, folder), star.officers(spark, folder), BATCH, limit=None)


# Each company with the list of what is to be said of it; a count is the number of lists that hold the mark.
QUALITY = f""", marks AS (SELECT last_updated, ['all', CASE WHEN length(company_name) > 0 THEN '' ELSE 'name' END,
  CASE WHEN length(locality) > 0 THEN '' ELSE 'place' END, CASE WHEN len(sic_codes) > 0 THEN '' ELSE 'codes' END,
  CASE WHEN needs_review THEN 'review' ELSE '' END, CASE WHEN merged_at IS NULL THEN 'waits' ELSE '' END,
  CASE WHEN change_detected THEN 'changed' ELSE '' END] AS m FROM companies),
counted AS (SELECT mark, SUM(1) AS n FROM (SELECT unnest(m) AS mark FROM marks) GROUP BY mark),
quality AS (SELECT {", ".join(f"CAST(COALESCE((SELECT n FROM counted WHERE mark = '{m}'), 0) AS BIGINT) AS {c}" for m, c in (
    ("all", "total_companies"), ("name", "missing_names"), ("place", "missing_locality"), ("codes", "missing_sic"), ("review", "needs_review"),
    ("waits", "pending_merge"), ("changed", "recently_changed")))},
  (SELECT {stamp("last_updated")} FROM marks ORDER BY last_updated DESC NULLS LAST LIMIT 1) AS latest_update)"""

# One list of both tables' rows: a table's figures are sums and extremes over its rows that wait.
WAITING = f""", listed AS (SELECT 'companies' AS table_name, CASE WHEN merged_at IS NULL THEN 1 ELSE 0 END AS waits, ingested_at AS came, last_updated AS newest
    FROM companies UNION ALL SELECT 'financials', CASE WHEN merged_at IS NULL THEN 1 ELSE 0 END, ingested_at, ingested_at FROM financials),
waiting AS (SELECT table_name, CAST(SUM(waits) AS BIGINT) AS pending_count, {stamp("MIN(CASE WHEN waits = 1 THEN came END)")} AS oldest_record,
  {stamp("MAX(CASE WHEN waits = 1 THEN newest END)")} AS newest_record FROM listed GROUP BY table_name)"""


@query(
    "data_quality",
    over("companies", body=f"""{QUALITY} SELECT * FROM quality"""),
)
def data_quality(spark, folder):
    return reports.data_quality(star.companies(spark, folder))


@query(
    "pending_merge",
    over("companies", "financials", body=f"""{WAITING} SELECT * FROM waiting"""),
)
def pending_merge(spark, folder):
    return reports.pending_merge(star.companies(spark, folder), star.financials(spark, folder))


# What is wrong with a row, one list per table; an issue is counted where it stands in the list.
ISSUES = """
SELECT severity, type, count, concat(count, ' ', text) AS message FROM (
  SELECT type, COUNT(*) AS count FROM (
    SELECT unnest([CASE WHEN COALESCE(company_number, '') = '' THEN 'missing_company_number' END,
      CASE WHEN length(company_number) <> 8 THEN 'invalid_company_number' END,
      CASE WHEN COALESCE(company_name, '') = '' THEN 'missing_company_name' END,
      CASE WHEN COALESCE(company_status, '') = '' THEN 'missing_status' END,
      CASE WHEN COALESCE(locality, '') = '' THEN 'missing_locality' END,
      CASE WHEN len(sic_codes) = 0 THEN 'missing_sic' END]) AS type FROM firms
    UNION ALL
    SELECT unnest([CASE WHEN COALESCE(officer_name, '') = '' THEN 'missing_officer_name' END,
      CASE WHEN COALESCE(officer_role, '') = '' THEN 'missing_officer_role' END,
      CASE WHEN appointed_on IS NULL THEN 'missing_appointment_date' END]) FROM people)
  WHERE type IS NOT NULL GROUP BY type)
JOIN (VALUES ('error', 'missing_company_number', 'companies missing company number'),
  ('error', 'invalid_company_number', 'companies have invalid number format (not 8 chars)'),
  ('error', 'missing_company_name', 'companies missing name'), ('warning', 'missing_status', 'companies missing status'),
  ('warning', 'missing_locality', 'companies missing locality'), ('info', 'missing_sic', 'companies missing SIC codes'),
  ('warning', 'missing_officer_name', 'officers missing name'), ('warning', 'missing_officer_role', 'officers missing role'),
  ('info', 'missing_appointment_date', 'officers missing appointment date')) catalogue(severity, type, text) USING (type)"""
ONE_BATCH = f"""firms AS (FROM companies WHERE batch_id = '{BATCH}'),
people AS (FROM officers SEMI JOIN firms USING (company_number))"""
ALL_BATCHES = "firms AS (FROM companies), people AS (FROM officers)"


def issues_sql(scope: str, body: str) -> str:
    ctes = over("companies", "officers", body="").rstrip()
    return f"{ctes},\n{scope}\n{body}"


@query("validation_issues", issues_sql(ALL_BATCHES, ISSUES))
def validation_issues(spark, folder):
    return validation.issues(star.companies(spark, folder), star.officers(spark, folder))


@query("validation_issues_of_batch", issues_sql(ONE_BATCH, ISSUES))
def validation_issues_of_batch(spark, folder):
    return validation.issues(star.companies(spark, folder), star.officers(spark, folder), BATCH)


@query(
    "batch_score",
    issues_sql(ONE_BATCH, f"""SELECT CASE WHEN COUNT(*) = 0 THEN 1.0::DOUBLE
ELSE 1.0::DOUBLE - CAST(COUNT(*) FILTER (WHERE severity = 'error') AS DOUBLE) / COUNT(*) END AS quality_score FROM ({ISSUES})"""),
)
def batch_score(spark, folder):
    return validation.batch_score(star.companies(spark, folder), star.officers(spark, folder), BATCH)


@query(
    "mark_for_review",
    over("companies", body=f"""SELECT company_number, company_name,
(company_number IS NULL OR company_name IS NULL) AND batch_id = '{BATCH}' AS marked,
needs_review OR ((company_number IS NULL OR company_name IS NULL) AND batch_id = '{BATCH}') AS needs_review,
CASE WHEN (company_number IS NULL OR company_name IS NULL) AND batch_id = '{BATCH}' THEN 'Missing critical data: ' ||
  CASE WHEN company_number IS NULL THEN 'company_number ' ELSE '' END || CASE WHEN company_name IS NULL THEN 'company_name ' ELSE '' END
  ELSE review_notes END AS review_notes FROM companies"""),
)
def mark_for_review(spark, folder):
    return validation.mark_for_review(star.companies(spark, folder), BATCH).select(
        "company_number", "company_name", "marked", "needs_review", "review_notes"
    )


@query(
    "dry_run_counts",
    over("companies", "officers", "financials", body=f"""SELECT 'companies' AS table_name, COUNT(*) AS rows FROM companies
WHERE batch_id = '{BATCH}' AND NOT needs_review AND company_number IS NOT NULL AND company_name IS NOT NULL
UNION ALL SELECT 'officers', COUNT(*) FROM officers so JOIN companies sc ON so.company_number = sc.company_number
WHERE sc.batch_id = '{BATCH}' AND NOT sc.needs_review AND so.officer_name IS NOT NULL
UNION ALL SELECT 'financials', COUNT(*) FROM financials sf JOIN companies sc ON sf.company_number = sc.company_number
WHERE sc.batch_id = '{BATCH}' AND NOT sc.needs_review"""),
)
def dry_run_counts(spark, folder):
    companies = star.companies(spark, folder)
    return reports.table_status(
        eligible_companies(companies, BATCH),
        eligible_officers(star.officers(spark, folder), companies, BATCH),
        eligible_financials(star.financials(spark, folder), companies, BATCH),
    )


@query(
    "table_status",
    over("companies", "officers", "financials", body="""SELECT 'companies' AS table_name, COUNT(*) AS rows FROM companies
UNION ALL SELECT 'officers', COUNT(*) FROM officers UNION ALL SELECT 'financials', COUNT(*) FROM financials"""),
)
def table_status(spark, folder):
    return reports.table_status(
        star.companies(spark, folder), star.officers(spark, folder), star.financials(spark, folder)
    )


BATCH_COLUMNS = f"""batch_id, search_name, {stamp('started_at')} AS started_at, {stamp('completed_at')} AS completed_at,
companies_count"""


@query(
    "mergeable_batches",
    over("batches", "merges", body=f"""SELECT {BATCH_COLUMNS},
CASE WHEN batch_id IN (SELECT batch_id FROM merges) THEN 'merged' ELSE 'not_merged' END AS merge_status
FROM batches WHERE status = 'completed' ORDER BY batches.completed_at DESC, batch_id LIMIT 20"""),
)
def mergeable_batches(spark, folder):
    return reports.mergeable_batches(star.ingestion_log(spark, folder), star.merges(spark, folder))


@query(
    "merged_flag_all_batches",
    over("batches", "merges", body="""SELECT batch_id, batch_id IN (SELECT batch_id FROM merges) AS merged FROM batches"""),
)
def merged_flag_all_batches(spark, folder):
    batches = current_batches(star.ingestion_log(spark, folder)).select("batch_id")
    return flag_existing(batches, star.merges(spark, folder), "batch_id", "merged")


@query(
    "current_batches",
    over("batches", body=f"SELECT {BATCH_COLUMNS}, status, files_total, files_completed FROM batches"),
)
def batches(spark, folder):
    return current_batches(star.ingestion_log(spark, folder)).select(
        "batch_id", "search_name", "started_at", "completed_at", "companies_count", "status", "files_total",
        "files_completed",
    )


@query(
    "latest_batch",
    over("batches", body=f"""SELECT {BATCH_COLUMNS}, status, files_total, files_completed FROM batches
ORDER BY batches.started_at DESC, batch_id LIMIT 1"""),
)
def latest_batch(spark, folder):
    return reports.latest_batch(star.ingestion_log(spark, folder))


@query(
    "last_paused_batch",
    over("batches", body="""SELECT batch_id, status FROM batches WHERE status = 'paused'
ORDER BY started_at DESC, batch_id LIMIT 1"""),
)
def last_paused_batch(spark, folder):
    return last_batch(star.ingestion_log(spark, folder), "paused").select("batch_id", "status")


@query(
    "batch_progress",
    over("batches", body="""SELECT batch_id, status, CASE WHEN files_total = 0 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE,
CAST(files_completed AS DOUBLE) / files_total * 100 + CASE WHEN current_file IS NOT NULL
  THEN CAST(current_file_progress AS DOUBLE) / 100 * (100.0::DOUBLE / files_total) ELSE 0 END) END AS progress FROM batches"""),
)
def batch_progress(spark, folder):
    return reports.batch_progress(star.ingestion_log(spark, folder))


@query(
    "processed_per_product",
    """SELECT p_type AS product, CAST(SUM(l_linenumber) AS BIGINT) AS processed FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_linestatus = 'F' GROUP BY p_type""",
)
def processed_per_product(spark, folder):
    parts = star.read(spark, folder, "part").select("p_partkey", F.col("p_type").alias("product"))
    lines = star.read(spark, folder, "lineitem").select(
        "l_partkey", F.when(F.col("l_linestatus") == "F", "completed").otherwise("failed").alias("status"),
        F.col("l_linenumber").cast("long").alias("rows"),
    )
    return reports.processed_per_product(lines.join(parts, lines.l_partkey == parts.p_partkey))


@query(
    "expectations",
    over("score", "financials", "officers", "contacts", body="""
SELECT 'company' AS table_name, rule, COUNT(*) AS rows FROM (
  SELECT unnest(list_filter([CASE WHEN company_number IS NULL THEN 'company_number_missing' END,
    CASE WHEN company_name IS NULL THEN 'company_name_missing' END,
    CASE WHEN length(company_number) > 8 THEN 'company_number_too_long' END], lambda x: x IS NOT NULL)) AS rule FROM score) GROUP BY ALL
UNION ALL SELECT 'financial', rule, COUNT(*) FROM (
  SELECT CASE WHEN NOT period_end > period_start THEN 'period_not_positive' END AS rule FROM financials) WHERE rule IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'contact', rule, COUNT(*) FROM (
  SELECT CASE WHEN NOT confidence_score BETWEEN 0.5 AND 1.0 THEN 'confidence_out_of_range' END AS rule FROM contacts)
  WHERE rule IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'officer', rule, COUNT(*) FROM (
  SELECT CASE WHEN length(officer_name) > 500 THEN 'officer_name_too_long' END AS rule FROM officers) WHERE rule IS NOT NULL GROUP BY ALL"""),
)
def expectations(spark, folder):
    frames = {
        "company": (star.production_companies(spark, folder), company_rules),
        "financial": (star.production_financials(spark, folder), financial_rules),
        "contact": (star.contacts(spark, folder), contact_rules),
        "officer": (star.officers(spark, folder), officer_rules),
    }
    counts = [
        violation_counts(df, rules(df)).select(F.lit(name).alias("table_name"), "rule", "rows")
        for name, (df, rules) in frames.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(
    "manifest_check",
    """SELECT rule, COUNT(*) AS rows FROM (SELECT unnest(list_filter([CASE WHEN event_type = 'error' THEN 'product_missing' END,
  CASE WHEN value < 1 THEN 'url_missing' END, CASE WHEN event_type = 'signup' THEN 'unknown_product' END], lambda x: x IS NOT NULL)) AS rule
FROM events) GROUP BY rule""",
)
def manifest_check(spark, folder):
    """Events as a list of files to load; some name no product, an unknown one, or no address."""
    files = star.read(spark, folder, "events").selectExpr(
        """CASE event_type WHEN 'view' THEN 'company' WHEN 'click' THEN 'psc' WHEN 'purchase' THEN 'accounts'
           WHEN 'signup' THEN 'other' END AS product""",
        "CASE WHEN value >= 1 THEN concat('file-', event_id) END AS url",
    )
    return violation_counts(files, manifest_rules())


@query(
    "duplicate_keys",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, COUNT(*) AS rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""",
)
def duplicates(spark, folder):
    return duplicate_keys(star.read(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "dedupe_keep_last",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC,
l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedupe_keep_last(spark, folder):
    lines = star.read(spark, folder, "lineitem")
    return latest_per_key(lines, ["l_orderkey", "l_linenumber"], star.CONTACT_ORDER).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )


@query(
    "ratios",
    over("financials", body="""SELECT financial_id,
CAST(CAST(CAST(total_liabilities AS DOUBLE) / NULLIF(CAST(net_assets_liabilities AS DOUBLE), 0) AS DECIMAL(10,4)) AS DOUBLE) AS debt_to_equity_ratio,
CAST(CAST(CAST(current_assets AS DOUBLE) / NULLIF(CAST(current_liabilities AS DOUBLE), 0) AS DECIMAL(10,4)) AS DOUBLE) AS current_ratio,
CAST(CAST(CAST(profit_loss AS DOUBLE) / NULLIF(CAST(turnover AS DOUBLE), 0) AS DECIMAL(10,4)) AS DOUBLE) AS profit_margin,
CASE WHEN source = '' THEN 'api' ELSE source END AS source FROM financials"""),
)
def ratios(spark, folder):
    return financial_rows(star.financials(spark, folder)).select(
        "financial_id", "debt_to_equity_ratio", "current_ratio", "profit_margin", "source"
    )
