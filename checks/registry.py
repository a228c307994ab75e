"""Query registry and the SQL form of the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.star import plain
from firmlake.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; its result is brought to plain types, and ``sql`` answers the same question."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            tune(spark)
            return plain(build(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return add


TABLES = {
    "companies": """
SELECT CASE WHEN c_acctbal < -900 THEN 'X' ELSE '' END || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS company_number,
  CASE WHEN c_acctbal BETWEEN 0 AND 50 THEN NULL ELSE c_name END AS company_name,
  CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'active' ELSE lower(c_mktsegment) END AS company_status,
  'Private Limited Company' AS company_type,
  CASE WHEN c_nationkey = 3 THEN '' ELSE n_name END AS locality,
  CASE WHEN c_acctbal >= 0 THEN 'PC' || CAST(c_nationkey AS VARCHAR) END AS postal_code,
  r_name AS region,
  CASE WHEN c_acctbal BETWEEN 9000 AND 9200 THEN CAST([] AS VARCHAR[])
    ELSE [CAST((c_custkey * 7) % 90 + 10 AS VARCHAR) || '110', CAST(c_nationkey + 55 AS VARCHAR) || '200'] END AS sic_codes,
  CAST(DATE '1990-01-01' + CAST((c_custkey * 37) % 12000 AS INTEGER) AS DATE) AS incorporation_date,
  'batch_' || lower(c_mktsegment) AS batch_id, c_acctbal < 0 AS needs_review, CAST(NULL AS VARCHAR) AS review_notes,
  c_nationkey < 12 AS change_detected,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(c_custkey AS BIGINT)) AS ingested_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(c_custkey AS BIGINT)) + to_hours(CAST(c_nationkey AS BIGINT)) AS last_updated,
  CASE WHEN c_acctbal > 5000 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(c_custkey AS BIGINT)) END AS merged_at
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "financials0": """
SELECT o_orderkey AS financial_id, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS company_number,
  CAST(o_orderdate AS DATE) AS period_end, o_orderstatus, o_orderpriority,
  CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) ELSE CAST(CAST(o_orderdate AS DATE) - 365 AS DATE) END AS period_start,
  CAST(o_totalprice AS DECIMAL(15,2)) AS price,
  CAST(CAST(o_totalprice AS DECIMAL(15,2)) * CAST(CASE o_orderpriority WHEN '2-HIGH' THEN 0.20 WHEN '3-MEDIUM' THEN 0.45
    WHEN '4-NOT SPECIFIED' THEN 0.75 WHEN '5-LOW' THEN 1.10 ELSE 0.00 END AS DECIMAL(3,2)) AS DECIMAL(15,2)) AS owed,
  CAST(o_orderdate AS TIMESTAMP) AS loaded
FROM orders""",
    "financials": """
SELECT financial_id, company_number, period_start, period_end, CAST(price * 100 AS DECIMAL(15,2)) AS turnover,
  CAST(price - 200000.00 AS DECIMAL(15,2)) AS profit_loss, price AS total_assets, owed AS total_liabilities,
  CAST(price - owed AS DECIMAL(15,2)) AS net_assets_liabilities,
  CAST(price * CAST(0.50 AS DECIMAL(3,2)) AS DECIMAL(15,2)) AS current_assets,
  CAST(owed * CAST(0.40 AS DECIMAL(3,2)) AS DECIMAL(15,2)) AS current_liabilities,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE 'bulk_xbrl' END AS source,
  loaded AS ingested_at, loaded AS last_updated, CASE WHEN o_orderstatus = 'F' THEN loaded END AS merged_at
FROM financials0""",
    "officers": """
SELECT o_orderkey AS officer_id, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS company_number,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL ELSE 'Officer ' || CAST(o_orderkey AS VARCHAR) END AS officer_name,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS officer_role,
  CASE WHEN o_totalprice >= 20000 THEN CAST(o_orderdate AS DATE) END AS appointed_on,
  CASE WHEN o_orderstatus <> 'O' THEN CAST(CAST(o_orderdate AS DATE) + 365 AS DATE) END AS resigned_on,
  CASE WHEN o_orderpriority <> '2-HIGH' THEN 'British' END AS nationality, o_orderstatus = 'O' AS is_active,
  CAST(o_orderdate AS TIMESTAMP) AS last_updated
FROM orders""",
    "contacts": """
SELECT l_orderkey AS officer_id, 'o' || CAST(l_orderkey AS VARCHAR) || '@example.com' AS email, l_linestatus = 'F' AS email_verified,
  CAST(NULL AS VARCHAR) AS phone, FALSE AS phone_verified, CAST(NULL AS VARCHAR) AS linkedin_url,
  'line' || CAST(l_linenumber AS VARCHAR) AS source,
  CAST(1 - 5 * CAST(l_discount AS DECIMAL(3,2)) AS DECIMAL(3,2)) AS confidence_score,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS TIMESTAMP) END AS verified_at
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC,
  l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS rn FROM lineitem) WHERE rn = 1""",
    "industries": """
SELECT * FROM (VALUES ('tech', ['62', '63']), ('finance', ['64', '65', '66']), ('retail', ['47']),
  ('manufacturing', [CAST(x AS VARCHAR) FOR x IN range(10, 34)]),
  ('professional', ['69', '70', '71', '72', '73', '74'])) t(industry, prefixes)""",
    "latest": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_number ORDER BY period_end DESC, financial_id DESC) AS rn
  FROM financials WHERE period_end IS NOT NULL) WHERE rn = 1""",
    "officer_counts": """
SELECT company_number, COUNT(*) FILTER (WHERE resigned_on IS NULL) AS active_officers FROM officers GROUP BY company_number""",
    "profiles": """
SELECT c.*, c.sic_codes[1] AS primary_sic_code, i.industry AS industry_category, f.turnover, f.profit_loss AS profit_after_tax,
  f.total_assets, f.total_liabilities, f.net_assets_liabilities AS net_worth,
  CAST(CAST(f.profit_loss AS DOUBLE) / NULLIF(CAST(f.turnover AS DOUBLE), 0) AS DECIMAL(10,4)) AS profit_margin,
  CAST(CAST(f.current_assets AS DOUBLE) / NULLIF(CAST(f.current_liabilities AS DOUBLE), 0) AS DECIMAL(10,4)) AS current_ratio,
  f.period_end AS latest_accounts_date, o.active_officers, COALESCE(o.active_officers, 0) AS active_officers_count
FROM companies c LEFT JOIN latest f ON c.company_number = f.company_number
LEFT JOIN officer_counts o ON c.company_number = o.company_number
LEFT JOIN industries i ON list_contains(i.prefixes, left(c.sic_codes[1], 2))""",
    "log": """
SELECT 'batch_' || CAST(user_id AS VARCHAR) AS batch_id, 'bulk_ingestion' AS search_name,
  CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'completed'
    WHEN 'signup' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
  CAST(ts AS TIMESTAMP) AS started_at,
  CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN CAST(ts AS TIMESTAMP) END AS completed_at,
  CAST(round(value * 100) AS BIGINT) AS companies_count, CAST(round(value * 100) AS BIGINT) % 20 AS files_total,
  least(CAST(round(value * 100) AS BIGINT) % 7, CAST(round(value * 100) AS BIGINT) % 20) AS files_completed,
  CASE WHEN event_type = 'view' THEN 'part1.zip' END AS current_file,
  CAST(round(value * 100) AS BIGINT) % 100 AS current_file_progress, CAST(ts AS TIMESTAMP) AS logged_at
FROM events""",
    "batches": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY logged_at DESC) AS rn FROM log) WHERE rn = 1""",
    "merges": """
SELECT 'batch_' || CAST(user_id AS VARCHAR) AS batch_id FROM events WHERE event_type = 'purchase' AND value > 30""",
    "score": """
SELECT *, CAST(((CASE WHEN company_number <> '' THEN 3.0 ELSE 0.0 END) + (CASE WHEN company_name <> '' THEN 3.0 ELSE 0.0 END)
  + (CASE WHEN company_status <> '' THEN 1.0 ELSE 0.0 END) + (CASE WHEN locality <> '' THEN 1.0 ELSE 0.0 END)
  + (CASE WHEN len(sic_codes) > 0 THEN 1.0 ELSE 0.0 END) + (CASE WHEN postal_code <> '' THEN 0.5 ELSE 0.0 END)
  + (CASE WHEN region <> '' THEN 0.5 ELSE 0.0 END)) / 10 AS DECIMAL(3,2)) AS data_quality_score FROM companies""",
}
NEEDS = {
    "financials": ["financials0"],
    "latest": ["financials"],
    "officer_counts": ["officers"],
    "profiles": ["companies", "latest", "officer_counts", "industries"],
    "batches": ["log"],
    "score": ["companies"],
}

PAGE = """company_number, company_name, company_status, locality, region, postal_code, primary_sic_code,
industry_category, CAST(incorporation_date AS VARCHAR) AS incorporation_date, CAST(turnover AS DOUBLE) AS turnover,
CAST(profit_after_tax AS DOUBLE) AS profit_after_tax, CAST(total_assets AS DOUBLE) AS total_assets,
CAST(net_worth AS DOUBLE) AS net_worth, CAST(profit_margin AS DOUBLE) AS profit_margin,
CAST(current_ratio AS DOUBLE) AS current_ratio, CAST(latest_accounts_date AS VARCHAR) AS latest_accounts_date,
active_officers_count"""


def stamp(c: str) -> str:
    """A time as text, as ``plain`` prints it."""
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def over(*tables: str, body: str) -> str:
    """A statement over the named derived tables."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for t in tables:
        add(t)
    return "WITH " + ",\n".join(f"{t} AS ({TABLES[t]})" for t in wanted) + "\n" + body
