"""Column functions and record parsing without archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import star
from checks.registry import over, query
from firmlake.functions import company, dates, filing, finance, text
from firmlake.operators.joins import guard_orphans, orphans
from firmlake.sources import company_csv, psc_json
from firmlake.sources.accounts import resolve_tags
from firmlake.sources.manifest import (
    available_dates, choose, drop_superseded_dailies, first_snapshot_of_month, links, manifest,
)
from firmlake.sources.tags import tag_dictionary

DAY = "CAST(DATE '1990-01-01' + CAST((c_custkey * 37) % 12000 AS INTEGER) AS DATE)"


def csv_shaped(spark, folder):
    """customer as bulk CSV text columns, blemishes included."""
    c = star.read(spark, folder, "customer")
    key = F.col("c_custkey")
    born = F.date_add(F.lit("1990-01-01").cast("date"), ((key * 37) % 12000).cast("int"))
    values = {
        "CompanyNumber": star.number("c_custkey"),
        "CompanyName": F.col("c_name"),
        "CompanyStatus": F.concat(F.lit(" "), F.initcap("c_mktsegment"), F.lit(" ")),
        "RegAddress.PostTown": F.when(F.col("c_nationkey") == 3, "nan").otherwise(F.concat(F.lit("TOWN "), F.col("c_nationkey").cast("string"))),
        "RegAddress.County": F.when(F.col("c_nationkey") > 10, "").otherwise("COUNTY"),
        "SICCode.SicText_1": F.concat(((key * 7) % 90 + 10).cast("string"), F.lit("110 - Some trade - more")),
        "SICCode.SicText_2": F.when(F.col("c_acctbal") > 5000, "None Supplied").when(F.col("c_acctbal") > 0, ""),
        "SICCode.SicText_3": F.lit(" 47110 "),
        "IncorporationDate": F.when(F.col("c_acctbal") < 0, "not-a-date").when(F.col("c_nationkey") < 5, F.date_format(born, "yyyy-MM-dd")).otherwise(F.date_format(born, "d/M/yyyy")),
        "Accounts.AccountRefDay": F.when(F.col("c_nationkey") == 7, "x").otherwise(F.col("c_nationkey").cast("string")),
        "Accounts.AccountRefMonth": F.when(F.col("c_nationkey") != 9, (F.col("c_nationkey") % 12 + 1).cast("double").cast("string")),
        "Accounts.NextDueDate": F.date_format(F.date_add(born, 270), "dd/MM/yyyy"),
        "Mortgages.NumMortCharges": (key % 5).cast("string"),
        "PreviousName_1.CompanyName": F.when(F.col("c_acctbal") > 1000, F.concat(F.lit(" OLD "), F.col("c_name"))),
        "PreviousName_2.CompanyName": F.lit("   "),
        "PreviousName_10.CompanyName": F.when(F.col("c_nationkey") < 12, "FIRST NAME LTD"),
        "Unmapped": F.lit("x"),
    }
    return c.select(*[v.cast("string").alias(f" {name}") for name, v in values.items()])


CSV_SQL = f"""
SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS company_number, c_name AS company_name, lower(c_mktsegment) AS company_status,
  CASE WHEN c_nationkey = 3 THEN NULL ELSE 'TOWN ' || CAST(c_nationkey AS VARCHAR) END AS locality,
  CASE WHEN c_nationkey > 10 THEN NULL ELSE 'COUNTY' END AS region,
  CASE WHEN c_acctbal > 5000 THEN [CAST((c_custkey * 7) % 90 + 10 AS VARCHAR) || '110', 'None Supplied', '47110']
    ELSE [CAST((c_custkey * 7) % 90 + 10 AS VARCHAR) || '110', '47110'] END AS sic_codes,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE {DAY} END AS incorporation_date,
  CAST({DAY} + 270 AS DATE) AS accounts_next_due_date,
  CASE WHEN c_nationkey IN (7, 9) THEN NULL ELSE lpad(CAST(c_nationkey % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS accounts_ref_date,
  CAST(c_custkey % 5 AS BIGINT) AS num_mort_charges,
  NULLIF(concat_ws('|', CASE WHEN c_acctbal > 1000 THEN 'OLD ' || c_name END, CASE WHEN c_nationkey < 12 THEN 'FIRST NAME LTD' END), '') AS previous_names
FROM customer"""


@query(
    "company_transform",
    f"""WITH t AS ({CSV_SQL}) SELECT company_number, company_name, company_status, locality, region,
array_to_string(sic_codes, '|') AS sic_codes, CAST(incorporation_date AS VARCHAR) AS incorporation_date,
CAST(accounts_next_due_date AS VARCHAR) AS accounts_next_due_date, accounts_ref_date, num_mort_charges, previous_names,
md5(concat_ws('|', company_number, company_name, company_status, '', coalesce(locality, ''), '', '', '', coalesce(region, ''), '',
  '[''' || array_to_string(sic_codes, ''', ''') || ''']', coalesce(CAST(incorporation_date AS VARCHAR), ''),
  CAST(accounts_next_due_date AS VARCHAR), CAST(num_mort_charges AS VARCHAR), coalesce(previous_names, ''))) AS data_hash FROM t""",
)
def company_transform(spark, folder):
    raw = company_csv.rename_columns(csv_shaped(spark, folder))
    return company_csv.transform(raw).select(
        "company_number", "company_name", "company_status", "locality", "region", "sic_codes", "incorporation_date",
        "accounts_next_due_date", "accounts_ref_date", "num_mort_charges", "previous_names", "data_hash",
    )


@query(
    "quality_score",
    over("score", body="SELECT company_number, CAST(data_quality_score AS DOUBLE) AS data_quality_score FROM score"),
)
def quality(spark, folder):
    return star.companies(spark, folder).select("company_number", company.quality_score().alias("data_quality_score"))


@query(
    "primary_sic_and_industry",
    over("companies", "industries", body="""SELECT company_number, sic_codes[1] AS primary_sic_code, industry AS industry_category
FROM companies LEFT JOIN industries ON list_contains(prefixes, left(sic_codes[1], 2))"""),
)
def primary(spark, folder):
    code = company.primary_sic(F.col("sic_codes"))
    rows = star.companies(spark, folder).select("company_number", code.alias("primary_sic_code"))
    return rows.withColumn("industry_category", company.industry_category("primary_sic_code"))


@query(
    "normalize_name",
    r"""SELECT doc_id, CASE WHEN text IS NOT NULL AND text <> '' THEN
md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}\p{Pc}\s]', '', 'g'), '\s+', ' ', 'g'))) END AS name_hash
FROM documents""",
)
def normalize(spark, folder):
    return star.read(spark, folder, "documents").select(
        "doc_id", F.md5(text.normalize_name(F.col("text"))).alias("name_hash")
    )


@query(
    "register_dates",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS slashes, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS words,
CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-01') END AS birth FROM orders""",
)
def register_dates(spark, folder):
    day = star.day("o_orderdate")
    part = F.when(F.col("o_orderstatus") != "P", F.date_format(day, "M"))
    return star.read(spark, folder, "orders").select(
        "o_orderkey",
        dates.register_date(F.date_format(day, "d/M/yyyy")).alias("slashes"),
        dates.filing_date(F.date_format(day, "d MMMM yyyy")).alias("words"),
        dates.partial_date(F.date_format(day, "yyyy"), part, F.lit(None).cast("string")).alias("birth"),
    )


@query(
    "filing_names",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN lpad(CAST(o_custkey AS VARCHAR), 8, '0')
  WHEN 'F' THEN 'SC' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') ELSE lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS company_number,
CASE o_orderstatus WHEN 'O' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS period_end, 'Turnover' AS local_name FROM orders""",
)
def filing_names(spark, folder):
    status, day = F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyyMMdd")
    name = (
        F.when(status == "O", F.concat(F.lit("Prod223_2125_"), star.number("o_custkey"), F.lit("_"), day, F.lit(".html")))
        .when(status == "F", F.concat(F.lit("x SC"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit(" y.xml")))
        .otherwise(F.concat(F.lit("a_"), star.number("o_custkey"), F.lit("_x.html")))
    )
    tag = F.when(status == "O", "uk:Turnover").when(status == "F", "{http://x/y}Turnover").otherwise("Turnover")
    return star.read(spark, folder, "orders").select(
        "o_orderkey", filing.company_number_from_name(name).alias("company_number"),
        filing.period_end_from_name(name).alias("period_end"), filing.local_name(tag).alias("local_name"),
    )


@query(
    "display_money",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN 'N/A' ELSE
'£' || printf('%.1f', CAST(l_extendedprice * 100 AS BIGINT) / 1000000.0::DOUBLE
  + CASE WHEN CAST(l_extendedprice * 100 AS BIGINT) % 1000000 = 250000 THEN 0.05 ELSE 0 END) || 'M' END AS shown,
CASE WHEN l_returnflag = 'N' THEN 'N/A' ELSE l_returnflag END AS flag FROM lineitem""",
)
def display_money(spark, folder):
    lines = star.read(spark, folder, "lineitem")
    amount = (F.col("l_extendedprice") * 100).cast("decimal(15,0)").cast("double")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_discount") == 0, finance.money_in_millions(F.lit(0))).otherwise(finance.money_in_millions(amount)).alias("shown"),
        text.display_text(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))).alias("flag"),
    )


def psc_lines(spark, folder):
    """orders as JSON lines, some unreadable or without a company."""
    o = star.read(spark, folder, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    record = F.to_json(
        F.struct(
            F.when(F.col("o_orderpriority") != "5-LOW", star.number("o_custkey")).alias("company_number"),
            F.struct(
                F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("Holding "), F.col("o_orderkey").cast("string"))).alias("name"),
                F.struct(F.lit("Ms").alias("title"), F.lit("Ann").alias("forename"), F.lit("").alias("middle_name"),
                         F.concat(F.lit("No"), F.col("o_orderkey").cast("string")).alias("surname")).alias("name_elements"),
                F.struct(F.lit("1 High Street").alias("address_line_1"), F.col("o_orderpriority").alias("locality")).alias("address"),
                F.struct(F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") != "F", F.month("o_orderdate")).alias("month")).alias("date_of_birth"),
                F.when(F.col("o_orderstatus") == "P", "corporate-entity").alias("kind"),
                day.alias("notified_on"),
                F.when(F.col("o_orderstatus") == "F", day).alias("ceased_on"),
                F.array(F.lit("shares"), F.lit(None).cast("string"), F.concat(F.lit("votes "), F.col("o_orderstatus"))).alias("natures_of_control"),
            ).alias("data"),
        )
    )
    line = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("{"), record)).otherwise(record)
    return star.spread(o.select(F.col("o_orderkey").alias("line_no"), line.alias("line")), "line_no")


PSC_SQL = """
SELECT o_orderkey AS row_no, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS company_number,
  CASE WHEN o_orderstatus = 'O' THEN 'Holding ' || CAST(o_orderkey AS VARCHAR) ELSE 'Ms Ann No' || CAST(o_orderkey AS VARCHAR) END AS officer_name,
  CASE WHEN o_orderstatus = 'P' THEN 'corporate-entity' ELSE 'person-with-significant-control' END AS officer_role,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS appointed_on,
  CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS resigned_on,
  CASE WHEN o_orderstatus <> 'F' THEN strftime(o_orderdate, '%Y-%m-01') END AS date_of_birth,
  'shares|votes ' || o_orderstatus AS nature_of_control, '1 High Street' AS address_line_1, o_orderpriority AS locality
FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '1-URGENT')"""
PSC_COLUMNS = [
    "row_no", "company_number", "officer_name", "officer_role", "appointed_on", "resigned_on", "date_of_birth",
    "nature_of_control", "address_line_1", "locality",
]
PSC_HASH = """md5(concat_ws('|', company_number, officer_name, officer_role, coalesce(date_of_birth, ''), '', nature_of_control,
coalesce(resigned_on, ''), locality, '', address_line_1, '', '')) AS data_hash"""


@query("psc_flatten", f"SELECT *, {PSC_HASH} FROM ({PSC_SQL})")
def psc_flatten(spark, folder):
    return psc_json.parse_lines(psc_lines(spark, folder)).where("reject is null").select(*PSC_COLUMNS, "data_hash")


@query(
    "psc_rejects",
    """SELECT o_orderkey AS row_no, CASE WHEN o_orderpriority = '1-URGENT' THEN 'unreadable' ELSE 'no company number' END AS reason
FROM orders WHERE o_orderpriority IN ('5-LOW', '1-URGENT')""",
)
def psc_rejects(spark, folder):
    bad = psc_json.parse_lines(psc_lines(spark, folder)).where("reject is not null")
    return bad.select("row_no", F.substring_index("reject", ":", 1).alias("reason"))


TAG_SQL = """WITH facts AS (
  SELECT l_orderkey AS filing, CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber AS n,
    CASE WHEN l_partkey % 3 = 0 THEN 'uk:' ELSE 'core:' END || CASE l_linenumber WHEN 1 THEN 'TurnoverRevenue'
      WHEN 2 THEN 'TurnoverGrossOperatingRevenue' WHEN 3 THEN 'NetAssetsLiabilities' WHEN 4 THEN 'ReportTitle'
      WHEN 5 THEN 'AccruedLiabilities' WHEN 6 THEN 'CurrentLiabilities' ELSE 'Unknown' END AS tag,
    CASE WHEN l_returnflag = 'R' THEN 'n/a' ELSE CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR) END AS raw,
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(15,2)) END AS value FROM lineitem),
dict(col, local, priority, is_num) AS (VALUES ('turnover', 'turnoverrevenue', 0, TRUE), ('turnover', 'turnovergrossoperatingrevenue', 1, TRUE),
  ('net_assets_liabilities', 'netassetsliabilities', 0, TRUE), ('report_title', 'reporttitle', 0, FALSE),
  ('current_liabilities', 'currentliabilities', 0, TRUE), ('current_liabilities', 'accruedliabilities', 1, TRUE)),
per_tag AS (SELECT filing, tag, lower(split_part(tag, ':', 2)) AS local, value IS NOT NULL AS is_number, MIN(n) AS first_n, COUNT(*) AS facts,
  arg_max(raw, n) AS raw, max_by(CAST(value AS VARCHAR), CASE WHEN value IS NOT NULL THEN n END) AS value FROM facts GROUP BY ALL),
ranked AS (SELECT filing, col, raw, value, CAST(SUM(facts) OVER (PARTITION BY filing, col) AS BIGINT) AS facts, row_number() OVER (PARTITION BY filing, col ORDER BY CASE WHEN is_number THEN 0 ELSE 1 END, priority, first_n) AS rn
  FROM per_tag JOIN dict USING (local) WHERE NOT is_num OR is_number)
SELECT filing, col AS "column", raw, CAST(value AS DOUBLE) AS value, facts FROM ranked WHERE rn = 1"""


@query("tag_resolution", TAG_SQL)
def tag_resolution(spark, folder):
    lines = star.read(spark, folder, "lineitem")
    names = {1: "TurnoverRevenue", 2: "TurnoverGrossOperatingRevenue", 3: "NetAssetsLiabilities", 4: "ReportTitle",
             5: "AccruedLiabilities", 6: "CurrentLiabilities"}
    tag = F.lit("Unknown")
    for n, name in names.items():
        tag = F.when(F.col("l_linenumber") == n, name).otherwise(tag)
    prefix = F.when(F.col("l_partkey") % 3 == 0, "uk:").otherwise("core:")
    price = F.col("l_extendedprice").cast("decimal(15,2)").cast("string")
    raw = F.when(F.col("l_returnflag") == "R", "n/a").otherwise(price)
    facts = lines.select(
        F.col("l_orderkey").alias("filing"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") * 10 + F.col("l_linenumber")).alias("n"),
        F.concat(prefix, tag).alias("tag"), raw.alias("raw"),
    ).withColumns({"local": F.lower(filing.local_name(F.col("tag"))), "value": filing.number(F.col("raw"))})
    known = resolve_tags(facts, ["filing"], tag_dictionary(spark))
    return known.where(F.col("column").isNotNull())


@query(
    "page_links",
    """WITH l AS (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*("[^"]*")', 1), lambda x: replace(trim(x, '"'), '&amp;', '&'))) AS href,
  generate_subscripts(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*("[^"]*")', 1), 1) - 1 AS position FROM pages)
SELECT page_id, CAST(position AS BIGINT) AS position,
  CASE WHEN starts_with(trim(href), 'http') THEN trim(href) ELSE 'http://files.example.org/' || ltrim(trim(href), '/') END AS url FROM l""",
)
def page_links(spark, folder):
    return links(star.read(spark, folder, "pages").select("page_id", "html"), "http://files.example.org")


def index_pages(spark, folder):
    """pages with links to product files put in front of their own text; several pages name the same file."""
    p = star.read(spark, folder, "pages")
    key = F.col("page_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (key % 200).cast("int"))
    iso = F.date_format(day, "yyyy-MM-dd")
    part = (key % 7 + 1).cast("string")
    hrefs = [
        F.concat(F.lit("BasicCompanyData-"), F.date_format(F.trunc(day, "month"), "yyyy-MM-dd"), F.lit("-part"), part, F.lit("_7.zip")),
        F.concat(F.lit("/psc-snapshot-"), iso, F.lit("_"), part, F.lit("of30.zip")),
        F.concat(F.lit("archive/Accounts_Bulk_Data-"), iso, F.lit(".zip")),
        F.when(F.month(day) <= 4, F.concat(F.lit("Accounts_Monthly_Data-"), F.date_format(day, "MMMMyyyy"), F.lit(".zip"))).otherwise("Accounts_Monthly_Data-Foo2024.zip"),
    ]
    anchors = F.concat(*[F.concat(F.lit('<a class="f" href="'), h, F.lit('">file</a>')) for h in hrefs])
    return p.select(key.alias("page_no"), F.concat(anchors, F.col("html")).alias("html"))


MANIFEST_SQL = """WITH p AS (SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id % 200 AS INTEGER) AS DATE) AS d, page_id % 7 + 1 AS part FROM pages),
f AS (
  SELECT page_id, 'company' AS product, 'BasicCompanyData-' || strftime(date_trunc('month', d), '%Y-%m-%d') || '-part' || part || '_7.zip' AS href,
    CAST(date_trunc('month', d) AS DATE) AS file_date, part, 7 AS total_parts, FALSE AS is_monthly_archive FROM p
  UNION ALL SELECT page_id, 'psc', 'psc-snapshot-' || strftime(d, '%Y-%m-%d') || '_' || part || 'of30.zip', d, part, 30, FALSE FROM p
  UNION ALL SELECT page_id, 'accounts', 'archive/Accounts_Bulk_Data-' || strftime(d, '%Y-%m-%d') || '.zip', d, NULL, NULL, FALSE FROM p
  UNION ALL SELECT page_id, 'accounts', 'Accounts_Monthly_Data-' || strftime(d, '%B%Y') || '.zip', CAST(date_trunc('month', d) AS DATE), NULL, NULL, TRUE FROM p WHERE month(d) <= 4),
m AS (SELECT product, 'http://files.example.org/' || href AS url, regexp_replace(href, '^.*/', '') AS filename, file_date,
    CAST(part AS BIGINT) AS part, CAST(total_parts AS BIGINT) AS total_parts, is_monthly_archive,
    row_number() OVER (PARTITION BY product, regexp_replace(href, '^.*/', '') ORDER BY page_id) AS rn FROM f)
"""
MANIFEST_COLUMNS = "product, url, filename, CAST(file_date AS VARCHAR) AS file_date, part, total_parts, is_monthly_archive"


def site_manifest(spark, folder):
    return manifest(index_pages(spark, folder), "http://files.example.org")


@query("manifest", f"{MANIFEST_SQL} SELECT {MANIFEST_COLUMNS} FROM m WHERE rn = 1")
def build_manifest(spark, folder):
    return site_manifest(spark, folder)


@query(
    "manifest_available_dates",
    f"{MANIFEST_SQL} SELECT DISTINCT product, CAST(file_date AS VARCHAR) AS file_date FROM m WHERE rn = 1",
)
def manifest_dates(spark, folder):
    return available_dates(site_manifest(spark, folder))


@query(
    "archive_supersedes_daily",
    f"""{MANIFEST_SQL} SELECT {MANIFEST_COLUMNS} FROM m WHERE rn = 1 AND product = 'accounts' AND (is_monthly_archive
OR file_date > coalesce((SELECT last_day(MAX(file_date)) FROM m WHERE is_monthly_archive), DATE '0001-01-01'))""",
)
def archive_supersedes_daily(spark, folder):
    return drop_superseded_dailies(site_manifest(spark, folder).where("product = 'accounts'"))


@query(
    "monthly_first_snapshot",
    f"""{MANIFEST_SQL} SELECT {MANIFEST_COLUMNS} FROM m WHERE rn = 1 AND product = 'psc' AND file_date IN
(SELECT MIN(file_date) FROM m WHERE product = 'psc' GROUP BY date_trunc('month', file_date))""",
)
def monthly_first_snapshot(spark, folder):
    return first_snapshot_of_month(site_manifest(spark, folder).where("product = 'psc'"))


@query(
    "manifest_choice",
    f"""{MANIFEST_SQL}, r AS (SELECT * FROM m WHERE rn = 1 AND file_date BETWEEN DATE '2024-02-10' AND DATE '2024-06-20')
SELECT {MANIFEST_COLUMNS} FROM r WHERE product = 'company'
  OR (product = 'psc' AND file_date IN (SELECT MIN(file_date) FROM r WHERE product = 'psc' GROUP BY date_trunc('month', file_date)))
  OR (product = 'accounts' AND (is_monthly_archive OR file_date > coalesce((SELECT last_day(MAX(file_date)) FROM r WHERE is_monthly_archive), DATE '0001-01-01')))""",
)
def manifest_choice(spark, folder):
    return choose(site_manifest(spark, folder), "2024-02-10", "2024-06-20")


@query(
    "orphan_guard",
    over("companies", "officers", body="""SELECT officer_id, company_number FROM officers
WHERE company_number IN (SELECT company_number FROM companies)"""),
)
def orphan_guard(spark, folder):
    rows = star.officers(spark, folder).select("officer_id", "company_number")
    return guard_orphans(rows, star.companies(spark, folder))


@query(
    "orphans",
    over("companies", "officers", body="""SELECT officer_id, company_number FROM officers
WHERE company_number NOT IN (SELECT company_number FROM companies)"""),
)
def orphan_rows(spark, folder):
    rows = star.officers(spark, folder).select("officer_id", "company_number")
    return orphans(rows, star.companies(spark, folder))


@query(
    "psc_raw_data",
    """SELECT o_orderkey AS row_no, '{"company_number":"' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') || '","data":{' ||
CASE WHEN o_orderstatus = 'O' THEN '"name":"Holding ' || CAST(o_orderkey AS VARCHAR) || '",' ELSE '' END ||
'"name_elements":{"title":"Ms","forename":"Ann","middle_name":"","surname":"No' || CAST(o_orderkey AS VARCHAR) || '"},' ||
'"address":{"address_line_1":"1 High Street","locality":"' || o_orderpriority || '"},"date_of_birth":{"year":' || CAST(year(o_orderdate) AS VARCHAR) ||
CASE WHEN o_orderstatus <> 'F' THEN ',"month":' || CAST(month(o_orderdate) AS VARCHAR) ELSE '' END || '},' ||
CASE WHEN o_orderstatus = 'P' THEN '"kind":"corporate-entity",' ELSE '' END || '"notified_on":"' || strftime(o_orderdate, '%Y-%m-%d') || '",' ||
CASE WHEN o_orderstatus = 'F' THEN '"ceased_on":"' || strftime(o_orderdate, '%Y-%m-%d') || '",' ELSE '' END ||
'"natures_of_control":["shares",null,"votes ' || o_orderstatus || '"]}}' AS raw_data FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '1-URGENT')""",
)
def psc_raw_data(spark, folder):
    """The record as it was delivered, beside what was made of it."""
    return psc_json.parse_lines(psc_lines(spark, folder)).where("reject is null").select("row_no", "raw_data")


LAYOUTS = [*dates.FILING_LAYOUTS, "d MMMM, yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "d'th' MMM yyyy"]


@query(
    "filing_date_layouts",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % {len(LAYOUTS)} IN ({", ".join(str(k) for k, x in enumerate(LAYOUTS) if x.endswith("-yy") or x.endswith(".yy") or x.endswith("/yy"))})
THEN '20' || strftime(o_orderdate, '%y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS found FROM orders""",
)
def filing_date_layouts(spark, folder):
    """Every layout a filing may use, by turns; years of two digits belong to this century."""
    written = F.lit(None).cast("string")
    for k, layout in enumerate(LAYOUTS):
        written = F.when(F.col("o_orderkey") % len(LAYOUTS) == k, F.date_format("o_orderdate", layout)).otherwise(written)
    return star.read(spark, folder, "orders").select("o_orderkey", dates.filing_date(written).alias("found"))
