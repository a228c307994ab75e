"""Upserts, promotion and whole loads through tables and archives."""

from __future__ import annotations

import datetime as dt
import io
import shutil
import zipfile
from dataclasses import replace

from pyspark.sql import functions as F

from checks import star
from checks.columns import CSV_SQL, PSC_COLUMNS, PSC_HASH, PSC_SQL, csv_shaped, psc_lines
from checks.registry import over, query
from checks.reports import QUALITY, WAITING
from firmlake import schemas
from firmlake.operators.upsert import action_counts, changes, dedupe_load, upsert
from firmlake.plans import promotion, reports
from firmlake.plans.maintained import Reports
from firmlake.plans.products import ACCOUNTS, COMPANY, PSC, accepted, rejects
from firmlake.schemas import FINANCIAL_HASH, FINANCIAL_KEY, OFFICER_HASH, OFFICER_KEY, conform
from firmlake.plans.validation import mark_table
from firmlake.session import settle, work_path
from firmlake.sources.accounts import parse_documents, records
from firmlake.sources.archives import open_file, write_filings, write_lines
from firmlake.sources.company_csv import transform
from firmlake.sources.logs import current_batches, file_log, ingestion_log, merge_log
from firmlake.sources.tables import KeyedTable
from firmlake.sources.tags import load_tag_dictionary
from firmlake.sources.zip_source import register
from firmlake.streaming.ingest import in_order, ingest_available, load_files, load_manifest
from firmlake.streaming.states import batch_states, follow, rejected_rows

BATCH = "batch_building"
CUT = "1999-01-01"
FIELDS = ["turnover", "profit_loss", "total_assets", "total_liabilities", "net_assets_liabilities"]


def first_load(spark, folder):
    """Periods that ended before CUT, as an earlier batch stored them."""
    rows = star.hashed(star.financials(spark, folder), FINANCIAL_HASH).where(f"period_end < DATE'{CUT}'")
    rows = dedupe_load(rows, FINANCIAL_KEY, ["financial_id"])
    return rows.select(
        *FINANCIAL_KEY, *FIELDS, "data_hash", F.lit("b1").alias("batch_id"), F.lit(False).alias("change_detected")
    )


def second_load(spark, folder):
    """All periods; those without a proper start have a new turnover."""
    rows = star.financials(spark, folder)
    doubled = F.when(F.col("period_start") == F.col("period_end"), F.col("turnover") * 2).otherwise(F.col("turnover"))
    rows = star.hashed(rows.withColumn("turnover", doubled.cast(star.MONEY)), FINANCIAL_HASH)
    return dedupe_load(rows, FINANCIAL_KEY, ["financial_id"]).select(*FINANCIAL_KEY, *FIELDS, "data_hash")


STAMPS = {"batch_id": "b2"}
UPSERT_SQL = over("financials", body="").rstrip() + f""",
one AS (SELECT *, row_number() OVER (PARTITION BY company_number, period_end ORDER BY financial_id DESC) AS rn FROM financials),
old AS (SELECT company_number, period_end, turnover, total_liabilities, total_assets FROM one WHERE rn = 1 AND period_end < DATE '{CUT}'),
new AS (SELECT company_number, period_end, total_liabilities, total_assets,
  CAST(CASE WHEN period_start = period_end THEN turnover * 2 ELSE turnover END AS DECIMAL(15,2)) AS turnover FROM one WHERE rn = 1),
u AS (SELECT coalesce(n.company_number, o.company_number) AS company_number, coalesce(n.period_end, o.period_end) AS period_end,
  CASE WHEN n.company_number IS NULL THEN 'keep' WHEN o.company_number IS NULL THEN 'insert'
    WHEN n.turnover = o.turnover AND n.total_assets = o.total_assets AND n.total_liabilities = o.total_liabilities THEN 'skip' ELSE 'update' END AS action,
  n.turnover AS new_turnover, o.turnover AS old_turnover
  FROM new n FULL OUTER JOIN old o ON n.company_number = o.company_number AND n.period_end = o.period_end)
"""
STATE_SQL = """SELECT company_number, CAST(period_end AS VARCHAR) AS period_end, action,
CAST(CASE WHEN action IN ('insert', 'update') THEN new_turnover ELSE old_turnover END AS DOUBLE) AS turnover,
CASE WHEN action IN ('insert', 'update') THEN 'b2' ELSE 'b1' END AS batch_id, action = 'update' AS change_detected FROM u"""


def stamps():
    return {k: F.lit(v) for k, v in STAMPS.items()}


@query("upsert_snapshot", UPSERT_SQL + STATE_SQL)
def upsert_snapshot(spark, folder):
    rows = upsert(first_load(spark, folder), second_load(spark, folder), FINANCIAL_KEY, stamps=stamps())
    return rows.select("company_number", "period_end", "action", "turnover", "batch_id", "change_detected")


@query("upsert_changes", UPSERT_SQL + STATE_SQL + " WHERE action IN ('insert', 'update')")
def upsert_changes(spark, folder):
    rows = changes(first_load(spark, folder), second_load(spark, folder), FINANCIAL_KEY, stamps=stamps())
    return rows.where("action in ('insert', 'update')").select(
        "company_number", "period_end", "action", "turnover", "batch_id", "change_detected"
    )


@query(
    "upsert_actions",
    UPSERT_SQL + """SELECT COUNT(*) FILTER (WHERE action = 'insert') AS inserted, COUNT(*) FILTER (WHERE action = 'update') AS updated,
COUNT(*) FILTER (WHERE action = 'skip') AS skipped, COUNT(*) FILTER (WHERE action IN ('insert', 'update')) AS affected FROM u""",
)
def upsert_actions(spark, folder):
    return action_counts(changes(first_load(spark, folder), second_load(spark, folder), FINANCIAL_KEY, stamps=stamps()))


def officer_loads(spark, folder):
    cut = F.lit(CUT).cast("timestamp_ntz")
    columns = [*OFFICER_KEY, "nationality", "data_hash"]
    rows = dedupe_load(star.hashed(star.officers(spark, folder), OFFICER_HASH), OFFICER_KEY, ["officer_id"])
    stored = rows.where(F.col("last_updated") < cut).select(*columns, F.lit("b1").alias("batch_id"))
    return stored, rows.select(*columns)


@query(
    "officer_upsert_null_keys",
    over("officers", body=f"""SELECT 'null_safe' AS mode, CASE WHEN last_updated < TIMESTAMP '{CUT}' THEN 'skip' ELSE 'insert' END AS action,
COUNT(*) AS rows FROM (SELECT company_number, officer_name, appointed_on, officer_role, max_by(last_updated, officer_id) AS last_updated
FROM officers GROUP BY ALL) GROUP BY ALL
UNION ALL SELECT 'as_unique_constraint', 'insert', COUNT(*) FROM (SELECT DISTINCT company_number, officer_name, appointed_on, officer_role FROM officers)"""),
)
def officer_upsert_null_keys(spark, folder):
    """Every officer lacks a date of birth, a part of the key."""
    stored, rows = officer_loads(spark, folder)
    counts = [
        changes(stored, rows, OFFICER_KEY, stamps=stamps(), null_safe_keys=safe)
        .groupBy("action").agg(F.count("*").alias("rows")).select(F.lit(mode).alias("mode"), "action", "rows")
        for mode, safe in (("null_safe", True), ("as_unique_constraint", False))
    ]
    return counts[0].unionByName(counts[1])


NOW = dt.datetime(2026, 1, 2, 3, 4, 5)
BEFORE = dt.datetime(2025, 1, 1)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def known_companies(spark, folder):
    """Production as earlier batches left it: the companies of one region."""
    rows = star.production_companies(spark, folder).where("region = 'ASIA'")
    seen = F.lit(BEFORE).cast("timestamp_ntz")
    rows = rows.withColumns({"first_seen": seen, "last_updated": seen, "source_batch_id": F.lit("b0")})
    return conform(rows, schemas.PRODUCTION_COMPANIES)


@query(
    "promote_companies",
    over("score", "industries", body=f"""SELECT company_number, company_name, sic_codes[1] AS primary_sic_code, industry AS industry_category,
CAST(data_quality_score AS DOUBLE) AS data_quality_score, '{BATCH}' AS source_batch_id,
CASE WHEN region = 'ASIA' THEN 'update' ELSE 'insert' END AS action,
CASE WHEN region = 'ASIA' THEN '2025-01-01 00:00:00' ELSE '2026-01-02 03:04:05' END AS first_seen, '2026-01-02 03:04:05' AS last_updated
FROM score LEFT JOIN industries ON list_contains(prefixes, left(sic_codes[1], 2))
WHERE batch_id = '{BATCH}' AND NOT needs_review AND company_number IS NOT NULL AND company_name IS NOT NULL AND length(company_number) <= 8"""),
)
def promote_companies(spark, folder):
    rows, _ = promotion.promote_companies(star.companies(spark, folder), known_companies(spark, folder), BATCH, now())
    return rows.select(
        "company_number", "company_name", "primary_sic_code", "industry_category", "data_quality_score",
        "source_batch_id", "action", "first_seen", "last_updated",
    )


def known_officers(spark, folder):
    """Production as earlier batches left it: the officers who have an urgent role, under another nationality."""
    seen = F.lit(BEFORE).cast("timestamp_ntz")
    rows = promotion.officer_rows(star.officers(spark, folder).where("officer_role = '1-URGENT'"))
    rows = rows.withColumns({"nationality": F.lit("unknown"), "first_seen": seen, "last_updated": seen, "source_batch_id": F.lit("b0")})
    return conform(rows, schemas.PRODUCTION_OFFICERS)


@query(
    "promote_officers",
    over("companies", "officers", body=f"""SELECT DISTINCT o.company_number, o.officer_name, CASE WHEN o.officer_role = '' THEN 'unknown' ELSE o.officer_role END AS officer_role,
CAST(o.appointed_on AS VARCHAR) AS appointed_on, o.is_active, o.nationality,
CASE WHEN o.officer_role = '1-URGENT' THEN 'update' ELSE 'insert' END AS action,
CASE WHEN o.officer_role = '1-URGENT' THEN '2025-01-01 00:00:00' ELSE '2026-01-02 03:04:05' END AS first_seen, '2026-01-02 03:04:05' AS last_updated
FROM officers o JOIN companies c ON o.company_number = c.company_number
WHERE c.batch_id = '{BATCH}' AND NOT c.needs_review AND o.officer_name IS NOT NULL"""),
)
def promote_officers(spark, folder):
    rows, _ = promotion.promote_officers(
        star.hashed(star.officers(spark, folder), OFFICER_HASH), star.companies(spark, folder), known_officers(spark, folder), BATCH, now()
    )
    return rows.select(
        "company_number", "officer_name", "officer_role", "appointed_on", "is_active", "nationality", "action", "first_seen", "last_updated"
    )


PROMOTED_FINANCIALS = over("companies", "financials", body="").rstrip() + f""",
one AS (SELECT *, row_number() OVER (PARTITION BY company_number, period_end ORDER BY financial_id DESC) AS rn FROM financials),
mine AS (SELECT f.* FROM one f JOIN companies c ON f.company_number = c.company_number
  WHERE rn = 1 AND c.batch_id = '{BATCH}' AND NOT c.needs_review)
"""


def staged_financials(spark, folder):
    return dedupe_load(star.financials(spark, folder), FINANCIAL_KEY, ["financial_id"])


@query(
    "promote_financials",
    PROMOTED_FINANCIALS + """SELECT company_number, CAST(period_end AS VARCHAR) AS period_end, CAST(profit_loss AS DOUBLE) AS profit_after_tax,
CAST(net_assets_liabilities AS DOUBLE) AS net_worth, CASE WHEN source = '' THEN 'api' ELSE source END AS source,
CASE WHEN period_end < DATE '1999-01-01' THEN 'update' ELSE 'insert' END AS action,
CASE WHEN period_end < DATE '1999-01-01' THEN '2025-01-01 00:00:00' ELSE '2026-01-02 03:04:05' END AS first_seen
FROM mine WHERE period_end > period_start""",
)
def promote_financials(spark, folder):
    """Production holds the older periods already, with other figures."""
    seen = F.lit(BEFORE).cast("timestamp_ntz")
    stored = promotion.financial_rows(staged_financials(spark, folder).where(f"period_end < DATE'{CUT}'"))
    stored = stored.withColumns({"profit_after_tax": F.lit(0), "first_seen": seen, "last_updated": seen, "source_batch_id": F.lit("b0")})
    rows, _ = promotion.promote_financials(
        staged_financials(spark, folder), star.companies(spark, folder), conform(stored, schemas.PRODUCTION_FINANCIALS), BATCH, now()
    )
    return rows.select("company_number", "period_end", "profit_after_tax", "net_worth", "source", "action", "first_seen")


@query(
    "promotion_violations",
    PROMOTED_FINANCIALS + """SELECT company_number, CAST(period_end AS VARCHAR) AS period_end, 'period_not_positive' AS violations
FROM mine WHERE NOT period_end > period_start""",
)
def promotion_violations(spark, folder):
    stored = spark.createDataFrame([], schemas.PRODUCTION_FINANCIALS)
    _, broken = promotion.promote_financials(
        staged_financials(spark, folder), star.companies(spark, folder), stored, BATCH, now()
    )
    return broken.select("company_number", "period_end", "violations")


@query("keyed_table", UPSERT_SQL + STATE_SQL.replace("action, ", "", 1).replace("period_end, action,", "period_end,"))
def keyed_table(spark, folder):
    """Two loads through a table on disk, folded into a full copy, and the first one's label used again for more rows."""
    stored = first_load(spark, folder)
    table = KeyedTable(spark, work_path(spark, "financials"), stored.schema, FINANCIAL_KEY)
    table.write_changes(stored, "b1")
    table.compact()
    rows = settle(
        changes(table.read(), second_load(spark, folder), FINANCIAL_KEY, stamps=stamps()).where("action in ('insert', 'update')")
    )
    odd = F.pmod(F.xxhash64(*FINANCIAL_KEY), F.lit(2)) == 1
    table.write_changes(rows.where(odd), "b1")  # the full copy covers the first change set of this label
    table.write_changes(rows.where(~odd), "b2")
    return table.read().select("company_number", "period_end", "turnover", "batch_id", "change_detected")


def as_paths(written):
    """The few archive paths a write returns, as a frame that does not write again."""
    return written.sparkSession.createDataFrame([(r["path"],) for r in written.collect()], "path string")


def csv_archives(raw, folder: str, extra=None):
    """As many archives as a shuffle has tasks: the entry of one is read by one task. ``extra`` gives lines that follow a row's own."""
    raw = star.spread(raw, next(F.col(f"`{c}`") for c in raw.columns if c.strip() == "CompanyNumber"))
    header = ",".join(f'"{c}"' for c in raw.columns)
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in raw.columns]), {"quoteAll": "true"})
    lines = raw.select(line.alias("line") if extra is None else F.explode(F.concat(F.array(line), extra)).alias("line"))
    return write_lines(lines, folder, "companies.csv", header)


@query(
    "company_archives",
    f"""SELECT company_number, company_name, company_status, locality, region, array_to_string(sic_codes, '|') AS sic_codes,
CAST(incorporation_date AS VARCHAR) AS incorporation_date, accounts_ref_date, num_mort_charges, previous_names, CAST(NULL AS VARCHAR) AS reason FROM ({CSV_SQL})
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM (SELECT unnest(CASE c_custkey % 50
  WHEN 3 THEN ['line', 'line', 'line'] WHEN 4 THEN ['fields'] WHEN 5 THEN ['line', 'line'] ELSE [] END) AS reason FROM customer)""",
)
def company_archives(spark, folder):
    """Good rows and the reason of each reject; behind some records stand lines that must not become rows: an open quote with
    loose text after it, a record with too many fields, bytes of a quoted value that is never closed."""
    raw = csv_shaped(spark, folder)
    key = F.col(next(f"`{c}`" for c in raw.columns if c.strip() == "CompanyNumber")).substr(-8, 8).cast("long") % 50
    wide = ",".join(["x"] * (len(raw.columns) + 2))
    extra = (
        F.when(key == 3, F.array(F.lit('broken,"open, and more'), F.lit("loose text"), F.lit("more, loose text")))
        .when(key == 4, F.array(F.lit(wide)))
        .when(key == 5, F.array(F.lit('1,"a value that goes on'), F.lit('and on, "with a quoted word" in it')))
        .otherwise(F.array().cast("array<string>"))
    )
    paths = as_paths(csv_archives(raw, work_path(spark, "company-zips"), extra))
    parsed = settle(COMPANY.read(paths), "companies")
    rows = accepted(COMPANY, parsed, None).select(
        "company_number", "company_name", "company_status", "locality", "region", "sic_codes", "incorporation_date",
        "accounts_ref_date", "num_mort_charges", "previous_names",
    )
    kind = F.when(F.col("reason").startswith("line"), "line").when(F.col("reason").contains("fields instead of"), "fields").otherwise(F.col("reason"))
    return rows.unionByName(rejects(parsed).select(kind.alias("reason")), allowMissingColumns=True)


@query(
    "psc_archives",
    f"""SELECT {', '.join(c for c in PSC_COLUMNS if c != 'row_no')}, {PSC_HASH}, FALSE AS rejected FROM ({PSC_SQL})
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, TRUE FROM orders WHERE o_orderpriority IN ('5-LOW', '1-URGENT')""",
)
def psc_archives(spark, folder):
    paths = as_paths(
        write_lines(psc_lines(spark, folder), work_path(spark, "psc-zips"), "snapshot.txt")
    )
    parsed = settle(PSC.read(paths), "psc")
    rows = parsed.where("reject is null").select(
        *[c for c in PSC_COLUMNS if c != "row_no"], "data_hash", F.lit(False).alias("rejected")
    )
    bad = rejects(parsed).select(F.lit(True).alias("rejected"))
    return rows.unionByName(bad, allowMissingColumns=True)


def filing_documents(spark, folder):
    """One inline or plain XBRL filing per order, in several layouts."""
    o = star.spread(star.read(spark, folder, "orders"), "o_orderkey")
    day = star.day("o_orderdate")
    end, start = F.date_format(day, "yyyy-MM-dd"), F.date_format(F.date_sub(day, 364), "yyyy-MM-dd")
    before = F.date_format(F.date_sub(day, 365), "yyyy-MM-dd")
    money = F.format_number(F.col("o_totalprice").cast(star.MONEY), 2)
    number = star.number("o_custkey")
    named = F.col("o_orderstatus") != "P"

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    inline = text(
        "<html><body><xbrli:context id='now'><xbrli:entity><xbrli:identifier scheme='x'>", number,
        "</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>", start, "</xbrli:startDate><xbrli:endDate>", end,
        "</xbrli:endDate></xbrli:period></xbrli:context><xbrli:context id='then'><xbrli:period><xbrli:instant>", before,
        "</xbrli:instant></xbrli:period></xbrli:context><p>", F.col("o_orderpriority"), "</p>",
        "<ix:nonFraction name='uk:TurnoverGrossOperatingRevenue' contextRef='now'>7</ix:nonFraction>",
        "<ix:nonFraction name='uk:TurnoverRevenue' contextRef='now' decimals='0'>", money, "</ix:nonFraction>",
        "<ix:nonFraction contextRef='now' name='uk:Creditors'><b>", F.col("o_custkey").cast("string"), "</b>0</ix:nonFraction>",
        "<ix:nonFraction contextRef='now' name='uk:FixedAssets'>1</ix:nonFraction>\n",
        "<ix:nonFraction contextRef='now' name='uk:FixedAssets'>2</ix:nonFraction>",
        F.when(F.col("o_orderstatus") == "O", "<ix:nonFraction name='uk:Debtors' contextRef='then'>5</ix:nonFraction>").otherwise(""),
        "<ix:nonFraction name='uk:CurrentAssets' contextRef='now'>-</ix:nonFraction>",
        "<ix:nonNumeric name='uk:StartDateForPeriodCoveredByReport' contextRef='now'>", F.date_format(F.date_sub(day, 364), "d MMMM yyyy"),
        "</ix:nonNumeric><ix:nonNumeric name='uk:ReportTitle' contextRef='now'>Report <i>", F.col("o_orderkey").cast("string"),
        "</i></ix:nonNumeric></body></html>",
    )
    plain = text(
        "<?xml version='1.0'?><xbrl xmlns='http://www.xbrl.org/2003/instance' xmlns:uk='http://example.org/uk'><context id='now'>",
        "<entity><identifier scheme='x'>", number, "</identifier></entity><period><startDate>", start, "</startDate><endDate>", end,
        "</endDate></period></context><uk:TurnoverRevenue contextRef='now'>", money, "</uk:TurnoverRevenue>",
        "<uk:Creditors contextRef='now'>", F.col("o_custkey").cast("string"), "0</uk:Creditors>",
        "<uk:FixedAssets contextRef='now'>2</uk:FixedAssets><uk:ReportTitle contextRef='now'>Report ",
        F.col("o_orderkey").cast("string"), "</uk:ReportTitle></xbrl>",
    )
    is_inline = F.col("o_orderpriority") != "5-LOW"
    ending = F.when(is_inline, ".html").otherwise(".xml")
    entry = F.when(named, text("Prod223_", F.col("o_orderkey").cast("string"), "_", number, "_", F.date_format(day, "yyyyMMdd"), ending)).otherwise(text("filing-", F.col("o_orderkey").cast("string"), ending))
    return o.select(F.col("o_orderkey"), entry.alias("entry"), F.when(is_inline, inline).otherwise(plain).alias("body"))


FILING_SQL = """SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS company_number, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS period_end,
CAST(CAST(CAST(o_orderdate AS DATE) - 364 AS DATE) AS VARCHAR) AS period_start, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) AS turnover,
CAST(o_custkey * 10 AS DOUBLE) AS creditors, CAST(2 AS DOUBLE) AS fixed_assets, CAST(NULL AS DOUBLE) AS current_assets,
'Report ' || CAST(o_orderkey AS VARCHAR) AS report_title, 'bulk_xbrl' AS source FROM orders"""
FILING_COLUMNS = [
    "company_number", "period_end", "period_start", "turnover", "creditors", "fixed_assets", "current_assets",
    "report_title", "source",
]


def documents(spark, folder):
    rows = filing_documents(spark, folder)
    return rows.select(
        F.lit("orders").alias("archive"), "entry", F.col("o_orderkey").alias("pos"), F.lit(0).cast("long").alias("inner_pos"),
        F.substring_index("entry", ".", -1).alias("extension"), F.col("body").cast("binary").alias("body"),
        F.lit(None).cast("string").alias("reject"),
    )


@query("filings_roundtrip", FILING_SQL)
def filings_roundtrip(spark, folder):
    return parse_documents(documents(spark, folder)).where("reject is null").select(*FILING_COLUMNS)


@query("accounts_archives", FILING_SQL)
def accounts_archives(spark, folder):
    paths = as_paths(
        write_filings(filing_documents(spark, folder), work_path(spark, "accounts-zips"))
    )
    return ACCOUNTS.read(paths).where("reject is null").select(*FILING_COLUMNS)


INNER = 16


def nested_archives(paths, folder: str):
    """Outer archives that hold about INNER of the given ones each, every other one uncompressed; two of them also hold an entry
    that is damaged and one that is no archive."""

    class Damaging(io.RawIOBase):
        def __init__(self, file):
            self.file = file

        def writable(self):
            return True

        def write(self, data):
            return self.file.write(bytes(data).replace(b"<html>WHOLE", b"<html>SPLIT"))

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path = f"{folder}/outer-{part:05d}.zip"
        place = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
        import pyarrow.fs as pafs

        fs, inner = (pafs.LocalFileSystem(), place) if "://" not in place else pafs.FileSystem.from_uri(place)
        fs.create_dir(inner.rsplit("/", 1)[0])
        names = (p for b in batches for p in b["path"])
        with fs.open_output_stream(inner, buffer_size=1 << 20) as out, zipfile.ZipFile(Damaging(out), "w") as z:
            for k, name in enumerate(names):
                info = zipfile.ZipInfo(f"inner-{k}.zip")
                info.compress_type = zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED
                with open_file(name) as f, z.open(info, "w", force_zip64=True) as entry:
                    shutil.copyfileobj(f, entry, 1 << 20)
            if part < 2:
                z.writestr("Prod223_1_00000001_20200101.html", "<html>WHOLE</html>")
                z.writestr("none.zip", "no archive")
        yield pd.DataFrame({"path": [path]})

    outer = max(2, -(-paths.count() // INNER))
    return as_paths(paths.repartition(outer, "path").mapInPandas(run, "path string"))


@query("accounts_source", FILING_SQL + " UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'rejects', '4'")
def accounts_source(spark, folder):
    """Nested archives, some stored and some compressed, through the data source in small ranges; two damaged entries each."""
    register(spark)
    base = work_path(spark, "nested")
    inner = as_paths(write_filings(star.spread(filing_documents(spark, folder), "entry"), f"{base}/inner"))
    nested_archives(inner, f"{base}/outer")
    periods = settle(spark.read.format("accounts_filings").option("splitBytes", 1 << 18).load(f"{base}/outer"), "periods")
    rows = records(periods).where("reject is null").select(*FILING_COLUMNS)
    bad = rejects(records(periods)).agg(F.lit("rejects").alias("report_title"), F.count("*").cast("string").alias("source"))
    return rows.unionByName(bad, allowMissingColumns=True)


@query(
    "company_source",
    f"""SELECT company_number, company_name, company_status, locality, region, array_to_string(sic_codes, '|') AS sic_codes,
CAST(incorporation_date AS VARCHAR) AS incorporation_date, accounts_ref_date, num_mort_charges, previous_names FROM ({CSV_SQL})""",
)
def company_source(spark, folder):
    register(spark)
    base = work_path(spark, "company-source")
    csv_archives(csv_shaped(spark, folder), base).collect()
    return accepted(COMPANY, transform(spark.read.format("company_csv").load(base)), None).select(
        "company_number", "company_name", "company_status", "locality", "region", "sic_codes", "incorporation_date",
        "accounts_ref_date", "num_mort_charges", "previous_names",
    )


@query(
    "zip_entries",
    "SELECT 'xml' AS extension, COUNT(*) AS n FROM orders WHERE o_orderpriority = '5-LOW'",
)
def zip_entries(spark, folder):
    """Entries of one extension, without their bodies."""
    register(spark)
    base = work_path(spark, "zip-entries")
    write_filings(star.spread(filing_documents(spark, folder), "entry"), base).collect()
    listed = spark.read.format("zip_entries").schema("archive string, entry string, extension string, unpacked long").load(base)
    return listed.where("extension = 'xml'").groupBy("extension").agg(F.count("*").alias("n"))


def renamed(spark, folder):
    """The second delivery: every company, those with a negative balance under a new name."""
    raw = csv_shaped(spark, folder)
    name = F.when(F.col("` IncorporationDate`") == "not-a-date", F.concat(F.lit("RENAMED "), F.col("` CompanyName`")))
    return raw.withColumn(" CompanyName", F.coalesce(name, F.col("` CompanyName`")))


INCREMENTAL_SQL = """SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS company_number,
CASE WHEN c_acctbal < 0 THEN 'RENAMED ' || c_name ELSE c_name END AS company_name,
c_mktsegment <> 'MACHINERY' AND c_acctbal < 0 AS change_detected,
CASE WHEN c_mktsegment = 'MACHINERY' OR c_acctbal < 0 THEN 2 ELSE 1 END AS delivery FROM customer"""


@query("incremental_load", INCREMENTAL_SQL)
def incremental_load(spark, folder):
    """Two deliveries land in a folder; a stream run after each loads only what is new.

    The second run sees the first run's files again and must leave them alone. A third of the first delivery comes through
    another stream whose checkpoint has the same last part: neither may replace what the other has loaded.
    """
    base = work_path(spark, "incremental")
    tables = promotion.Tables.below(spark, f"{base}/tables")
    raw = csv_shaped(spark, folder)
    first = raw.where("trim(` CompanyStatus`) != 'Machinery'")
    third = F.col("`CompanyNumber`").cast("long") % 3 == 0 if "CompanyNumber" in raw.columns else F.col("` CompanyNumber`").cast("long") % 3 == 0
    csv_archives(first.where(~third), f"{base}/landing/first").collect()
    csv_archives(first.where(third), f"{base}/other").collect()
    ingest_available(spark, tables, COMPANY, f"{base}/landing/*", f"{base}/one/checkpoint")
    ingest_available(spark, tables, COMPANY, f"{base}/other", f"{base}/two/checkpoint")
    csv_archives(renamed(spark, folder), f"{base}/landing/second").collect()
    ingest_available(spark, tables, COMPANY, f"{base}/landing/*", f"{base}/one/checkpoint")
    epoch = F.regexp_extract("batch_id", r"(\d+)$", 1).cast("long")
    return tables.companies.read().select("company_number", "company_name", "change_detected", (epoch + 1).alias("delivery"))


@query(
    "load_log",
    """SELECT 'b1_company' AS batch_id, 'completed' AS status, 100.0::DOUBLE AS progress, COUNT(*) AS processed, COUNT(*) AS affected
FROM customer WHERE c_mktsegment <> 'MACHINERY'
UNION ALL SELECT 'b2_company', 'completed', 100.0::DOUBLE, COUNT(*), COUNT(*) FILTER (WHERE c_mktsegment = 'MACHINERY' OR c_acctbal < 0) FROM customer""",
)
def load_log(spark, folder):
    """State, progress and rows of two loads, from the logs that the loads wrote."""
    tables = two_loads(spark, folder)
    rows = file_log(spark, tables.file_log).where("status = 'completed'").groupBy("batch_id").agg(F.sum("rows").alias("processed"))
    log = ingestion_log(spark, tables.ingestion_log)
    affected = current_batches(log).select("batch_id", F.col("companies_count").alias("affected"))
    return reports.batch_progress(log).join(rows, "batch_id").join(affected, "batch_id")


@query("batch_load", INCREMENTAL_SQL.replace("THEN 2 ELSE 1 END AS delivery", "THEN 'b2_company' ELSE 'b1_company' END AS batch_id"))
def batch_load(spark, folder):
    """The same two deliveries as lists of files."""
    return two_loads(spark, folder).companies.read().select("company_number", "company_name", "change_detected", "batch_id")


def two_loads(spark, folder):
    base = work_path(spark, "batch")
    tables = promotion.Tables.below(spark, f"{base}/tables")
    first = as_paths(csv_archives(csv_shaped(spark, folder).where("trim(` CompanyStatus`) != 'Machinery'"), f"{base}/first"))
    second = as_paths(csv_archives(renamed(spark, folder), f"{base}/second"))
    for batch_id, paths in (("b1", first), ("b2", second)):
        load_manifest(spark, tables, paths.select(F.lit("company").alias("product"), F.col("path").alias("url")), batch_id)
    return tables


def store_batch(spark, folder, tables):
    """Staging tables from the derived frames, without the blemishes that would refuse the batch.

    A fifth of the companies lacks its status.
    """
    fifth = F.substring("company_number", -8, 8).cast("long") % 5 == 0
    companies = star.companies(spark, folder).withColumns(
        {"company_name": F.coalesce("company_name", F.lit("UNNAMED")),
         "company_status": F.when(~fifth, F.col("company_status")), "company_number": F.substring("company_number", -8, 8)}
    )
    tables.companies.write_changes(conform(companies, schemas.STAGING_COMPANIES), "start")
    officers = dedupe_load(star.hashed(star.officers(spark, folder), OFFICER_HASH), OFFICER_KEY, ["officer_id"])
    tables.officers.write_changes(conform(officers, schemas.STAGING_OFFICERS), "start")
    tables.financials.write_changes(conform(staged_financials(spark, folder), schemas.STAGING_FINANCIALS), "start")


MERGE_SQL = over("companies", "officers", "financials", body="").rstrip() + f""",
firms AS (SELECT right(company_number, 8) AS company_number, COALESCE(company_name, 'UNNAMED') AS company_name, needs_review,
  c_nation % 5 = 0 AS without_status, batch_id FROM (SELECT companies.*, CAST(right(company_number, 8) AS BIGINT) AS c_nation FROM companies)
  WHERE batch_id = '{BATCH}'),
one AS (SELECT *, row_number() OVER (PARTITION BY company_number, period_end ORDER BY financial_id DESC) AS rn FROM financials),
periods AS (SELECT one.*, firms.without_status, period_end > period_start AS sound FROM one JOIN firms USING (company_number) WHERE rn = 1),
people AS (SELECT company_number, officer_name, CASE WHEN officer_role = '' THEN 'unknown' ELSE officer_role END AS role, any_value(without_status) AS without_status
  FROM officers JOIN firms USING (company_number) WHERE officer_name IS NOT NULL
  GROUP BY company_number, officer_name, role, appointed_on)
SELECT 'companies' AS kind, company_number, company_name AS detail, CASE WHEN needs_review THEN 2 ELSE 1 END AS run,
  NOT without_status AS promoted FROM firms
UNION ALL SELECT 'officers', company_number, officer_name || ' ' || role, 2, TRUE FROM people WHERE NOT without_status
UNION ALL SELECT 'financials', company_number, CAST(period_end AS VARCHAR) || ' ' || CAST(profit_loss AS VARCHAR), 2, sound AND NOT without_status FROM periods"""


@query("merge_batch", MERGE_SQL)
def merge_batch(spark, folder):
    """A staged batch through validation and promotion, twice, with a review cleared in between.

    A fifth of the companies has no status and breaks a rule; their children are orphans. Companies and periods are listed
    as staging has them, with whether they are marked as merged; officers as production has them. The run is that in which
    a company was first promoted (or would have been).
    """
    tables = promotion.Tables.below(spark, work_path(spark, "merge"))
    store_batch(spark, folder, tables)
    first, second = now(), F.lit(NOW + dt.timedelta(days=1)).cast("timestamp_ntz")
    under_review = settle(tables.companies.read().where(f"batch_id = '{BATCH}' and needs_review"), "review")
    for stamp in (first, second):
        result = promotion.merge_batch(spark, tables, BATCH, stamp)
        if result["status"] != "success":
            raise ValueError(str(result))
        tables.companies.write_changes(under_review.withColumn("needs_review", F.lit(False)), "cleared")
    # The second run saw the cleared companies: what was promoted by it has its time.
    own = settle(tables.companies.read().where(f"batch_id = '{BATCH}'"), "own")
    production = {n: getattr(tables, f"production_{n}").read() for n in ("companies", "officers", "financials")}
    seen = production["companies"].select("company_number", F.col("first_seen").alias("seen"))
    stored = own.join(seen, "company_number", "left").select(
        F.lit("companies").alias("kind"), "company_number", F.col("company_name").alias("detail"),
        F.when(F.col("seen") == F.lit(NOW), 1).when(F.col("seen").isNotNull(), 2).alias("run"),
        F.col("seen").isNotNull().alias("promoted"),
    )
    review = under_review.select("company_number", F.lit(2).alias("_late"))
    stored = stored.join(review, "company_number", "left").withColumn("run", F.coalesce("run", "_late", F.lit(1))).drop("_late")
    people = production["officers"].select(
        F.lit("officers").alias("kind"), "company_number", F.concat_ws(" ", "officer_name", "officer_role").alias("detail"),
        F.lit(2).alias("run"), F.lit(True).alias("promoted"),
    )
    staged = tables.financials.read().join(own.select("company_number"), "company_number", "left_semi")
    periods = staged.select(
        F.lit("financials").alias("kind"), "company_number",
        F.concat_ws(" ", F.col("period_end").cast("string"), F.col("profit_loss").cast("string")).alias("detail"), F.lit(2).alias("run"),
        F.coalesce(F.col("merged_at") >= F.lit(NOW), F.lit(False)).alias("promoted"),  # older marks are those of the fixture
    )
    columns = ["kind", "company_number", "detail", "run", "promoted"]
    return stored.select(columns).unionByName(people.select(columns)).unionByName(periods.select(columns))


@query(
    "promotion_rejects",
    MERGE_SQL[: MERGE_SQL.index("SELECT 'companies' AS kind")] + """SELECT 'companies' AS kind, company_number, 'company_status_missing' AS reason FROM firms WHERE without_status AND NOT needs_review
UNION ALL SELECT 'officers', p.company_number, 'company_not_in_production' FROM people p JOIN firms f ON p.company_number = f.company_number
  WHERE p.without_status AND NOT f.needs_review
UNION ALL SELECT 'financials', p.company_number, CASE WHEN NOT sound THEN 'period_not_positive' ELSE 'company_not_in_production' END
  FROM periods p JOIN firms f ON p.company_number = f.company_number WHERE NOT f.needs_review AND (NOT sound OR p.without_status)""",
)
def promotion_rejects(spark, folder):
    """What one promotion sets aside, row by row."""
    tables = promotion.Tables.below(spark, work_path(spark, "merge"))
    store_batch(spark, folder, tables)
    promotion.merge_batch(spark, tables, BATCH, now())
    parts = [
        spark.read.parquet(f"{tables.rejects}/promotion-{BATCH}-{n}").select(F.lit(n).alias("kind"), "company_number", "reason")
        for n in ("companies", "officers", "financials")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "review_marks",
    over("companies", body=f"""SELECT company_number, needs_review OR (batch_id = '{BATCH}' AND company_name IS NULL) AS needs_review,
CASE WHEN batch_id = '{BATCH}' AND company_name IS NULL THEN 'Missing critical data: company_name ' ELSE review_notes END AS review_notes FROM companies"""),
)
def review_marks(spark, folder):
    """The staging table after the marks of a batch were stored in it."""
    tables = promotion.Tables.below(spark, work_path(spark, "review"))
    tables.companies.write_changes(conform(star.companies(spark, folder), schemas.STAGING_COMPANIES), "start")
    mark_table(tables.companies, BATCH)
    return tables.companies.read().select("company_number", "needs_review", "review_notes")


@query(
    "own_tag_dictionary",
    """SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS company_number, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS period_end,
CAST(o_custkey * 10 AS DOUBLE) AS turnover, CAST(2 AS DOUBLE) AS creditors, CAST(NULL AS DOUBLE) AS fixed_assets FROM orders""",
)
def own_tag_dictionary(spark, folder):
    """Filings read with a dictionary kept as JSON, which fills columns from other tags."""
    path = work_path(spark, "dictionary")
    text = '{"turnover": ["Creditors"], "creditors": ["Nothing", "fixed_Assets"]}'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    own = load_tag_dictionary(spark, path)
    rows = parse_documents(documents(spark, folder), dictionary=own).where("reject is null")
    return rows.select("company_number", "period_end", "turnover", "creditors", "fixed_assets")


MAINTAINED_SQL = over("companies", "financials", "officers", body=f""", raw_financials AS (SELECT * FROM financials) {QUALITY}""").replace(
    "financials AS (\nSELECT financial_id", "every_period AS (SELECT financial_id", 1).replace(
    ", raw_financials AS (SELECT * FROM financials)", """, financials AS (SELECT * EXCLUDE rn FROM (SELECT *,
  row_number() OVER (PARTITION BY company_number, period_end ORDER BY financial_id DESC) AS rn FROM every_period) WHERE rn = 1),
people AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_number, officer_name, appointed_on, officer_role
  ORDER BY officer_id DESC) AS rn FROM officers) WHERE rn = 1)""") + WAITING + """
SELECT 'data_quality' AS report, name AS item, value FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM quality) ON COLUMNS(*))
UNION ALL SELECT 'pending_merge', table_name || ' ' || name, value FROM (UNPIVOT (SELECT table_name, CAST(pending_count AS VARCHAR) AS pending_count,
  oldest_record, newest_record FROM waiting) ON pending_count, oldest_record, newest_record)
UNION ALL SELECT 'table_status', 'companies', CAST(COUNT(*) AS VARCHAR) FROM companies
UNION ALL SELECT 'table_status', 'financials', CAST(COUNT(*) AS VARCHAR) FROM financials
UNION ALL SELECT 'table_status', 'officers', CAST(COUNT(*) AS VARCHAR) FROM people
UNION ALL SELECT 'active_officers', company_number, CAST(COUNT(*) AS VARCHAR) FROM people WHERE resigned_on IS NULL GROUP BY company_number"""


@query("maintained_reports", MAINTAINED_SQL)
def maintained_reports(spark, folder):
    """Four reports that follow change sets: a first load with other values, a second one that corrects every row and adds the rest,
    and the second one again. The reports were last counted after the first load."""
    base = work_path(spark, "maintained")
    tables = promotion.Tables.below(spark, f"{base}/tables")
    summary = Reports.of(tables, f"{base}/reports")
    companies = settle(conform(star.companies(spark, folder), schemas.STAGING_COMPANIES), "companies")
    financials = settle(conform(staged_financials(spark, folder), schemas.STAGING_FINANCIALS), "financials")
    people = dedupe_load(star.hashed(star.officers(spark, folder), OFFICER_HASH), OFFICER_KEY, ["officer_id"])
    officers = settle(conform(people, schemas.STAGING_OFFICERS), "officers")
    late = F.lit(dt.datetime(2030, 1, 1)).cast("timestamp_ntz")
    some = "coalesce(company_number, '') < '00000800'"
    tables.companies.write_changes(companies.where(some).withColumns({"locality": F.lit(None).cast("string"), "last_updated": late, "merged_at": late}), "b1")
    tables.financials.write_changes(financials.where(some).withColumns({"merged_at": F.lit(None).cast("timestamp_ntz"), "ingested_at": late}), "b1")
    tables.officers.write_changes(officers.where(some).withColumn("resigned_on", F.lit(None).cast("date")), "b1")
    summary.refresh()
    for _ in range(2):
        for table, rows in ((tables.companies, companies), (tables.financials, financials), (tables.officers, officers)):
            table.write_changes(rows, "b2")
        read = summary.refresh()
        if read != ["changes"] * 4:
            raise ValueError(f"the reports read more than change sets: {read}")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    quality = summary.data_quality().withColumn("latest_update", stamp("latest_update"))
    quality = quality.select(*[F.col(c).cast("string") for c in quality.columns]).unpivot([], quality.columns, "item", "value")
    waiting = summary.pending_merge().select(
        "table_name", F.col("pending_count").cast("string").alias("pending_count"), stamp("oldest_record").alias("oldest_record"), stamp("newest_record").alias("newest_record")
    )
    waiting = waiting.unpivot(["table_name"], ["pending_count", "oldest_record", "newest_record"], "name", "value")
    parts = [
        quality.select(F.lit("data_quality").alias("report"), "item", "value"),
        waiting.select(F.lit("pending_merge"), F.concat_ws(" ", "table_name", "name"), "value"),
        summary.table_status().select(F.lit("table_status"), "table_name", F.col("rows").cast("string")),
        summary.active_officers().select(F.lit("active_officers"), "company_number", F.col("active_officers").cast("string")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).where("value is not null")


@query(
    "accounts_load",
    """SELECT company_number, period_end, turnover, batch_id, change_detected FROM (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS company_number, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS period_end,
    CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) AS turnover, 'a1' AS batch_id, FALSE AS change_detected,
    row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS rn FROM orders
  WHERE o_custkey IN (SELECT c_custkey FROM customer)) WHERE rn = 1""",
)
def accounts_load(spark, folder):
    """Filings loaded from archives in which every period stands twice, the second time with its right turnover; then once more.

    The last record of a period counts, and the same files change nothing.
    """
    base = work_path(spark, "accounts-load")
    tables = promotion.Tables.below(spark, f"{base}/tables")
    numbers = star.read(spark, folder, "customer").select(star.number("c_custkey").alias("company_number"))
    tables.companies.write_changes(conform(numbers, schemas.STAGING_COMPANIES), "start")
    # All filings of a company stand in one archive, by order.
    filed = filing_documents(spark, folder).join(star.read(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    first = F.struct(F.regexp_replace("entry", "^([a-zA-Z]+)", "$1").alias("entry"), F.regexp_replace("body", r"(TurnoverRevenue[^>]*>)[\d,.]+", "$11").alias("body"))
    second = F.struct(F.regexp_replace("entry", "[.]", "-again.").alias("entry"), "body")
    named = F.when(F.col("entry").startswith("Prod"), F.struct(F.concat(F.lit("Prod224"), F.substring("entry", 8, 200)).alias("entry"), "body")).otherwise(second)
    pairs = star.spread(filed, "o_custkey").sortWithinPartitions("o_orderkey").select(F.explode(F.array(first, named)).alias("x")).select("x.*")
    paths = as_paths(write_filings(pairs, f"{base}/zips"))
    for batch in ("a1", "a2"):
        load_files(spark, tables, ACCOUNTS, paths, batch)
    return tables.financials.read().select("company_number", "period_end", "turnover", "batch_id", "change_detected")


MERGES_SQL = " UNION ALL ".join(
    f"""SELECT * FROM ({MERGE_SQL[: MERGE_SQL.index("SELECT 'companies' AS kind")].replace(BATCH, batch)}
SELECT '{batch}' AS batch_id, (SELECT COUNT(*) FROM firms WHERE NOT needs_review AND NOT without_status) AS companies_merged,
  (SELECT COUNT(*) FROM people JOIN firms USING (company_number) WHERE NOT needs_review AND NOT firms.without_status) AS officers_merged,
  (SELECT COUNT(*) FROM periods JOIN firms USING (company_number) WHERE sound AND NOT needs_review AND NOT firms.without_status) AS financials_merged,
  'promotion' AS merged_by)""" for batch in (BATCH, "batch_machinery"))  # fmt: skip


@query("merge_log", MERGES_SQL)
def merges_logged(spark, folder):
    """What the log of merges says of two batches."""
    tables = promotion.Tables.below(spark, work_path(spark, "merge"))
    store_batch(spark, folder, tables)
    for batch in (BATCH, "batch_machinery"):
        result = promotion.merge_batch(spark, tables, batch, now())
        if result["status"] != "success":
            raise ValueError(str(result))
    return merge_log(spark, tables.merge_log).select("batch_id", "companies_merged", "officers_merged", "financials_merged", "merged_by")


@query(
    "custom_product",
    """SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS company_number, upper(c_name) AS company_name, md5(upper(c_name)) AS data_hash, 'c1' AS batch_id FROM customer""",
)
def custom_product(spark, folder):
    """A product with a transform and hash fields of its own; a second delivery that changes none of those fields changes nothing."""
    base = work_path(spark, "custom")
    tables = promotion.Tables.below(spark, f"{base}/tables")
    upper = replace(COMPANY, transform=lambda df: df.withColumn("company_name", F.upper("company_name")), hash_fields=["company_name"])
    raw = csv_shaped(spark, folder)
    moved = raw.withColumn(" RegAddress.PostTown", F.lit("ELSEWHERE"))
    for batch, rows in (("c1", raw), ("c2", moved)):
        load_files(spark, tables, upper, as_paths(csv_archives(rows, f"{base}/{batch}")), batch)
    return tables.companies.read().select("company_number", "company_name", "data_hash", "batch_id")


STATES_SQL = over("log", body="").replace("WITH log", "WITH RECURSIVE log", 1) + """, l AS (
  SELECT batch_id, status, logged_at, row_number() OVER (PARTITION BY batch_id ORDER BY logged_at, status) AS n FROM log),
s AS (SELECT DISTINCT batch_id, CAST(0 AS BIGINT) AS n, '' AS state, CAST(NULL AS TIMESTAMP) AS since, FALSE AS bad FROM l
  UNION ALL SELECT batch_id, n, CASE WHEN ok THEN status ELSE state END, CASE WHEN ok THEN logged_at ELSE since END, NOT ok FROM (
    SELECT l.batch_id, l.n, l.status, l.logged_at, s.state, s.since, COALESCE(l.status = 'running' OR (s.state IN ('', 'paused') AND l.status = 'paused')
      OR (s.state = 'running' AND l.status IN ('paused', 'completed', 'completed_with_errors', 'failed')), FALSE) AS ok
    FROM s JOIN l ON l.batch_id = s.batch_id AND l.n = s.n + 1))
SELECT batch_id, NULLIF(arg_max(state, n), '') AS status, strftime(arg_max(since, n), '%Y-%m-%d %H:%M:%S') AS logged_at,
  COUNT(*) FILTER (WHERE bad) AS n_rejects FROM s GROUP BY batch_id"""


@query("batch_state_stream", STATES_SQL)
def batch_state_stream(spark, folder):
    """Where each batch stands by its transitions, from a log that is read in four micro-batches; rows that are no transition are counted."""
    base = work_path(spark, "states")
    star.ingestion_log(spark, folder).repartitionByRange(4, "logged_at").write.parquet(f"{base}/log")
    in_order(spark, f"{base}/log")
    follow(spark, f"{base}/log", f"{base}/states", f"{base}/checkpoint", files_per_batch=1)
    bad = rejected_rows(spark, f"{base}/states").groupBy("batch_id").agg(F.count("*").alias("n_rejects"))
    both = batch_states(spark, f"{base}/states").join(bad, "batch_id", "full")
    return both.select("batch_id", "status", "logged_at", F.coalesce("n_rejects", F.lit(0)).alias("n_rejects"))
