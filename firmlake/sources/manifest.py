"""Bulk files found on index pages, and which of them to load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlake.operators.latest import first_per_key

# File names of the products. Groups: company date, part, parts; PSC date, part, parts; day; month and year.
PRODUCT_FILE = (
    r"(?i)(?:BasicCompanyData-(\d{4}-\d{2}-\d{2})-part(\d+)_(\d+)"
    r"|psc-snapshot-(\d{4}-\d{2}-\d{2})_(\d+)of(\d+)"
    r"|Accounts_Bulk_Data-(\d{4}-\d{2}-\d{2})"
    r"|Accounts_Monthly_Data-([a-zA-Z]+\d{4}))\.zip"
)

LINK = r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"
LINK_TARGET = r"(?is)\bhref\s*=\s*[\"']?([^\"'>]*)[\"']?$"


def links(pages: DataFrame, base_url: str) -> DataFrame:
    """Every link of every page in document order: ``(page columns, position, url)``, made absolute."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit(LINK), F.lit(0))).alias("position", "_link")
    target = F.replace(F.trim(F.regexp_extract("_link", LINK_TARGET, 1)), F.lit("&amp;"), F.lit("&"))
    absolute = F.when(F.col("_href").startswith("http"), F.col("_href")).otherwise(
        F.concat(F.lit(base_url.rstrip("/") + "/"), F.ltrim(F.col("_href"), F.lit("/")))
    )
    keep = [c for c in pages.columns if c != "html"]
    return pages.select(*keep, found).withColumn("_href", target).select(*keep, "position", absolute.alias("url"))


def classify(urls: DataFrame) -> DataFrame:
    """Product, date and part of every link that names a product file; other links and impossible dates are dropped."""
    groups = F.array(*[F.regexp_extract("url", PRODUCT_FILE, i) for i in range(1, 9)])
    company, company_part, company_parts, psc, psc_part, psc_parts, day, month = (F.col("_g")[i] for i in range(8))
    product = F.when(company != "", "company").when(psc != "", "psc").otherwise("accounts")
    date = F.coalesce(F.try_to_date(F.concat(company, psc, day), "yyyy-MM-dd"), F.try_to_date(month, "MMMMyyyy"))
    return (
        # Links that name no product file go first: they are most of any page.
        urls.where(F.col("url").rlike(PRODUCT_FILE))
        .withColumn("_g", groups)
        .withColumns(
            {
                "product": product,
                "filename": F.substring_index("url", "/", -1),
                "file_date": date,
                "part": F.concat(company_part, psc_part).try_cast("int"),
                "total_parts": F.concat(company_parts, psc_parts).try_cast("int"),
                "is_monthly_archive": month != "",
            }
        )
        .drop("_g")
        .where("file_date is not null")
    )


def file_order(path: Column) -> dict[str, Column]:
    """Date and part number in a product file's name, to tell which of two files is later; NULL for other names."""
    # No text, no date and no part: a text that is none costs an exception, and this runs for every row of a load. Every
    # pattern ends with the path and takes no "/": only the file name is searched, not the folders before it.
    name = F.substring_index(path, "/", -1)

    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))

    day = F.try_to_date(found(r"-(\d{4}-\d{2}-\d{2})[^/]*$"), "yyyy-MM-dd")
    month = F.try_to_date(found(r"-([a-zA-Z]+\d{4})\.zip$"), "MMMMyyyy")
    part = found(r"(?i)(?:part|_)(\d+)(?:_|of)\d+\.zip$").try_cast("int")
    return {"_file_date": F.coalesce(day, month), "_file_part": part}


def manifest(pages: DataFrame, base_url: str) -> DataFrame:
    """Product files of index pages ``(page_no, html)``; of equal file names the first in page order counts."""
    files = classify(links(pages.select("page_no", "html"), base_url))
    first = first_per_key(files, ["product", "filename"], [F.asc("page_no"), F.asc("position")])
    return first.drop("page_no", "position")


def in_range(files: DataFrame, start: str, end: str) -> DataFrame:
    return files.where(F.col("file_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def drop_superseded_dailies(files: DataFrame) -> DataFrame:
    """Accounts: daily files up to the end of the newest monthly archive's month are in that archive already."""
    newest = files.where("is_monthly_archive").groupBy("product").agg(F.last_day(F.max("file_date")).alias("_covered"))
    covered = files.join(newest, "product", "left")
    late = F.col("_covered").isNull() | (F.col("file_date") > F.col("_covered"))
    return covered.where(F.col("is_monthly_archive") | late).drop("_covered")


def first_snapshot_of_month(files: DataFrame) -> DataFrame:
    """All parts of the earliest snapshot of every calendar month."""
    month = F.trunc("file_date", "month")
    first = files.groupBy("product", month.alias("_month")).agg(F.min("file_date").alias("file_date"))
    return files.join(first.drop("_month"), ["product", "file_date"], "left_semi")


def choose(files: DataFrame, start: str, end: str, monthly_only: bool = True) -> DataFrame:
    """Files to load for a date range, ordered by product, date and part."""
    chosen = in_range(files, start, end)
    accounts = drop_superseded_dailies(chosen.where("product = 'accounts'"))
    psc = chosen.where("product = 'psc'")
    if monthly_only:
        psc = first_snapshot_of_month(psc)
    kept = chosen.where("product = 'company'").unionByName(psc).unionByName(accounts.select(*chosen.columns))
    return kept.orderBy("product", "file_date", F.coalesce("part", F.lit(0)), "filename")


def available_dates(files: DataFrame) -> DataFrame:
    return files.select("product", "file_date").distinct().orderBy("product", "file_date")
