"""Company search: filter codes become column predicates over companies with their latest figures."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from firmlake.functions.company import INDUSTRY_PREFIXES, industry_category, primary_sic
from firmlake.functions.finance import current_ratio, profit_margin, ratio
from firmlake.functions.text import contains_ci
from firmlake.operators.fuzzy import with_similarity
from firmlake.operators.latest import latest_financials

# Filter codes and their bounds, both ends included; None is open.
REVENUE = {
    "0-1m": (0, 1_000_000),
    "1m-10m": (1_000_000, 10_000_000),
    "10m-50m": (10_000_000, 50_000_000),
    "50m-100m": (50_000_000, 100_000_000),
    "100m+": (100_000_000, None),
    "50m+": (50_000_000, None),
}
EMPLOYEES = {"1-10": (1, 10), "11-50": (11, 50), "51-250": (51, 250), "251+": (251, None)}
COMPANY_SIZE = {"micro": (1, 10), "small": (11, 50), "medium": (51, 250), "large": (251, None)}
NET_ASSETS = {
    "0-100k": (0, 100_000),
    "100k-1m": (100_000, 1_000_000),
    "1m-10m": (1_000_000, 10_000_000),
    "10m+": (10_000_000, None),
}
DEBT_LEVEL = {"none": ("0", "0.01"), "low": ("0.01", "0.30"), "medium": ("0.30", "0.60"), "high": ("0.60", None)}
BREAKEVEN = (-10_000, 10_000)
AGE_YEARS = {"0-2": (0, 2), "3-5": (3, 5), "6-10": (6, 10), "11-20": (11, 20), "21+": (21, None)}
SORT_COLUMNS = {
    "company_name": "company_name",
    "company_number": "company_number",
    "incorporation_date": "incorporation_date",
    "latest_accounts_date": "latest_accounts_date",
    "turnover": "turnover",
    "net_worth": "net_worth",
    "employees": "active_officers_count",
    "relevance": "company_name",
}
DEFAULT_LIMIT = 100
DEFAULT_STATUS = "active"

PAGE_COLUMNS = [
    "company_number", "company_name", "company_status", "locality", "region", "postal_code", "primary_sic_code",
    "industry_category", "incorporation_date", "turnover", "profit_after_tax", "total_assets", "net_worth",
    "profit_margin", "current_ratio", "latest_accounts_date", "active_officers_count",
]


@dataclass(frozen=True)
class Filters:
    """Search criteria; an empty or unknown code adds no condition."""

    industry: str = ""
    location: str = ""
    revenue: str = ""
    employees: str = ""
    profitability: str = ""
    company_size: str = ""
    company_age: str = ""
    company_status: str = ""
    net_assets: str = ""
    debt_level: str = ""
    search_term: str = ""
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    order_by: str = "company_name"
    descending: bool = False
    reference_year: int = 0
    after: tuple | None = None  # (sort value, company number) of the last row of the page before


def _band(c: Column, bounds: tuple | None) -> Column | None:
    if bounds is None:
        return None
    low, high = bounds
    return c >= F.lit(low) if high is None else c.between(F.lit(low), F.lit(high))


def industry(code: str) -> Column | None:
    """Any industry code in a named industry, or, for other names, exactly this code."""
    if not code:
        return None
    if code not in INDUSTRY_PREFIXES:
        return F.array_contains("sic_codes", code)
    prefixes = INDUSTRY_PREFIXES[code]
    return F.exists("sic_codes", lambda s: reduce(lambda a, b: a | b, [s.startswith(p) for p in prefixes]))


def location(name: str) -> Column | None:
    return contains_ci(F.col("locality"), name) | contains_ci(F.col("region"), name) if name else None


def revenue(code: str) -> Column | None:
    return _band(F.col("turnover"), REVENUE.get(code))


def employees(code: str) -> Column | None:
    """Band on active officers, the only head count known; companies without any officer row are left out."""
    return _band(F.col("active_officers"), EMPLOYEES.get(code))


def company_size(code: str) -> Column | None:
    return _band(F.col("active_officers"), COMPANY_SIZE.get(code))


def profitability(code: str) -> Column | None:
    profit = F.col("profit_after_tax")
    return {
        "profitable": profit > 0,
        "loss_making": profit < 0,
        "breakeven": profit.between(*BREAKEVEN),
    }.get(code)


def company_age(code: str, reference_year: int) -> Column | None:
    """Calendar-year band on the incorporation date, counted back from the reference year."""
    if code not in AGE_YEARS:
        return None
    youngest, oldest = AGE_YEARS[code]
    born = F.col("incorporation_date")
    if oldest is None:
        return born <= F.lit(dt.date(reference_year - youngest, 1, 1))
    return born.between(F.lit(dt.date(reference_year - oldest, 1, 1)), F.lit(dt.date(reference_year - youngest, 12, 31)))


def company_status(code: str) -> Column | None:
    return F.lower("company_status") == code.lower() if code and code != "all" else None


def net_assets(code: str) -> Column | None:
    return F.col("net_worth") < 0 if code == "negative" else _band(F.col("net_worth"), NET_ASSETS.get(code))


def debt_level(code: str) -> Column | None:
    if code not in DEBT_LEVEL:
        return None
    low, high = (F.lit(b).cast("decimal(5,2)") if b else None for b in DEBT_LEVEL[code])
    share = ratio(F.col("total_liabilities"), F.col("total_assets"))
    return share >= low if high is None else share.between(low, high)


def search_term(term: str) -> Column | None:
    return contains_ci(F.col("company_name"), term) if term else None


def predicate(f: Filters) -> Column:
    """All given criteria together; the same for the page and for the count."""
    year = f.reference_year or dt.date.today().year
    parts = [
        industry(f.industry), location(f.location), revenue(f.revenue), employees(f.employees),
        profitability(f.profitability), company_size(f.company_size), company_age(f.company_age, year),
        company_status(f.company_status or DEFAULT_STATUS), net_assets(f.net_assets), debt_level(f.debt_level),
        search_term(f.search_term),
    ]
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def active_officers(officers: DataFrame) -> DataFrame:
    """Officers in office per company; partial counts run before the shuffle, so no company is too large."""
    return officers.groupBy("company_number").agg(F.count_if(F.col("resigned_on").isNull()).alias("active_officers"))


def company_profiles(
    companies: DataFrame, financials: DataFrame, officers: DataFrame, tie_break: list[str] | None = None
) -> DataFrame:
    """Companies with their latest figures and officer counts: what every search runs on.

    Write it out once per load to answer many searches without repeating the joins.
    """
    latest = latest_financials(financials, tie_break).select(
        "company_number",
        F.col("period_end").alias("latest_accounts_date"),
        "turnover",
        F.col("profit_loss").alias("profit_after_tax"),
        "total_assets",
        "total_liabilities",
        F.col("net_assets_liabilities").alias("net_worth"),
        profit_margin(F.col("profit_loss"), F.col("turnover")).alias("profit_margin"),
        current_ratio(F.col("current_assets"), F.col("current_liabilities")).alias("current_ratio"),
    )
    return (
        companies.join(latest, "company_number", "left")
        .join(active_officers(officers), "company_number", "left")
        .withColumn("primary_sic_code", primary_sic(F.col("sic_codes")))
        .withColumn("industry_category", industry_category("primary_sic_code"))
        .withColumn("active_officers_count", F.coalesce("active_officers", F.lit(0).cast("long")))
    )


def search(profiles: DataFrame, f: Filters) -> DataFrame:
    return profiles.where(predicate(f))


def search_count(profiles: DataFrame, f: Filters) -> DataFrame:
    return search(profiles, f).agg(F.count("*").alias("total"))


def search_order(f: Filters) -> list[Column]:
    column = SORT_COLUMNS.get(f.order_by, "company_name")
    if f.order_by == "relevance" and f.search_term:
        return [F.desc("similarity"), F.asc("company_number")]
    direction: Callable = F.desc_nulls_last if f.descending else F.asc_nulls_last
    return [direction(column), F.asc("company_number")]


def _beyond(f: Filters) -> Column:
    """Rows that come after ``f.after`` in the wanted order; NULL sort values come last."""
    by_likeness = f.order_by == "relevance" and f.search_term
    column = F.col("similarity" if by_likeness else SORT_COLUMNS.get(f.order_by, "company_name"))
    value, number = f.after
    later = F.col("company_number") > F.lit(number)
    if value is None:
        return column.isNull() & later
    further = column < F.lit(value) if f.descending or by_likeness else column > F.lit(value)
    return further | ((column == F.lit(value)) & later) | column.isNull()


def page_of(found: DataFrame, f: Filters) -> DataFrame:
    """One page in the wanted order: a top-k over all partitions, not a full sort.

    An offset makes the top-k as deep as the page lies. For deep pages give ``after`` instead: it becomes a predicate,
    and the work for any page is that of the first.
    """
    if f.order_by == "relevance" and f.search_term:
        found = with_similarity(found, f.search_term)
    if f.after is not None:
        found = found.where(_beyond(f))
    ordered = found.orderBy(*search_order(f))
    if f.offset > 0:
        ordered = ordered.offset(f.offset)
    return ordered.limit(f.limit if f.limit > 0 else DEFAULT_LIMIT).select(*PAGE_COLUMNS)


def search_page(profiles: DataFrame, f: Filters) -> DataFrame:
    return page_of(search(profiles, f), f)


def search_response(profiles: DataFrame, f: Filters) -> dict:
    """Page, total and has_more in one job: the total is observed while the page's top-k reads every match."""
    seen = Observation("matches")
    found = search(profiles, f).observe(seen, F.count("*").alias("total"))
    rows = page_of(found, f).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("company")).collect()
    total = seen.get["total"]
    offset = max(f.offset, 0)
    return {
        "companies": [r["company"] for r in rows],
        "total": total,
        "limit": f.limit if f.limit > 0 else DEFAULT_LIMIT,
        "offset": offset,
        "has_more": offset + len(rows) < total,
    }


def company_by_number(
    companies: DataFrame, financials: DataFrame, officers: DataFrame, number: str, tie_break: list[str] | None = None
) -> DataFrame:
    """Profile of one company; the key filter reaches all three scans."""

    def one(df: DataFrame) -> DataFrame:
        return df.where(F.col("company_number") == number)

    return company_profiles(one(companies), one(financials), one(officers), tie_break).select(*PAGE_COLUMNS)
