"""Search: filters, pages, counts, fuzzy names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import star
from checks.registry import PAGE, over, query
from firmlake.operators.fuzzy import fuzzy_name_match
from firmlake.operators.identity import Weights, groups, officer_block
from firmlake.operators.latest import latest_financials
from firmlake.operators.linkage import count_links
from firmlake.plans import search as s
from firmlake.plans.paged import Listing, lay_out
from firmlake.plans.search import Filters
from firmlake.session import work_path

TIE = ["financial_id"]


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    return s.company_profiles(
        star.companies(spark, folder), star.financials(spark, folder), star.officers(spark, folder), TIE
    )


def filter_query(name: str, predicate, condition: dict) -> None:
    """Matches of every code of a filter, as (code, company_number)."""

    sql = " UNION ALL ".join(
        f"SELECT '{code}' AS code, company_number FROM profiles WHERE {where}" for code, where in condition.items()
    )

    @query(name, over("profiles", body=sql))
    def build(spark, folder):
        found = profiles(spark, folder)
        hits = F.array_compact(F.array(*[F.when(predicate(code), code) for code in condition]))
        return found.select(F.explode(hits).alias("code"), "company_number")


def among(prefixes: list[str]) -> str:
    tests = " OR ".join(f"x ILIKE '{p}%'" for p in prefixes)
    return f"len(list_filter(sic_codes, lambda x: {tests})) > 0"


def register() -> None:
    filter_query(
        "filter_industry",
        s.industry,
        {
            "tech": among(["62", "63"]),
            "finance": among(["64", "65", "66"]),
            "retail": among(["47"]),
            "manufacturing": among([str(n) for n in range(10, 34)]),
            "professional": among([str(n) for n in range(69, 75)]),
            "62110": "list_contains(sic_codes, '62110')",
        },
    )
    filter_query(
        "filter_location",
        s.location,
        {c: f"(locality ILIKE '%{c}%' OR region ILIKE '%{c}%')" for c in ("nation_1", "asia", "Eur")},
    )
    filter_query(
        "filter_revenue",
        s.revenue,
        {
            "0-1m": "turnover BETWEEN 0 AND 1000000",
            "1m-10m": "turnover BETWEEN 1000000 AND 10000000",
            "10m-50m": "turnover BETWEEN 10000000 AND 50000000",
            "50m-100m": "turnover BETWEEN 50000000 AND 100000000",
            "100m+": "turnover >= 100000000",
            "50m+": "turnover >= 50000000",
        },
    )
    filter_query(
        "filter_employees",
        s.employees,
        {
            "1-10": "active_officers BETWEEN 1 AND 10",
            "11-50": "active_officers BETWEEN 11 AND 50",
            "51-250": "active_officers BETWEEN 51 AND 250",
            "251+": "active_officers >= 251",
        },
    )
    filter_query(
        "filter_size",
        s.company_size,
        {
            "micro": "active_officers BETWEEN 1 AND 10",
            "small": "active_officers BETWEEN 11 AND 50",
            "medium": "active_officers BETWEEN 51 AND 250",
            "large": "active_officers >= 251",
        },
    )
    filter_query(
        "filter_profitability",
        s.profitability,
        {
            "profitable": "profit_after_tax > 0",
            "loss_making": "profit_after_tax < 0",
            "breakeven": "profit_after_tax BETWEEN -10000 AND 10000",
        },
    )
    filter_query(
        "filter_age",
        lambda c: s.company_age(c, 2026),
        {
            "0-2": "incorporation_date BETWEEN DATE '2024-01-01' AND DATE '2026-12-31'",
            "3-5": "incorporation_date BETWEEN DATE '2021-01-01' AND DATE '2023-12-31'",
            "6-10": "incorporation_date BETWEEN DATE '2016-01-01' AND DATE '2020-12-31'",
            "11-20": "incorporation_date BETWEEN DATE '2006-01-01' AND DATE '2015-12-31'",
            "21+": "incorporation_date <= DATE '2005-01-01'",
        },
    )
    filter_query(
        "filter_status",
        s.company_status,
        {c: f"LOWER(company_status) = LOWER('{c}')" for c in ("Active", "MACHINERY")},
    )
    filter_query(
        "filter_net_assets",
        s.net_assets,
        {
            "negative": "net_worth < 0",
            "0-100k": "net_worth BETWEEN 0 AND 100000",
            "100k-1m": "net_worth BETWEEN 100000 AND 1000000",
            "1m-10m": "net_worth BETWEEN 1000000 AND 10000000",
            "10m+": "net_worth >= 10000000",
        },
    )
    debt = "(CAST(total_liabilities AS DOUBLE) / NULLIF(CAST(total_assets AS DOUBLE), 0))"
    filter_query(
        "filter_debt",
        s.debt_level,
        {
            "none": f"{debt} BETWEEN 0 AND 0.01",
            "low": f"{debt} BETWEEN 0.01 AND 0.30",
            "medium": f"{debt} BETWEEN 0.30 AND 0.60",
            "high": f"{debt} >= 0.60",
        },
    )
    filter_query(
        "filter_name",
        s.search_term,
        {c: f"company_name ILIKE '%{c}%'" for c in ("#00000012", "CUSTOMER#", "zzz")},
    )


register()

WIDE = Filters(industry="manufacturing", location="a", revenue="10m-50m", employees="1-10", company_status="all",
               net_assets="0-100k", limit=25, offset=5, order_by="turnover", descending=True)
WIDE_SQL = f"""{among([str(n) for n in range(10, 34)])} AND (locality ILIKE '%a%' OR region ILIKE '%a%')
AND turnover BETWEEN 10000000 AND 50000000 AND active_officers BETWEEN 1 AND 10 AND net_worth BETWEEN 0 AND 100000"""


@query(
    "search_page",
    over("profiles", body=f"""SELECT {PAGE} FROM profiles WHERE {WIDE_SQL}
ORDER BY profiles.turnover DESC NULLS LAST, company_number LIMIT 25 OFFSET 5"""),
)
def search_page(spark, folder):
    return s.search_page(profiles(spark, folder), WIDE)


@query("search_count", over("profiles", body=f"SELECT COUNT(*) AS total FROM profiles WHERE {WIDE_SQL}"))
def search_count(spark, folder):
    return s.search_count(profiles(spark, folder), WIDE)


@query(
    "search_response",
    over("profiles", body=f"""SELECT total, least(25, greatest(total - 5, 0)) AS returned,
5 + least(25, greatest(total - 5, 0)) < total AS has_more FROM (SELECT COUNT(*) AS total FROM profiles WHERE {WIDE_SQL})"""),
)
def search_response(spark, folder):
    """Page and total of one job, as the row a caller would answer with."""
    answer = s.search_response(profiles(spark, folder), WIDE)
    row = (answer["total"], len(answer["companies"]), answer["has_more"])
    return spark.createDataFrame([row], "total long, returned long, has_more boolean")


@query(
    "search_page_default",
    over("profiles", body=f"""SELECT {PAGE} FROM profiles WHERE LOWER(company_status) = 'active'
ORDER BY company_name ASC NULLS LAST, company_number LIMIT 100"""),
)
def search_page_default(spark, folder):
    return s.search_page(profiles(spark, folder), Filters())


@query(
    "search_all",
    over("profiles", body=f"""SELECT {PAGE} FROM profiles WHERE LOWER(company_status) = 'active'"""),
)
def search_all(spark, folder):
    return s.search(profiles(spark, folder), Filters()).select(*s.PAGE_COLUMNS)


@query(
    "company_by_number",
    over("profiles", body=f"SELECT {PAGE} FROM profiles WHERE company_number = '00000042'"),
)
def company_by_number(spark, folder):
    return s.company_by_number(
        star.companies(spark, folder), star.financials(spark, folder), star.officers(spark, folder), "00000042", TIE
    )


@query(
    "latest_financials",
    over("latest", body="""SELECT company_number, CAST(period_end AS VARCHAR) AS period_end, financial_id,
CAST(turnover AS DOUBLE) AS turnover FROM latest"""),
)
def latest(spark, folder):
    return latest_financials(star.financials(spark, folder), TIE).select(
        "company_number", "period_end", "financial_id", "turnover"
    )


@query(
    "active_officer_counts",
    over("officer_counts", body="SELECT company_number, active_officers FROM officer_counts"),
)
def active_officer_counts(spark, folder):
    return s.active_officers(star.officers(spark, folder))


GRAMS = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'),
  lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query(
    "fuzzy_name_match",
    f"""WITH g AS (SELECT p_partkey, p_name, {GRAMS.format(c="p_name")} AS a, {GRAMS.format(c="'bleu wigdet'")} AS b FROM part)
SELECT p_partkey, p_name, CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) AS similarity
FROM g ORDER BY similarity DESC, p_partkey LIMIT 40""",
)
def fuzzy(spark, folder):
    parts = star.read(spark, folder, "part").select("p_partkey", "p_name")
    return fuzzy_name_match(parts, "bleu wigdet", 40, "p_name", "p_partkey")


@query(
    "search_relevance",
    over("profiles", body=f"""SELECT {PAGE} FROM (SELECT *, {GRAMS.format(c="company_name")} AS a,
{GRAMS.format(c="'customer'")} AS b FROM profiles WHERE company_name ILIKE '%customer%')
ORDER BY CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) DESC, company_number LIMIT 30"""),
)
def search_relevance(spark, folder):
    f = Filters(company_status="all", search_term="customer", order_by="relevance", limit=30)
    return s.search_page(profiles(spark, folder), f)


NAMES = """SELECT 'part-' || CAST(p_partkey AS VARCHAR) AS key, p_name AS name FROM part
UNION ALL SELECT 'supplier-' || CAST(s_suppkey AS VARCHAR), s_name FROM supplier"""


@query(
    "name_linkage",
    f"""WITH n AS ({NAMES}), g AS (SELECT key, list_sort({GRAMS.format(c="name")}) AS g FROM n),
c AS (SELECT g, min(key) AS class_id, count(*) AS members FROM g GROUP BY g),
l AS (SELECT a.class_id, sum(b.members) AS linked FROM c a JOIN c b ON a.class_id <> b.class_id
  AND CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.6 GROUP BY a.class_id)
SELECT key, c.class_id, CAST(members - 1 + coalesce(linked, 0) AS BIGINT) AS n_links FROM g JOIN c USING (g) LEFT JOIN l ON l.class_id = c.class_id""",
)
def name_linkage(spark, folder):
    parts = star.read(spark, folder, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("name"))
    suppliers = star.read(spark, folder, "supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")), "s_name")
    return count_links(parts.union(suppliers), "key", "name", 0.6)


@query(
    "search_response_page",
    over("profiles", body=f"""SELECT row_number() OVER (ORDER BY profiles.turnover DESC NULLS LAST, company_number) AS place, company_number, company_name,
CAST(turnover AS DOUBLE) AS turnover, CAST(latest_accounts_date AS VARCHAR) AS latest_accounts_date, CAST(active_officers_count AS VARCHAR) AS officers,
profit_margin IS NULL AS without_margin FROM profiles WHERE {WIDE_SQL}
ORDER BY profiles.turnover DESC NULLS LAST, company_number LIMIT 25 OFFSET 5"""),
)
def search_response_page(spark, folder):
    """The page as the caller gets it, text by text; missing values are written out as null."""
    answer = s.search_response(profiles(spark, folder), WIDE)
    rows = spark.createDataFrame([(answer["offset"] + n, text) for n, text in enumerate(answer["companies"], 1)], "place long, text string")

    def value(name: str):
        return F.get_json_object("text", f"$.{name}")

    return rows.select(
        "place", value("company_number").alias("company_number"), value("company_name").alias("company_name"),
        value("turnover").cast("double").alias("turnover"), value("latest_accounts_date").alias("latest_accounts_date"),
        value("active_officers_count").alias("officers"), F.col("text").contains('"profit_margin":null').alias("without_margin"),
    )


@query(
    "deep_page",
    over("profiles", body=f"""SELECT {PAGE} FROM profiles ORDER BY company_name DESC NULLS LAST, company_number LIMIT 40 OFFSET 1000"""),
)
def deep_page(spark, folder):
    """A page a thousand rows down, from a search laid out in ranges: it opens one or two of them."""
    place = work_path(spark, "listing")
    lay_out(profiles(spark, folder), Filters(company_status="all", descending=True), place, 40)
    return Listing.at(spark, place).page(1000, 40)


WEIGHTS = Weights({"nationality": 2.0, "postal_code": 4.0, "locality": 1.0, "address": 3.0}, {"nationality": -1.0, "postal_code": -2.0, "locality": -1.0, "address": -1.0})


@query(
    "officer_identity",
    """WITH RECURSIVE p AS (SELECT o_orderkey AS key, 'officer ' || CAST(o_custkey % 40 AS VARCHAR) AS name, strftime(o_orderdate, '%Y-%m') AS born,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS nationality, 'PC' || CAST(o_custkey % 7 AS VARCHAR) AS postal_code,
  o_orderstatus AS locality, CASE WHEN day(o_orderdate) < 28 THEN CAST(day(o_orderdate) AS VARCHAR) END AS address FROM orders),
l AS (SELECT a.key AS a, b.key AS b FROM p a JOIN p b ON a.name = b.name AND a.born = b.born AND a.key <> b.key WHERE
  CASE WHEN a.nationality = b.nationality THEN 2 ELSE -1 END + CASE WHEN a.postal_code = b.postal_code THEN 4 ELSE -2 END
  + CASE WHEN a.locality = b.locality THEN 1 ELSE -1 END + CASE WHEN a.address = b.address THEN 3 ELSE -1 END >= 4),
r AS (SELECT key AS a, key AS b FROM p UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS key, min(b) AS group_id FROM r GROUP BY a""",
)
def officer_identity(spark, folder):
    """Groups of officer records with fixed weights, by name, birth and what else they agree in."""
    day = F.dayofmonth("o_orderdate")
    people = star.read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"), F.concat(F.lit("OFFICER, "), (F.col("o_custkey") % 40).cast("string")).alias("officer_name"),
        F.trunc("o_orderdate", "month").alias("date_of_birth"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("nationality"),
        F.concat(F.lit("PC"), (F.col("o_custkey") % 7).cast("string")).alias("postal_code"), F.col("o_orderstatus").alias("locality"),
        F.when(day < 28, day.cast("string")).alias("address"),
    )
    return groups(people, "key", officer_block(), list(WEIGHTS.agree), WEIGHTS, 4.0)
