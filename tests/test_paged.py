import os

import pytest
from pyspark.sql import functions as F

from firmlake.plans.paged import Listing, lay_out
from firmlake.plans.search import PAGE_COLUMNS, Filters, search_page


@pytest.fixture(scope="module")
def profiles(spark):
    numbers = spark.range(3000).select(F.format_string("%08d", "id").alias("company_number"), "id")
    values = {
        "company_name": F.when(F.col("id") % 7 != 0, F.concat(F.lit("N"), (F.col("id") * 7919 % 50).cast("string"))),
        "turnover": (F.col("id") * 31 % 400).cast("decimal(15,2)"), "company_status": F.lit("active"),
        "sic_codes": F.array(F.lit("62012")), "locality": F.lit("LEEDS"), "region": F.lit(None).cast("string"),
    }
    rows = numbers.withColumns(values)
    missing = [c for c in [*PAGE_COLUMNS, "total_liabilities", "active_officers"] if c not in rows.columns]
    return rows.withColumns({c: F.lit(None).cast("date" if c.endswith("date") else "double" if c not in ("postal_code", "primary_sic_code", "industry_category") else "string") for c in missing})


@pytest.mark.parametrize("f", [Filters(order_by="turnover", descending=True), Filters(), Filters(search_term="N1", order_by="relevance")])
def test_pages_equal_those_of_the_search(spark, folder, profiles, f):
    from dataclasses import replace

    lay_out(profiles, f, os.path.join(folder, "listing"), 16)
    listing = Listing.at(spark, os.path.join(folder, "listing"))
    assert listing.total == search_page(profiles, replace(f, limit=10_000)).count()
    for offset, limit in ((0, 10), (1, 25), (listing.total // 2, 300), (listing.total - 5, 50), (listing.total, 10), (0, 10_000)):
        got = [r["company_number"] for r in listing.page(offset, limit).collect()]
        assert got == [r["company_number"] for r in search_page(profiles, replace(f, offset=offset, limit=limit)).collect()]


def test_a_deep_page_opens_one_range(spark, folder, profiles):
    place = os.path.join(folder, "listing")
    lay_out(profiles, Filters(), place, 16)
    listing = Listing.at(spark, place)
    for offset in (5, 1500, 2990):
        opened = {os.path.dirname(p) for p in listing.page(offset, 5).inputFiles()}
        assert 1 <= len(opened) <= 2


def test_no_match(spark, folder, profiles):
    place = os.path.join(folder, "listing")
    lay_out(profiles, Filters(search_term="nobody"), place, 4)
    listing = Listing.at(spark, place)
    assert listing.total == 0 and listing.page(0, 10).collect() == []
