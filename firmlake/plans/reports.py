"""Reports over the production and staging tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlake.functions.company import no_codes
from firmlake.functions.text import filled
from firmlake.operators.joins import flag_existing
from firmlake.operators.latest import latest_financials
from firmlake.plans.search import active_officers
from firmlake.sources.logs import current_batches, last_batch


def active_companies_with_financials(
    companies: DataFrame, financials: DataFrame, officers: DataFrame, tie_break: list[str] | None = None
) -> DataFrame:
    """Active companies, their latest figures and their officers in office."""
    latest = latest_financials(financials, tie_break).select(
        "company_number", F.col("period_end").alias("latest_accounts_date"), "turnover", "profit_after_tax",
        "total_assets", "net_worth", "profit_margin", "current_ratio",
    )
    return (
        companies.where("company_status = 'active'")
        .select(
            "company_number", "company_name", "company_status", "company_type", "locality", "region",
            "primary_sic_code", "industry_category", "incorporation_date",
        )
        .join(latest, "company_number", "left")
        .join(active_officers(officers), "company_number", "left")
        .withColumn("active_officers_count", F.coalesce("active_officers", F.lit(0).cast("long")))
        .drop("active_officers")
    )


def officers_with_contacts(officers: DataFrame, companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """Officers in office with company name and contacts, best confidence first.

    Officers per company and contacts per officer may both be very uneven. Both joins are inner ones over plain rows, so
    adaptive execution can split either side; officers without contacts, one row each, come from an anti-join with the
    distinct ids. The officer's id closes the sort key: the range sort can then cut through any number of equal confidences.
    """
    names = companies.select("company_number", "company_name")
    active = officers.where("is_active").select(
        "officer_id", "officer_name", "officer_role", "company_number", "appointed_on", "is_active", "nationality"
    )
    details = contacts.select(
        "officer_id", "email", "email_verified", "phone", "phone_verified", "linkedin_url", "confidence_score",
        F.col("source").alias("contact_source"),
    )
    named = active.join(names, "company_number")
    reached = details.join(named, "officer_id")
    alone = named.join(contacts.select("officer_id").distinct(), "officer_id", "left_anti")
    return reached.unionByName(alone, allowMissingColumns=True).orderBy(
        F.desc_nulls_last("confidence_score"), F.asc("officer_id"), F.asc_nulls_last("contact_source")
    )


def company_overview(
    companies: DataFrame, officers: DataFrame, financials: DataFrame, contacts: DataFrame
) -> DataFrame:
    """Companies with counts of officers in office, periods and verified contacts.

    Each child table is counted on its own before it is joined, so rows never multiply and no distinct count is needed.
    """
    verified = (
        contacts.where("verified_at is not null").groupBy("officer_id").agg(F.count("*").alias("_contacts"))
    )
    people = (
        officers.select("officer_id", "company_number", "is_active")
        .join(verified, "officer_id", "left")
        .groupBy("company_number")
        .agg(
            F.count_if("is_active").alias("active_officers"),
            F.sum(F.coalesce("_contacts", F.lit(0).cast("long"))).alias("verified_contacts_count"),
        )
    )
    periods = financials.groupBy("company_number").agg(
        F.count("*").alias("financial_periods_available"), F.max("period_end").alias("latest_accounts_date")
    )
    zero = F.lit(0).cast("long")
    return (
        companies.select(
            "company_number", "company_name", "company_status", "company_type", "locality", "region", "postal_code",
            "primary_sic_code", "industry_category", "incorporation_date", "accounts_next_due_date",
            "conf_stm_next_due_date", "data_quality_score",
        )
        .join(people, "company_number", "left")
        .join(periods, "company_number", "left")
        .withColumns(
            {
                c: F.coalesce(c, zero)
                for c in ("active_officers", "verified_contacts_count", "financial_periods_available")
            }
        )
    )


def review_queue(
    companies: DataFrame, officers: DataFrame, batch_id: str | None = None, limit: int | None = 100
) -> DataFrame:
    """Companies marked for review with their officer counts, newest first; of one batch when given.

    The order does not depend on the counts: the rows are chosen first, and only their officers are counted.
    """
    marked = companies.where("needs_review")
    if batch_id is not None:
        marked = marked.where(F.col("batch_id") == batch_id)
    order = [F.desc_nulls_last("ingested_at"), F.asc("company_number")]
    queue = marked.select("company_number", "company_name", "needs_review", "review_notes", "ingested_at", "last_updated")
    if limit is not None:
        queue = queue.orderBy(*order).limit(limit)
    own = officers.select("company_number").join(queue.select("company_number").distinct(), "company_number", "left_semi")
    counts = own.groupBy("company_number").agg(F.count("*").alias("officer_count"))
    return (
        queue.join(counts, "company_number", "left")
        .withColumn("officer_count", F.coalesce("officer_count", F.lit(0).cast("long")))
        .orderBy(*order)
    )


def data_quality(companies: DataFrame) -> DataFrame:
    """One row of counts over the staging companies."""
    return companies.agg(
        F.count("*").alias("total_companies"),
        F.count_if(~filled(F.col("company_name"))).alias("missing_names"),
        F.count_if(~filled(F.col("locality"))).alias("missing_locality"),
        F.count_if(no_codes(F.col("sic_codes"))).alias("missing_sic"),
        F.count_if("needs_review").alias("needs_review"),
        F.count_if(F.col("merged_at").isNull()).alias("pending_merge"),
        F.count_if("change_detected").alias("recently_changed"),
        F.max("last_updated").alias("latest_update"),
    )


def pending_merge(companies: DataFrame, financials: DataFrame) -> DataFrame:
    """Rows that wait for promotion, per table, with the oldest and newest of them."""

    def summary(df: DataFrame, name: str, newest: str) -> DataFrame:
        return df.where("merged_at is null").agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("pending_count"),
            F.min("ingested_at").alias("oldest_record"),
            F.max(newest).alias("newest_record"),
        )

    return summary(companies, "companies", "last_updated").unionByName(
        summary(financials, "financials", "ingested_at")
    )


def mergeable_batches(log: DataFrame, merges: DataFrame, limit: int = 20) -> DataFrame:
    """Completed batches, newest first, with whether they have been merged."""
    done = current_batches(log).where("status = 'completed'")
    newest = done.orderBy(F.desc_nulls_last("completed_at"), "batch_id").limit(limit)
    flagged = flag_existing(newest, merges, "batch_id", "_merged")
    return flagged.select(
        "batch_id", "search_name", "started_at", "completed_at", "companies_count",
        F.when(F.col("_merged"), "merged").otherwise("not_merged").alias("merge_status"),
    ).orderBy(F.desc_nulls_last("completed_at"), "batch_id")


def table_status(companies: DataFrame, officers: DataFrame, financials: DataFrame) -> DataFrame:
    """Row counts of the three tables, from Parquet file metadata where nothing else is asked."""
    tables = {"companies": companies, "officers": officers, "financials": financials}
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")) for name, df in tables.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def latest_batch(log: DataFrame) -> DataFrame:
    return last_batch(log).select(
        "batch_id", "search_name", "started_at", "completed_at", "companies_count", "status", "files_total",
        "files_completed",
    )


def overall_progress() -> Column:
    """Percent done of a batch: finished files plus the share of the current one, at most 100."""
    total = F.col("files_total").cast("double")
    done = F.col("files_completed") / total * 100
    current = F.when(filled(F.col("current_file")), F.col("current_file_progress") / 100.0 * (100.0 / total)).otherwise(0.0)
    return F.when(F.col("files_total") == 0, F.lit(0.0)).otherwise(F.least(done + F.coalesce(current, F.lit(0.0)), F.lit(100.0)))


def batch_progress(log: DataFrame) -> DataFrame:
    return current_batches(log).select("batch_id", "status", overall_progress().alias("progress"))


def processed_per_product(files: DataFrame) -> DataFrame:
    """Rows written per product over the files that were completed."""
    return files.where("status = 'completed'").groupBy("product").agg(F.sum("rows").alias("processed"))
