"""Promotion of a validated batch from staging to production."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake import schemas
from firmlake.functions.company import industry_category, primary_sic, quality_score
from firmlake.functions.finance import current_ratio, debt_to_equity, profit_margin
from firmlake.operators.expectations import company_rules, financial_rules, officer_rules, split
from firmlake.operators.joins import guard_orphans, orphans
from firmlake.operators.latest import latest_per_key
from firmlake.operators.upsert import changes
from firmlake.plans.validation import LEAST_SCORE, validate_batch
from firmlake.session import discard, settle
from firmlake.sources.logs import log_merge
from firmlake.sources.tables import KeyedTable

MERGED_BY = "promotion"
# Columns that the parity mode leaves as they are when a stored row is updated.
ADDRESS = ["address_line_1", "address_line_2", "locality", "postal_code", "country"]
PARITY_KEPT = {
    "companies": ["address_line_1", "address_line_2"],
    "officers": ADDRESS,
    "financials": ["period_start"],
}


def _cleared(companies: DataFrame, batch_id: str) -> DataFrame:
    return companies.where((F.col("batch_id") == batch_id) & ~F.col("needs_review"))


def eligible_companies(companies: DataFrame, batch_id: str) -> DataFrame:
    return _cleared(companies, batch_id).where("company_number is not null and company_name is not null")


def _children(rows: DataFrame, companies: DataFrame, batch_id: str) -> DataFrame:
    numbers = _cleared(companies, batch_id).select("company_number").where("company_number is not null")
    return rows.join(numbers, "company_number", "left_semi")


def eligible_officers(officers: DataFrame, companies: DataFrame, batch_id: str) -> DataFrame:
    return _children(officers.where("officer_name is not null"), companies, batch_id)


def eligible_financials(financials: DataFrame, companies: DataFrame, batch_id: str) -> DataFrame:
    return _children(financials, companies, batch_id)


def company_rows(staged: DataFrame) -> DataFrame:
    """Staged companies in production shape: first industry code, industry and quality score added."""
    rows = staged.withColumn("primary_sic_code", primary_sic(F.col("sic_codes")))
    return rows.withColumns(
        {"industry_category": industry_category("primary_sic_code"), "data_quality_score": quality_score()}
    )


def officer_rows(staged: DataFrame) -> DataFrame:
    role = F.coalesce(F.nullif("officer_role", F.lit("")), F.lit("unknown"))
    return staged.withColumns({"officer_role": role, "is_active": F.col("resigned_on").isNull()})


def financial_rows(staged: DataFrame) -> DataFrame:
    """Staged financials in production shape, with the three ratios.

    Ratios: liabilities to net worth, current assets to current liabilities, profit after tax to turnover.
    """
    renamed = staged.withColumns(
        {
            "profit_after_tax": F.col("profit_loss"),
            "net_worth": F.col("net_assets_liabilities"),
            "cost_of_sales": F.col("cost_sales"),
            "gross_profit": F.col("gross_profit_loss"),
            "operating_profit": F.col("operating_profit_loss"),
            "profit_before_tax": F.col("profit_loss_on_ordinary_activities_before_tax"),
            "source": F.coalesce(F.nullif("source", F.lit("")), F.lit("api")),
        }
    )
    return renamed.withColumns(
        {
            "debt_to_equity_ratio": debt_to_equity(F.col("total_liabilities"), F.col("net_worth")),
            "current_ratio": current_ratio(F.col("current_assets"), F.col("current_liabilities")),
            "profit_margin": profit_margin(F.col("profit_after_tax"), F.col("turnover")),
        }
    )


def _promote(rows: DataFrame, production: DataFrame, keys: list[str], batch_id: str, now: Column, kept: list[str]):
    payload = [c for c in production.columns if c in rows.columns and c not in ("last_updated", "first_seen")]
    return changes(
        production, rows.select(*payload), keys, hash_col=None,
        stamps={"source_batch_id": F.lit(batch_id), "first_seen": now, "last_updated": now},
        kept=["first_seen", *kept], changed_flag=None,
    )


def _companies(eligible: DataFrame, production: DataFrame, batch_id: str, now: Column, parity: bool):
    rows = company_rows(eligible)
    valid, broken = split(rows, company_rules(rows))
    return _promote(valid, production, schemas.COMPANY_KEY, batch_id, now, PARITY_KEPT["companies"] if parity else []), broken


def _officers(eligible: DataFrame, production: DataFrame, batch_id: str, now: Column, parity: bool):
    rows = latest_per_key(officer_rows(eligible), schemas.OFFICER_KEY, ["last_updated", "data_hash"])
    valid, broken = split(rows, officer_rules(rows))
    return _promote(valid, production, schemas.OFFICER_KEY, batch_id, now, PARITY_KEPT["officers"] if parity else []), broken


def _financials(eligible: DataFrame, production: DataFrame, batch_id: str, now: Column, parity: bool):
    rows = financial_rows(eligible)
    valid, broken = split(rows, financial_rules(rows.select("company_number", "source")))
    return _promote(valid, production, schemas.FINANCIAL_KEY, batch_id, now, PARITY_KEPT["financials"] if parity else []), broken


def promote_companies(staged: DataFrame, production: DataFrame, batch_id: str, now: Column, parity: bool = False):
    """(production rows that the batch's companies give, rows that break a table rule); staged keys are unique."""
    return _companies(eligible_companies(staged, batch_id), production, batch_id, now, parity)


def promote_officers(
    officers: DataFrame, companies: DataFrame, production: DataFrame, batch_id: str, now: Column, parity: bool = False
):
    """As for companies. A role that becomes ``unknown`` may meet another row's key; the later staged row counts."""
    return _officers(eligible_officers(officers, companies, batch_id), production, batch_id, now, parity)


def promote_financials(
    financials: DataFrame, companies: DataFrame, production: DataFrame, batch_id: str, now: Column, parity: bool = False
):
    """As for companies; a period must have a start before its end."""
    return _financials(eligible_financials(financials, companies, batch_id), production, batch_id, now, parity)


def mark_merged(staged: DataFrame, now: Column) -> DataFrame:
    return staged.withColumn("merged_at", now.cast("timestamp_ntz"))


def _same(left: str, right: str, columns: list[str]) -> list[Column]:
    """Equality of both sides in every column; NULLs are equal to each other."""
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]


def unchanged(table: KeyedTable, chosen: DataFrame) -> DataFrame:
    """The table's rows, as they are now, that are still what was chosen: same key, batch and time of change.

    A row that a load has changed since then is left out: it was not the one promoted, and waits for its own turn. The
    table must have no other writer while the result is written back, so a change set in hand is an error.
    """
    if busy := table.in_hand():
        raise RuntimeError(f"{table.path} is being written ({', '.join(busy)}): what was promoted is stored but not marked; promote the batch again")
    columns = [*table.keys, *[c for c in ("batch_id", "last_updated") if c not in table.keys]]
    return table.read().alias("r").join(chosen.select(*columns).alias("c"), _same("r", "c", columns), "left_semi")


@dataclass
class Tables:
    """The staging and production tables below one folder."""

    companies: KeyedTable
    officers: KeyedTable
    financials: KeyedTable
    production_companies: KeyedTable
    production_officers: KeyedTable
    production_financials: KeyedTable
    ingestion_log: str
    merge_log: str
    file_log: str
    rejects: str

    @classmethod
    def below(cls, spark: SparkSession, folder: str) -> Tables:
        s = schemas
        plan = {
            "companies": (s.STAGING_COMPANIES, s.COMPANY_KEY),
            "officers": (s.STAGING_OFFICERS, s.OFFICER_KEY),
            "financials": (s.STAGING_FINANCIALS, s.FINANCIAL_KEY),
            "production_companies": (s.PRODUCTION_COMPANIES, s.COMPANY_KEY),
            "production_officers": (s.PRODUCTION_OFFICERS, s.OFFICER_KEY),
            "production_financials": (s.PRODUCTION_FINANCIALS, s.FINANCIAL_KEY),
        }
        tables = {n: KeyedTable(spark, f"{folder}/{n}", schema, keys) for n, (schema, keys) in plan.items()}
        return cls(**tables, ingestion_log=f"{folder}/ingestion_log", merge_log=f"{folder}/merge_log",
                   file_log=f"{folder}/file_log", rejects=f"{folder}/rejects")


def merge_batch(spark: SparkSession, t: Tables, batch_id: str, now: Column | None = None, dry_run: bool = False,
                parity: bool = False, compact_after: int = 20) -> dict:
    """Validate, then promote companies, officers and financials in that order, mark them merged and log the merge.

    A batch that scores below LEAST_SCORE is refused. A dry run counts the same selection and writes nothing. Every run
    promotes the staging rows as they are now, under change sets of its own: a batch promoted again, be it after a
    failure or after a review, updates what is there and adds what was cleared since. Only rows that reached production
    are marked; those that broke a rule or whose company is not in production go to the rejects and wait. A load that
    changes staged rows meanwhile keeps its rows: they are not marked, and nothing is written over them.
    """
    now = now if now is not None else F.current_timestamp()
    now = now.cast("timestamp_ntz")
    companies, officers, financials = t.companies.read(), t.officers.read(), t.financials.read()
    report = validate_batch(companies, officers, batch_id)
    if report["quality_score"] < LEAST_SCORE:
        return {"status": "failed", "reason": "quality_score_too_low", "report": report}
    if dry_run:
        stats = {
            "companies_merged": eligible_companies(companies, batch_id).count(),
            "officers_merged": eligible_officers(officers, companies, batch_id).count(),
            "financials_merged": eligible_financials(financials, companies, batch_id).count(),
        }
        return {"status": "success", "dry_run": True, "stats": stats, "report": report}

    # One instant for all three tables, also when a lost task is run again.
    at = spark.range(1).select(now.alias("now")).first()["now"]
    stamp = F.lit(at).cast("timestamp_ntz")
    label = f"{batch_id}-{uuid.uuid4().hex[:12]}"
    # Each selection is made once; what follows reads the settled rows.
    staged = {
        "companies": settle(eligible_companies(companies, batch_id), "eligible-companies"),
        "officers": settle(eligible_officers(officers, companies, batch_id), "eligible-officers"),
        "financials": settle(eligible_financials(financials, companies, batch_id), "eligible-financials"),
    }

    def store(name: str, keys: list[str], shape, promote, guarded: bool) -> dict[str, int]:
        """Write the production rows, the rejects and the marks of one table; counts of what was written."""
        table: KeyedTable = getattr(t, f"production_{name}")
        rows, broken = promote(staged[name], table.read(), batch_id, stamp, parity)
        bad = broken.select("company_number", F.array_join("violations", ",").alias("reason"))
        if guarded:
            rows = settle(rows, f"promoted-{name}")
            known = t.production_companies.read()
            lost = orphans(rows, known).select("company_number", F.lit("company_not_in_production").alias("reason"))
            bad = bad.unionByName(lost)
        table.write_changes(guard_orphans(rows, known) if guarded else rows, f"promotion-{label}")
        bad.write.mode("overwrite").parquet(f"{t.rejects}/promotion-{batch_id}-{name}")
        written = table.read_changes(f"promotion-{label}")
        new = F.col("first_seen") == F.col("last_updated")
        counts = written.agg(F.count_if(new).alias("inserted"), F.count_if(~new).alias("updated")).first().asDict()
        # The production key may differ from the staged one, so the staged key goes along.
        staging: KeyedTable = getattr(t, name)
        known_by = F.struct(*dict.fromkeys([*staging.keys, "batch_id", "last_updated"]))
        shaped = shape(staged[name].withColumn("_staged", known_by)).select(*keys, "_staged")
        chosen = shaped.alias("r").join(written.select(*keys).alias("w"), _same("r", "w", keys), "left_semi").select("_staged.*")
        staging.write_changes(mark_merged(unchanged(staging, chosen), stamp), f"merged-{label}")
        if guarded:
            discard(rows)
        table.compact(compact_after)
        return counts

    try:
        done = store("companies", schemas.COMPANY_KEY, lambda df: df, _companies, False)
        people_done = store("officers", schemas.OFFICER_KEY, officer_rows, _officers, True)
        money_done = store("financials", schemas.FINANCIAL_KEY, lambda df: df, _financials, True)
    finally:
        discard(*staged.values())

    stats = {
        "companies_merged": done["inserted"],
        "companies_updated": done["updated"],
        "officers_merged": sum(people_done.values()),
        "financials_merged": sum(money_done.values()),
        "contacts_merged": 0,
    }
    log_merge(
        spark,
        t.merge_log,
        {
            "batch_id": batch_id,
            "merged_at": at,
            **{k: v for k, v in stats.items() if k != "companies_updated"},
            "merged_by": MERGED_BY,
            "notes": f"Merged {stats['companies_merged']} companies, {stats['officers_merged']} officers",
        },
    )
    return {"status": "success", "dry_run": False, "stats": stats, "report": report}
