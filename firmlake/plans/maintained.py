"""Reports that follow the tables' change sets: officers in office, data quality, pending rows and row counts.

Each equals the report that counts the tables (``plans/reports``, ``plans/search``); what it reads grows with the changes
since it was last brought up to date, not with the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlake.operators.maintain import COUNT, Summary
from firmlake.plans.promotion import Tables

# What the summaries need of a row: tracked by the tables, so that change sets keep it as it was before.
TRACKED = {
    "companies": ["company_name", "locality", "sic_codes", "needs_review", "merged_at", "change_detected", "ingested_at", "last_updated"],
    "financials": ["merged_at", "ingested_at"],
    "officers": ["company_number", "resigned_on"],
}


def _sum(condition: str | None = None) -> Column:
    counted = F.col(COUNT) if condition is None else F.when(F.expr(condition), F.col(COUNT))
    return F.coalesce(F.sum(counted), F.lit(0)).cast("long")


@dataclass
class Reports:
    companies: Summary
    financials: Summary
    officers: Summary
    in_office: Summary

    @classmethod
    def of(cls, tables: Tables, folder: str) -> Reports:
        """Summaries below a folder. From now on the staging tables keep what their change sets replace."""
        for name, columns in TRACKED.items():
            getattr(tables, name).tracked = columns
        stamps = {"merged_at": "merged_at", "ingested_at": "ingested_at", "last_updated": "last_updated"}
        flags = {
            "no_name": "not coalesce(company_name <> '', false)", "no_locality": "not coalesce(locality <> '', false)",
            "no_codes": "coalesce(size(sic_codes), 0) <= 0", "needs_review": "coalesce(needs_review, false)",
            "changed": "coalesce(change_detected, false)", "pending": "merged_at is null",
        }
        return cls(
            Summary(tables.companies, f"{folder}/companies", {**flags, **{k: v for k, v in stamps.items() if k != "merged_at"}}),
            Summary(tables.financials, f"{folder}/financials", {"pending": "merged_at is null", "ingested_at": "ingested_at"}),
            Summary(tables.officers, f"{folder}/officers", {"one": "1"}),
            Summary(tables.officers, f"{folder}/in-office", {"company_number": "company_number"}, "resigned_on is null"),
        )

    def summaries(self) -> list[Summary]:
        return [self.companies, self.financials, self.officers, self.in_office]

    def refresh(self) -> list[str]:
        """Bring all of them up to date; what each had to read."""
        return [s.refresh() for s in self.summaries()]

    def active_officers(self) -> DataFrame:
        """A1: ``company_number, active_officers`` of the companies that have any."""
        return self.in_office.read().select("company_number", F.col(COUNT).cast("long").alias("active_officers"))

    def data_quality(self) -> DataFrame:
        """A5: one row of counts over the staging companies."""
        return self.companies.read().agg(
            _sum().alias("total_companies"), _sum("no_name").alias("missing_names"), _sum("no_locality").alias("missing_locality"),
            _sum("no_codes").alias("missing_sic"), _sum("needs_review").alias("needs_review"), _sum("pending").alias("pending_merge"),
            _sum("changed").alias("recently_changed"), F.max("last_updated").alias("latest_update"),
        )

    def pending_merge(self) -> DataFrame:
        """A6: rows that wait for promotion, per table, with the oldest and newest of them."""

        def waiting(summary: Summary, name: str, newest: str) -> DataFrame:
            return summary.read().where("pending").agg(
                F.lit(name).alias("table_name"), _sum().alias("pending_count"), F.min("ingested_at").alias("oldest_record"),
                F.max(newest).alias("newest_record"),
            )

        return waiting(self.companies, "companies", "last_updated").unionByName(waiting(self.financials, "financials", "ingested_at"))

    def table_status(self) -> DataFrame:
        """A10: row counts of the staging tables."""
        tables = {"companies": self.companies, "officers": self.officers, "financials": self.financials}
        counts = [s.read().agg(F.lit(name).alias("table_name"), _sum().alias("rows")) for name, s in tables.items()]
        return counts[0].unionByName(counts[1]).unionByName(counts[2])
