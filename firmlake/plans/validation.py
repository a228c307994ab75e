"""Checks of a staged batch before promotion."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlake.functions.company import no_codes
from firmlake.functions.text import filled

# Issue type -> (severity, text after the count), in report order.
COMPANY_ISSUES = {
    "missing_company_number": ("error", "companies missing company number"),
    "invalid_company_number": ("error", "companies have invalid number format (not 8 chars)"),
    "missing_company_name": ("error", "companies missing name"),
    "missing_status": ("warning", "companies missing status"),
    "missing_locality": ("warning", "companies missing locality"),
    "missing_sic": ("info", "companies missing SIC codes"),
}
OFFICER_ISSUES = {
    "missing_officer_name": ("warning", "officers missing name"),
    "missing_officer_role": ("warning", "officers missing role"),
    "missing_appointment_date": ("info", "officers missing appointment date"),
}
LEAST_SCORE = 0.7
REVIEW_PREFIX = "Missing critical data: "


def batch_companies(companies: DataFrame, batch_id: str | None) -> DataFrame:
    return companies if batch_id is None else companies.where(F.col("batch_id") == batch_id)


def batch_children(children: DataFrame, companies: DataFrame, batch_id: str | None) -> DataFrame:
    """Rows of the batch's companies: the company's batch counts, not the row's own."""
    if batch_id is None:
        return children
    numbers = batch_companies(companies, batch_id).select("company_number").where("company_number is not null")
    return children.join(numbers, "company_number", "left_semi")


def company_checks(companies: DataFrame) -> DataFrame:
    """Total and count per issue type, in one pass."""
    failed = {
        "missing_company_number": ~filled(F.col("company_number")),
        "invalid_company_number": F.length("company_number") != 8,
        "missing_company_name": ~filled(F.col("company_name")),
        "missing_status": ~filled(F.col("company_status")),
        "missing_locality": ~filled(F.col("locality")),
        "missing_sic": no_codes(F.col("sic_codes")),
    }
    return companies.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in failed.items()])


def officer_checks(officers: DataFrame) -> DataFrame:
    failed = {
        "missing_officer_name": ~filled(F.col("officer_name")),
        "missing_officer_role": ~filled(F.col("officer_role")),
        "missing_appointment_date": F.col("appointed_on").isNull(),
    }
    return officers.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in failed.items()])


def _issues(checks: DataFrame, catalogue: dict[str, tuple[str, str]]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(severity).alias("severity"),
                F.lit(kind).alias("type"),
                F.col(kind).alias("count"),
                F.concat(F.col(kind).cast("string"), F.lit(f" {text}")).alias("message"),
            )
            for kind, (severity, text) in catalogue.items()
        ]
    )
    return checks.select(F.explode(rows).alias("i")).select("i.*").where("count > 0")


def issues(companies: DataFrame, officers: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Issue types that occur in the batch: ``(severity, type, count, message)``."""
    return _issues(company_checks(batch_companies(companies, batch_id)), COMPANY_ISSUES).unionByName(
        _issues(officer_checks(batch_children(officers, companies, batch_id)), OFFICER_ISSUES)
    )


def score_of(found: DataFrame) -> DataFrame:
    """1 minus the share of error types among all issue types found; 1 when there are none."""
    errors = F.count_if(F.col("severity") == "error")
    return found.agg(F.coalesce(1 - F.try_divide(errors.cast("double"), F.count("*")), F.lit(1.0)).alias("quality_score"))


def batch_score(companies: DataFrame, officers: DataFrame, batch_id: str | None = None) -> DataFrame:
    return score_of(issues(companies, officers, batch_id))


def validate_batch(companies: DataFrame, officers: DataFrame, batch_id: str | None = None) -> dict:
    """Report of a batch. Two single-row aggregates are all that reaches the driver."""
    company = company_checks(batch_companies(companies, batch_id)).first().asDict()
    officer = officer_checks(batch_children(officers, companies, batch_id)).first().asDict()
    found = [
        {"severity": severity, "type": kind, "count": counts[kind], "message": f"{counts[kind]} {text}"}
        for counts, catalogue in ((company, COMPANY_ISSUES), (officer, OFFICER_ISSUES))
        for kind, (severity, text) in catalogue.items()
        if counts[kind] > 0
    ]
    errors = sum(i["severity"] == "error" for i in found)
    return {
        "batch_id": batch_id,
        "companies_checked": company["total"],
        "officers_checked": officer["total"],
        "issues": found,
        "quality_score": 1.0 - errors / len(found) if found else 1.0,
    }


def mark_for_review(
    companies: DataFrame, batch_id: str | None = None, criteria: dict[str, Column] | None = None
) -> DataFrame:
    """The companies with ``needs_review`` and a note set on rows that meet any criterion; other rows stay as they are.

    The default criteria are a missing number and a missing name; the note lists those that hold. ``marked`` tells the
    rows this call has set, so their count is ``count_if(marked)``.
    """
    criteria = criteria or {
        "company_number": F.col("company_number").isNull(),
        "company_name": F.col("company_name").isNull(),
    }
    hit = F.lit(False)
    note = F.lit(REVIEW_PREFIX)
    for name, condition in criteria.items():
        holds = F.coalesce(condition, F.lit(False))
        hit = hit | holds
        note = F.concat(note, F.when(holds, f"{name} ").otherwise(""))
    if batch_id is not None:
        hit = hit & F.col("batch_id").eqNullSafe(batch_id)
    return companies.withColumns(
        {
            "marked": hit,
            "review_notes": F.when(hit, note).otherwise(F.col("review_notes")),
            "needs_review": hit | F.col("needs_review"),
        }
    )


def mark_table(table, batch_id: str | None = None, criteria: dict[str, Column] | None = None) -> int:
    """Store the marks of ``mark_for_review`` in a keyed staging table; returns how many rows were marked.

    Only rows that are marked now are written; each call has a change set of its own.
    """
    rows = table.read()
    marked = mark_for_review(rows, batch_id, criteria).where("marked").select(*rows.columns)
    label = f"review-{uuid.uuid4().hex[:12]}"
    table.write_changes(marked, label)
    return table.read_changes(label).count()
