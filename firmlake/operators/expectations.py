"""Table constraints as row checks: clean rows go on, violations are kept with the names of what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlake.schemas import TEXT_LIMITS


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``violations``: names of the rules that are false. A rule that is NULL holds, as in SQL checks."""
    failed = [F.when(~rule, name) for name, rule in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*failed)))


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that meet every rule, rows that do not with their ``violations``)."""
    checked = check(df, rules)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows per failed rule in one pass; the rule names are few, so partial counts do the work."""
    return check(df, rules).select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key combinations that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def text_limits(df: DataFrame) -> dict[str, Column]:
    """A length rule for every limited text column of the frame."""
    return {f"{c}_too_long": F.length(c) <= TEXT_LIMITS[c] for c in df.columns if c in TEXT_LIMITS}


def required(*columns: str) -> dict[str, Column]:
    return {f"{c}_missing": F.col(c).isNotNull() for c in columns}


def company_rules(df: DataFrame) -> dict[str, Column]:
    rules = required("company_number", "company_name", "company_status")
    if "data_quality_score" in df.columns:
        rules["score_out_of_range"] = F.col("data_quality_score").between(0, 1)
    return {**rules, **text_limits(df)}


def officer_rules(df: DataFrame) -> dict[str, Column]:
    return {**required("company_number"), **text_limits(df)}


def financial_rules(df: DataFrame) -> dict[str, Column]:
    rules = required("company_number", "period_start", "period_end", "source")
    rules["period_not_positive"] = F.col("period_end") > F.col("period_start")
    if "data_quality_score" in df.columns:
        rules["score_out_of_range"] = F.col("data_quality_score").between(0, 1)
    return {**rules, **text_limits(df)}


def contact_rules(df: DataFrame) -> dict[str, Column]:
    rules = required("source", "confidence_score")
    rules["confidence_out_of_range"] = F.col("confidence_score").between(0.5, 1.0)
    return {**rules, **text_limits(df)}


def manifest_rules() -> dict[str, Column]:
    """A file entry needs a known product and an address."""
    return {
        **required("product", "url"),
        "unknown_product": F.col("product").isin("company", "psc", "accounts"),
    }
