"""One row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order; NULL keys count as equal.

    Spark turns ``row_number() == 1`` into a group limit that already runs before the shuffle, so a key that holds a
    third of all rows sends at most one row per input partition.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row with the greatest ``by`` values of every key; NULLs lose."""
    return first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in by])


def latest_financials(financials: DataFrame, tie_break: list[str] | None = None) -> DataFrame:
    """Newest known period of every company."""
    known = financials.where(F.col("period_end").isNotNull())
    return latest_per_key(known, ["company_number"], ["period_end", *(tie_break or [])])
