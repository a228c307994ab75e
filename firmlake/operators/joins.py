"""Joins with a parent table.

One company may own a large share of the children. These joins keep the children on the left, beside plain rows on the
right, so that adaptive execution can split the partition of such a company; nothing is counted or salted beforehand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _known(parents: DataFrame, key: str) -> DataFrame:
    return parents.select(key).where(F.col(key).isNotNull())


def guard_orphans(rows: DataFrame, parents: DataFrame, key: str = "company_number") -> DataFrame:
    """Rows whose parent exists."""
    return rows.join(_known(parents, key), key, "left_semi")


def orphans(rows: DataFrame, parents: DataFrame, key: str = "company_number") -> DataFrame:
    """Rows whose parent is missing: what ``guard_orphans`` leaves out."""
    return rows.join(_known(parents, key), key, "left_anti")


def flag_existing(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """Boolean column: does the row's key occur in the other frame?"""
    seen = _known(other, key).distinct().withColumn(name, F.lit(True))
    return df.join(seen, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
