"""Search for names that look like a term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlake.functions.text import trigram_similarity


def with_similarity(df: DataFrame, term: str, name: str = "company_name") -> DataFrame:
    return df.withColumn("similarity", trigram_similarity(F.col(name), F.lit(term)))


def fuzzy_name_match(df: DataFrame, term: str, k: int, name: str = "company_name", key: str = "company_number"):
    """The ``k`` rows whose name is most similar to the term, best first; ties by key.

    A scan with a per-partition top-k: no shuffle, whatever the table's size.
    """
    scored = with_similarity(df, term, name)
    return scored.orderBy(F.desc("similarity"), F.asc(key)).limit(k)
