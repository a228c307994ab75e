"""Connected components of a link table, by alternating large and small stars.

Every round replaces links by links to smaller nodes; the number of rounds grows with the logarithm of the longest
path. Nothing is gathered: a round is two grouped minima and two joins on Spark's side. The minima are written out
before they are joined, so that adaptive execution can split the links of a node that has very many. Links are few
compared to documents: the number of tasks and files follows their number, else small rounds would spend their time on
empty tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlake.session import discard, settle

ROWS_PER_FILE = 100_000


def settle_rows(df: DataFrame, purpose: str, rows: int) -> DataFrame:
    """Write a result of about ``rows`` rows to as many files as that calls for."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.coalesce(max(1, min(most, rows // ROWS_PER_FILE))), purpose)


def _star(links: DataFrame, small: bool, rows: int) -> tuple[DataFrame, DataFrame]:
    """The links of a star round, and the minima they are computed from."""
    both = links.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if not small:
        both = both.union(links.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = settle_rows(both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low")), "components", rows)
    pairs = both.join(least, "n")
    if small:  # neighbours below the node, and the node itself, hang on to the least of them
        out = pairs.select(F.col("m").alias("u"), F.col("low").alias("v")).union(
            least.select(F.col("n").alias("u"), F.col("low").alias("v"))
        )
    else:
        out = pairs.where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
    return out, least


def _is_stars(links: DataFrame) -> bool:
    """Does every node hang on to one root, and no root on to another node?"""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(
        links.select("v", F.lit(0), F.lit(1))
    )
    return ends.groupBy("n").agg(F.sum("a").alias("a"), F.max("b").alias("b")).where("a > 1 or a + b > 1").isEmpty()


def components(links: DataFrame, rows: int) -> DataFrame:
    """``node, component`` for every node of the links ``u, v``; the component is its smallest node.

    ``rows`` is the number of links, roughly; it only decides into how many files intermediate results are written.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = settle_rows(links, "components", rows)
    while not _is_stars(links):
        large, one = _star(links, small=False, rows=rows)
        small, two = _star(large, small=True, rows=rows)
        old, links = links, settle_rows(small.where("u <> v").distinct(), "components", rows)
        discard(old, one, two)
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
