"""Pages at any depth: the matches of a search in order, cut into ranges, with a directory of the rows in each range.

A search is laid out once: its matches are dealt to ranges of the wanted order, each range is sorted and written to a folder
of its own. The directory, a row per range, says at which place a range begins. A page opens the ranges that hold its rows,
one or two whatever its offset, and the directory knows the total.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.operators.fuzzy import with_similarity
from firmlake.plans.search import DEFAULT_LIMIT, PAGE_COLUMNS, Filters, search, search_order

RANGE, PLACE = "_range", "_place"


def lay_out(profiles: DataFrame, f: Filters, path: str, ranges: int = 200) -> None:
    """Write the matches of a search in its order; ``ranges`` bounds the directory, whatever the number of matches.

    The order ends with the company number, so equal values never pile up in one range. Paging fields of ``f`` play no part.
    """
    found = search(profiles, f)
    if f.order_by == "relevance" and f.search_term:
        found = with_similarity(found, f.search_term)
    # The place within a range comes from the sorted stream of its rows, before it is written: nothing is sorted twice.
    dealt = found.repartitionByRange(ranges, *search_order(f)).sortWithinPartitions(*search_order(f))
    placed = dealt.select(*PAGE_COLUMNS, F.monotonically_increasing_id().alias(PLACE))
    numbered = placed.select(*PAGE_COLUMNS, F.shiftright(PLACE, 33).cast("int").alias(RANGE), F.col(PLACE).bitwiseAND((1 << 33) - 1).alias(PLACE))
    numbered.write.mode("overwrite").partitionBy(RANGE).parquet(f"{path}/rows")
    spark = profiles.sparkSession
    if not found.isEmpty():
        rows = spark.read.parquet(f"{path}/rows")
        rows.groupBy(RANGE).agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{path}/directory")


@dataclass
class Listing:
    """A search that was laid out: the ranges in order, and the place at which each begins (the last entry is the total)."""

    spark: SparkSession
    path: str
    ranges: list[int]
    starts: list[int]

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Listing:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/directory")
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        rows = spark.read.parquet(f"{path}/directory").orderBy(RANGE).collect() if there else []  # as many as there are ranges
        starts = [0]
        for r in rows:
            starts.append(starts[-1] + r["rows"])
        return cls(spark, path, [r[RANGE] for r in rows], starts)

    @property
    def total(self) -> int:
        return self.starts[-1]

    def page(self, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the search, in order."""
        offset, limit = max(offset, 0), limit if limit > 0 else DEFAULT_LIMIT
        first = max(bisect_right(self.starts, offset) - 1, 0)
        last = max(bisect_right(self.starts, min(offset + limit, self.total) - 1) - 1, 0)
        if offset >= self.total:
            return self.spark.createDataFrame([], self.spark.read.parquet(f"{self.path}/rows").select(*PAGE_COLUMNS).schema if self.ranges else "company_number string")
        folders = [f"{self.path}/rows/{RANGE}={r}" for r in self.ranges[first : last + 1]]
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(*folders)
        begin = offset - self.starts[first]  # in the first of the ranges
        inside = (F.col(RANGE) != self.ranges[first]) | (F.col(PLACE) >= begin)
        return rows.where(inside).orderBy(RANGE, PLACE).limit(limit).select(*PAGE_COLUMNS)
