"""Counts of a keyed table that follow its change sets instead of being taken again.

A summary counts rows by some expressions. Every change set of the table adds one to the group of each row it writes and
takes one from the group of each row it replaces; that difference is stored under the change set's name, and the counts
are the sums of all differences. Least and greatest values follow from the groups: the expressions include them, and a
group whose count has come down to zero is gone, so nothing has to be looked up again when an extreme value disappears.

A refresh reads the rows of new change sets, before and after, and nothing else of the table. It counts the whole table
where that is not enough: at first, after a change set was folded away unseen, or replaced after others had followed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.sources.tables import FOLDER, KeyedTable, folders, remove

COUNT = "n_rows"


def _written_at(spark: SparkSession, folder: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()


class Summary:
    """Rows of ``table`` by ``groups`` (name: SQL expression over tracked columns), of those that fulfil ``where``."""

    def __init__(self, table: KeyedTable, path: str, groups: dict[str, str], where: str = "true"):
        self.table, self.path, self.groups, self.where = table, path.rstrip("/"), groups, where

    def _counted(self, rows: DataFrame, sign: int) -> DataFrame:
        named = rows.where(self.where).select(*[F.expr(e).alias(n) for n, e in self.groups.items()])
        return named.groupBy(*self.groups).agg((F.count("*") * sign).alias(COUNT))

    def _difference(self, after: str, before: str) -> DataFrame:
        spark = self.table.spark
        new = spark.read.schema(self.table.schema).parquet(after)
        old = spark.read.parquet(before)
        both = self._counted(new, 1).unionByName(self._counted(old, -1))
        return both.groupBy(*self.groups).agg(F.sum(COUNT).alias(COUNT)).where(F.col(COUNT) != 0)

    def _stored(self) -> tuple[int, dict[tuple[int, str], str]]:
        """The version of the whole count (-1 for none), and the folders of the differences that follow."""
        found = [(FOLDER.fullmatch(n), n) for n, done in folders(self.table.spark, self.path).items() if done]
        own = [(m[1], int(m[2]), m[3], n) for m, n in found if m]
        base = max((v for kind, v, _, _ in own if kind == "full"), default=-1)
        return base, {(v, label): f"{self.path}/{n}" for kind, v, label, n in own if kind == "changes" and v > base}

    def _recount(self, version: int) -> None:
        target = f"{self.path}/full-{version:09d}"
        self._counted(self.table.read(before=version + 1), 1).write.mode("overwrite").parquet(target)
        for name in folders(self.table.spark, self.path):
            m = FOLDER.fullmatch(name)
            if m and f"{self.path}/{name}" != target:
                remove(self.table.spark, f"{self.path}/{name}")

    def refresh(self) -> str:
        """Bring the counts up to date; says what was read: ``nothing``, ``changes`` or ``table``."""
        folded, sets = self.table.change_sets()
        versions = {v for v, _, _, _ in sets}
        newest = max([folded, *versions])
        base, known = self._stored()
        seen = max([base, *[v for v, _ in known]])
        if base < 0 or not versions >= set(range(seen + 1, newest + 1)):
            self._recount(newest)
            return "table"
        spark = self.table.spark
        whole = f"{self.path}/full-{base:09d}"
        news = [
            s for s in sets
            if s[0] > seen or (s[0] > base or s[0] > folded) and _written_at(spark, s[2]) > _written_at(spark, known.get(s[:2], whole))
        ]
        if not news:
            return "nothing"
        # A set replaced after others had followed it: what those replaced is no longer what they found.
        replaced = [v for v, _, _, _ in news if v <= base or v <= seen and v != newest]
        if replaced or any(before is None for _, _, _, before in news):
            self._recount(newest)
            return "table"
        for v, label, after, before in news:
            self._difference(after, before).write.mode("overwrite").parquet(f"{self.path}/changes-{v:09d}-{label}")
        return "changes"

    def compact(self, after: int = 20) -> bool:
        """Refresh, and add up the differences whose change sets the table has folded away, once there are ``after`` of them."""
        self.refresh()
        folded, _ = self.table.change_sets()
        base, known = self._stored()
        old = {k: f for k, f in known.items() if k[0] <= folded}
        if len(old) < max(after, 1):
            return False
        whole = f"{self.path}/full-{base:09d}"
        self._sum([whole, *old.values()]).write.mode("overwrite").parquet(f"{self.path}/full-{max(v for v, _ in old):09d}")
        for folder in [*old.values(), whole]:
            remove(self.table.spark, folder)
        return True

    def _sum(self, paths: list[str]) -> DataFrame:
        parts = self.table.spark.read.parquet(*paths)
        return parts.groupBy(*self.groups).agg(F.sum(COUNT).alias(COUNT)).where(F.col(COUNT) != 0)

    def read(self) -> DataFrame:
        """The groups that have rows, with ``n_rows``."""
        base, known = self._stored()
        if base < 0:
            raise ValueError("refresh the summary before reading it")
        return self._sum([f"{self.path}/full-{base:09d}", *known.values()])
