"""Run queries against their SQL: ``python -m checks.compare <folder> [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time


def tables(folder: str):
    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db


def _key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def difference(spark_rows: list, spark_columns: list[str], sql_rows: list, sql_columns: list[str]) -> str | None:
    """None when both results hold the same rows, else what differs first."""
    if sorted(spark_columns) != sorted(sql_columns):
        return f"columns {sorted(spark_columns)} != {sorted(sql_columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows != {len(sql_rows)} rows"
    names = sorted(spark_columns)
    pick_a = [spark_columns.index(n) for n in names]
    pick_b = [sql_columns.index(n) for n in names]
    a = sorted((tuple(r[i] for i in pick_a) for r in spark_rows), key=_key)
    b = sorted((tuple(r[i] for i in pick_b) for r in sql_rows), key=_key)
    for x, y in zip(a, b):
        if not all(_same(p, q) for p, q in zip(x, y)):
            return f"{dict(zip(names, x))} != {dict(zip(names, y))}"
    return None


def compare(spark, db, folder: str, name: str) -> tuple[str | None, int, float]:
    """(difference, rows, seconds) of one query; without SQL only the row count counts."""
    from checks.registry import QUERIES, SQL

    start = time.time()
    df = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if name not in SQL:
        return (None if rows else "no rows"), len(rows), seconds
    cursor = db.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    return difference(rows, df.columns, cursor.fetchall(), columns), len(rows), seconds


def main() -> int:
    import checks.all  # noqa: F401
    from checks.registry import QUERIES, SQL
    from firmlake.session import build_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "firmlake-compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, failed = tables(folder), 0
    for name in names:
        try:
            wrong, rows, seconds = compare(spark, db, folder, name)
        except Exception as error:
            wrong, rows, seconds = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0.0
        failed += wrong is not None
        kind = "" if name in SQL else " (no SQL)"
        print(f"{'FAIL' if wrong else 'ok  '} {name}{kind}: {rows} rows, {seconds:.2f} s {wrong or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
