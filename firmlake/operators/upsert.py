"""Change-detecting upsert over snapshots: insert new keys, rewrite changed rows, leave the rest alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlake.operators.latest import latest_per_key

INSERT, UPDATE, SKIP, KEEP = "insert", "update", "skip", "keep"


def _any_null(keys: list[str]) -> Column:
    return F.expr(" OR ".join(f"`{k}` IS NULL" for k in keys))


def _match(keys: list[str]) -> Column:
    return F.expr(" AND ".join(f"n.`{k}` <=> o.`{k}`" for k in keys))


def dedupe_load(source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key of a load: the last in the given order wins."""
    return latest_per_key(source, keys, order)


def _joined(target: DataFrame, source: DataFrame, keys: list[str], hash_col: str | None, how: str) -> DataFrame:
    """Source rows ``n`` beside stored rows ``o`` with the action that follows."""
    o = target.withColumn("_stored", F.lit(True)).alias("o")
    n = source.withColumn("_loaded", F.lit(True)).alias("n")
    same = f"n.`{hash_col}` <=> o.`{hash_col}`" if hash_col else "false"
    action = f"""CASE WHEN _loaded IS NULL THEN '{KEEP}' WHEN _stored IS NULL THEN '{INSERT}'
        WHEN {same} THEN '{SKIP}' ELSE '{UPDATE}' END"""
    return n.join(o, _match(keys), how).withColumn("action", F.expr(action))


def _value(c: str, source: DataFrame, keys: list[str], kept: list[str], changed_flag: str | None) -> str:
    """What a target column holds afterwards, as SQL over ``n``, ``o`` and ``action``."""
    new = f"n.`{c}`" if c in source.columns else "NULL"
    if c in keys:
        return f"coalesce(n.`{c}`, o.`{c}`)"
    if c == changed_flag:
        return f"CASE action WHEN '{INSERT}' THEN false WHEN '{UPDATE}' THEN true ELSE o.`{c}` END"
    if c in source.columns and c not in kept:
        return f"CASE WHEN action IN ('{INSERT}', '{UPDATE}') THEN {new} ELSE o.`{c}` END"
    return f"CASE WHEN action = '{INSERT}' THEN {new} ELSE o.`{c}` END"


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    *,
    hash_col: str | None = "data_hash",
    stamps: dict[str, Column] | None = None,
    kept: list[str] | None = None,
    changed_flag: str | None = "change_detected",
) -> DataFrame:
    """The whole next snapshot with an ``action`` per row: insert, update, skip or keep.

    ``source`` has one row per key. With ``hash_col`` a stored row is rewritten only when its hash differs; without it,
    every matching row is. ``stamps`` gives columns the source lacks, such as the batch id. Columns in ``kept`` are set
    on insert only. NULL key parts are equal to each other. Nothing is ever deleted.
    """
    source = source.withColumns(stamps or {})
    values = [
        f"CAST({_value(f.name, source, keys, kept or [], changed_flag)} AS {f.dataType.simpleString()}) AS `{f.name}`"
        for f in target.schema
    ]
    return _joined(target, source, keys, hash_col, "full").selectExpr(*values, "action")


def changes(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    *,
    hash_col: str | None = "data_hash",
    stamps: dict[str, Column] | None = None,
    kept: list[str] | None = None,
    changed_flag: str | None = "change_detected",
    null_safe_keys: bool = True,
) -> DataFrame:
    """The source's rows as they would be stored, with ``action`` insert, update or skip.

    Only the key, the hash and the columns that survive an update are read from the target, and the target is first
    cut down to the source's keys: for a load below the broadcast threshold it is scanned but not shuffled. The source
    is read twice for that, so give a table or a settled frame when it is costly. ``null_safe_keys=False`` inserts rows
    with a NULL key part every time, as a plain unique constraint would.
    """
    stamps, kept = stamps or {}, kept or []
    payload = {c for c in source.columns if c not in keys and c not in kept and c not in (hash_col, changed_flag)}
    # The stored payload is not read: a skipped row shows the source's, and is not meant to be written.
    slim = target.select(*[c for c in target.columns if c not in payload])
    if not null_safe_keys:
        slim = slim.where(~_any_null(keys))
    slim = slim.alias("o").join(source.select(*keys).alias("n"), _match(keys), "left_semi")
    source = source.withColumns(stamps)
    values = []
    for f in target.schema:
        value = f"n.`{f.name}`" if f.name in payload else _value(f.name, source, keys, kept, changed_flag)
        values.append(f"CAST({value} AS {f.dataType.simpleString()}) AS `{f.name}`")
    return _joined(slim, source, keys, hash_col, "left").selectExpr(*values, "action")


def action_counts(rows: DataFrame) -> DataFrame:
    """Counts of a load: inserted, updated, skipped, and their sum of written rows as affected."""

    def count(*actions: str) -> Column:
        return F.count_if(F.col("action").isin(*actions))

    return rows.agg(
        count(INSERT).alias("inserted"),
        count(UPDATE).alias("updated"),
        count(SKIP).alias("skipped"),
        count(INSERT, UPDATE).alias("affected"),
    )
