"""Row fingerprints for change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _as_text(name: str, kind: T.DataType) -> str:
    """Canonical text of a field: NULL is empty, arrays are quoted lists, money keeps at least one decimal."""
    c = f"`{name}`"
    if isinstance(kind, T.ArrayType):
        quoted = f"""concat("['", array_join({c}, "', '"), "']")"""
        return f"CASE WHEN size({c}) > 0 THEN {quoted} WHEN size({c}) = 0 THEN '[]' ELSE '' END"
    if isinstance(kind, T.DecimalType) and kind.scale == 2:
        return f"coalesce(regexp_replace(CAST({c} AS string), '0$', ''), '')"
    return f"coalesce(CAST({c} AS string), '')"


def row_hash(df: DataFrame, fields: list[str]) -> Column:
    """MD5 of the fields' canonical texts joined with ``|``; fields the frame lacks count as NULL."""
    kinds = {f.name: f.dataType for f in df.schema}
    texts = [_as_text(f, kinds[f]) if f in kinds else "''" for f in fields]
    return F.expr(f"md5(concat_ws('|', {', '.join(texts)}))")
