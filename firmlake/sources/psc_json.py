"""Persons with significant control from JSON-lines archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake.functions.dates import partial_date
from firmlake.functions.hashing import row_hash
from firmlake.functions.text import filled
from firmlake.schemas import OFFICER_DATA, OFFICER_HASH, conform
from firmlake.sources.archives import read_lines

# Numbers are read as text, so that one odd date part costs that part and not the record.
RECORD = (
    "company_number string, data struct<name string, "
    "name_elements struct<title string, forename string, middle_name string, surname string>, "
    "address struct<address_line_1 string, address_line_2 string, locality string, postal_code string, "
    "country string>, date_of_birth struct<year string, month string, day string>, kind string, nationality string, "
    "notified_on string, ceased_on string, natures_of_control array<string>>, _unreadable string"
)
# Fixed value: role of a record that names none.
DEFAULT_ROLE = "person-with-significant-control"
NAME_PARTS = ["title", "forename", "middle_name", "surname"]
ADDRESS_PARTS = ["address_line_1", "address_line_2", "locality", "postal_code", "country"]


def _full_name(data: Column) -> Column:
    parts = [F.nullif(data["name_elements"][p], F.lit("")) for p in NAME_PARTS]
    return F.coalesce(F.nullif(data["name"], F.lit("")), F.nullif(F.concat_ws(" ", *parts), F.lit("")))


def _natures(data: Column) -> Column:
    kept = F.array_compact(data["natures_of_control"])
    return F.when(F.size(kept) > 0, F.array_join(kept, "|"))


def _reason() -> Column:
    return (
        F.when(F.col("reject").isNotNull(), F.col("reject"))
        .when(F.col("r").isNull() | F.col("r._unreadable").isNotNull(), F.concat(F.lit("unreadable: "), F.col("line")))
        .when(~filled(F.col("r.company_number")), F.concat(F.lit("no company number: "), F.col("line")))
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Officer rows of a frame with ``line`` and, if known, archive, entry, line_no and reject.

    Rows with a ``reject`` reason stand for lines that gave no record. Blank lines are skipped.
    """
    for c, kind in (("archive", "string"), ("entry", "string"), ("line_no", "long"), ("reject", "string")):
        if c not in lines.columns:
            lines = lines.withColumn(c, F.lit(None).cast(kind))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unreadable"}
    parsed = lines.where("reject is not null or trim(line) != ''").withColumn("r", F.from_json("line", RECORD, options))
    data, birth = F.col("r.data"), F.col("r.data.date_of_birth")
    rows = parsed.select(
        F.col("r.company_number").alias("company_number"),
        _full_name(data).alias("officer_name"),
        F.coalesce(data["kind"], F.lit(DEFAULT_ROLE)).alias("officer_role"),
        F.try_to_date(data["notified_on"], "yyyy-MM-dd").alias("appointed_on"),
        F.try_to_date(data["ceased_on"], "yyyy-MM-dd").alias("resigned_on"),
        partial_date(birth["year"], birth["month"], birth["day"]).alias("date_of_birth"),
        data["nationality"].alias("nationality"),
        _natures(data).alias("nature_of_control"),
        *[data["address"][p].alias(p) for p in ADDRESS_PARTS],
        F.col("line").alias("raw_data"),
        "archive", "entry", F.col("line_no").alias("row_no"), _reason().alias("reject"),
    )
    extra = [rows.schema[c] for c in ("archive", "entry", "row_no", "reject")]
    rows = conform(rows, T.StructType([*OFFICER_DATA.fields, *extra]))
    return rows.withColumn("data_hash", row_hash(rows, OFFICER_HASH))


def read_officers(paths: DataFrame) -> DataFrame:
    """Officer rows and rejects of the archives in column ``path``."""
    return parse_lines(read_lines(paths))
