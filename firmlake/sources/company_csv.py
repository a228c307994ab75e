"""Company records from the bulk CSV archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake.functions.company import sic_codes
from firmlake.functions.dates import reference_day, register_date
from firmlake.functions.hashing import row_hash
from firmlake.functions.text import blank_to_null, join_filled, status
from firmlake.schemas import COMPANY_DATA, COMPANY_HASH, conform
from firmlake.sources.archives import read_csv

# CSV column -> table column.
DIRECT_COLUMNS = {
    "CompanyNumber": "company_number",
    "CompanyName": "company_name",
    "CompanyStatus": "company_status",
    "CompanyCategory": "company_type",
    "RegAddress.PostTown": "locality",
    "RegAddress.PostCode": "postal_code",
    "RegAddress.AddressLine1": "address_line_1",
    "RegAddress.AddressLine2": "address_line_2",
    "RegAddress.County": "region",
    "RegAddress.Country": "country",
    "IncorporationDate": "incorporation_date",
    "Accounts.LastMadeUpDate": "accounts_last_made_up_date",
    "Accounts.NextDueDate": "accounts_next_due_date",
    "Accounts.AccountCategory": "account_category",
    "Returns.NextDueDate": "returns_next_due_date",
    "Returns.LastMadeUpDate": "returns_last_made_up_date",
    "Mortgages.NumMortCharges": "num_mort_charges",
    "Mortgages.NumMortOutstanding": "num_mort_outstanding",
    "Mortgages.NumMortPartSatisfied": "num_mort_part_satisfied",
    "ConfStmtNextDueDate": "conf_stm_next_due_date",
    "ConfStmtLastMadeUpDate": "conf_stm_last_made_up_date",
}
DATE_COLUMNS = [
    "incorporation_date", "accounts_last_made_up_date", "accounts_next_due_date", "returns_next_due_date",
    "returns_last_made_up_date", "conf_stm_next_due_date", "conf_stm_last_made_up_date",
]
SIC_TEXTS = {f"SICCode.SicText_{i}": f"sic_text_{i}" for i in range(1, 5)}
REFERENCE_DAY = {"Accounts.AccountRefDay": "ref_day", "Accounts.AccountRefMonth": "ref_month"}
OLD_NAMES = {f"PreviousName_{i}.CompanyName": f"old_name_{i}" for i in range(1, 11)}
CSV_COLUMNS = {**DIRECT_COLUMNS, **SIC_TEXTS, **REFERENCE_DAY, **OLD_NAMES}


def rename_columns(df: DataFrame) -> DataFrame:
    """Mapped columns that exist, under their table names; header names may carry blanks."""
    found = {c.strip(): c for c in df.columns}
    return df.select(*[F.col(f"`{found[s]}`").alias(t) for s, t in CSV_COLUMNS.items() if s in found])


def transform(raw: DataFrame) -> DataFrame:
    """Typed company rows from renamed text columns; other columns, such as positions, are carried along."""
    have = set(raw.columns)

    def texts(targets) -> list:
        return [F.col(t) for t in targets if t in have]

    typed = raw.withColumns(
        {
            "sic_codes": sic_codes(texts(SIC_TEXTS.values())),
            "previous_names": join_filled(texts(OLD_NAMES.values()), "|"),
            "accounts_ref_date": reference_day(F.col("ref_day"), F.col("ref_month"))
            if set(REFERENCE_DAY.values()) <= have
            else F.lit(None).cast("string"),
            **{c: register_date(F.col(c)) for c in DATE_COLUMNS if c in have},
            **{c: blank_to_null(F.col(c)) for c in DIRECT_COLUMNS.values() if c in have and c not in DATE_COLUMNS},
        }
    )
    if "company_status" in have:
        typed = typed.withColumn("company_status", blank_to_null(status(F.col("company_status"))))
    extra = [raw.schema[c] for c in ("archive", "entry", "row_no", "reject") if c in have]
    rows = conform(typed.withColumn("raw_data", F.lit("{}")), T.StructType([*COMPANY_DATA.fields, *extra]))
    return rows.withColumn("data_hash", row_hash(rows, COMPANY_HASH))


def read_companies(paths: DataFrame) -> DataFrame:
    """Company rows of the archives in column ``path``; rows with a ``reject`` reason stand for unreadable records."""
    return transform(read_csv(paths, CSV_COLUMNS))
