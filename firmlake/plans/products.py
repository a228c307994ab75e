"""The three bulk products and how a load of each becomes rows for its staging table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake import schemas
from firmlake.functions.hashing import row_hash
from firmlake.operators.joins import guard_orphans
from firmlake.operators.upsert import changes, dedupe_load
from firmlake.sources.accounts import list_filings, read_financials, read_listed
from firmlake.sources.company_csv import read_companies
from firmlake.sources.manifest import file_order
from firmlake.sources.psc_json import read_officers


@dataclass(frozen=True)
class Product:
    """What is specific to a product; make another with ``dataclasses.replace`` to change a reader or the hash fields.

    Where an archive has many entries, ``listed`` gives them unread and ``read_listed`` reads some of them.
    """

    name: str
    read: Callable[[DataFrame], DataFrame]
    schema: T.StructType
    keys: list[str]
    hash_fields: list[str]
    order: list[str]
    needs_company: bool
    kept: tuple[str, ...] = ("ingested_at", "needs_review", "review_notes")
    transform: Callable[[DataFrame], DataFrame] | None = None
    listed: Callable[[DataFrame], DataFrame] | None = None
    read_listed: Callable[[DataFrame], DataFrame] | None = None


COMPANY = Product(
    "company", read_companies, schemas.STAGING_COMPANIES, schemas.COMPANY_KEY, schemas.COMPANY_HASH,
    ["archive", "row_no"], False, ("ingested_at", "needs_review", "review_notes", "raw_data"),
)
PSC = Product(
    "psc", read_officers, schemas.STAGING_OFFICERS, schemas.OFFICER_KEY, schemas.OFFICER_HASH,
    ["archive", "row_no"], True,
)
ACCOUNTS = Product(
    "accounts", read_financials, schemas.STAGING_FINANCIALS, schemas.FINANCIAL_KEY, schemas.FINANCIAL_HASH,
    ["archive", "pos", "inner_pos"], True, listed=list_filings, read_listed=read_listed,
)
PRODUCTS = {p.name: p for p in (COMPANY, PSC, ACCOUNTS)}


def parse(product: Product, paths: DataFrame) -> DataFrame:
    """Rows of the product's archives, with a ``reject`` reason on those that could not be used.

    A custom ``transform`` runs before the hash is taken again.
    """
    return shaped(product, product.read(paths))


def shaped(product: Product, rows: DataFrame) -> DataFrame:
    if product.transform:
        rows = product.transform(rows)
        rows = rows.withColumn("data_hash", row_hash(rows, product.hash_fields))
    return rows


def accepted(product: Product, parsed: DataFrame, companies: DataFrame | None) -> DataFrame:
    """Usable rows, one per key, whose company exists.

    Of several rows for a key the one from the latest file counts, by date and part in the file name, then by place.
    Duplicates go first: that takes the copies of a hot key away before the join with the companies.
    """
    required = [k for k in ("company_number", "period_end") if k in product.keys]
    rows = parsed.where("reject is null")
    for k in required:
        rows = rows.where(F.col(k).isNotNull())
    later = file_order(F.col("archive"))
    rows = dedupe_load(rows.withColumns(later), product.keys, [*later, *product.order]).drop(*later)
    return guard_orphans(rows, companies) if product.needs_company else rows


def rejects(parsed: DataFrame) -> DataFrame:
    places = [c for c in ("archive", "entry", "row_no", "pos") if c in parsed.columns]
    return parsed.where("reject is not null").select(
        "archive", "entry", F.col(places[-1]).cast("long").alias("place"), F.col("reject").alias("reason")
    )


def lineage(batch_id: str, now: Column) -> dict[str, Column]:
    """Stamps of a load. A changed row waits for promotion again."""
    return {
        "batch_id": F.lit(batch_id),
        "last_updated": now,
        "ingested_at": now,
        "needs_review": F.lit(False),
        "merged_at": F.lit(None).cast("timestamp_ntz"),
    }


def load_changes(
    product: Product, stored: DataFrame, rows: DataFrame, batch_id: str, now: Column, null_safe_keys: bool = True
) -> DataFrame:
    """Accepted rows as the staging table would store them, with their action."""
    payload = [c for c in stored.columns if c in rows.columns]
    return changes(
        stored, rows.select(*payload), product.keys, stamps=lineage(batch_id, now), kept=list(product.kept),
        null_safe_keys=null_safe_keys,
    )
