"""Columns about companies: industry codes, quality score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmlake.functions.text import filled

# Industry name -> first two digits of the industry codes it covers.
INDUSTRY_PREFIXES = {
    "tech": ["62", "63"],
    "finance": ["64", "65", "66"],
    "retail": ["47"],
    "manufacturing": [str(n) for n in range(10, 34)],
    "professional": ["69", "70", "71", "72", "73", "74"],
}

# Points per filled field, out of QUALITY_TOTAL.
QUALITY_POINTS = {
    "company_number": "3.0",
    "company_name": "3.0",
    "company_status": "1.0",
    "locality": "1.0",
    "sic_codes": "1.0",
    "postal_code": "0.5",
    "region": "0.5",
}
QUALITY_TOTAL = 10


def sic_codes(texts: list[Column]) -> Column:
    """Codes in front of ``" - "`` in each text; missing ones are left out, so the array may be empty."""

    def code(c: Column) -> Column:
        head = F.trim(F.get(F.split(c, " - "), F.lit(0)))
        return F.when(filled(head) & (head != "nan"), head)

    return F.array_compact(F.array(*[code(c) for c in texts]))


def primary_sic(codes: Column) -> Column:
    return F.try_element_at(codes, F.lit(1))


def no_codes(codes: Column) -> Column:
    """True for a NULL and for an empty code list: both mean that no code is known."""
    return codes.isNull() | (F.size(codes) == 0)


def industry_category(code: str) -> Column:
    """Industry name of the code in a column, by its first two digits; NULL outside the known industries."""
    branches = " ".join(
        f"WHEN '{p}' THEN '{name}'" for name, prefixes in INDUSTRY_PREFIXES.items() for p in prefixes
    )
    return F.expr(f"CASE substring({code}, 1, 2) {branches} END")


def quality_score() -> Column:
    """Share of filled fields weighted by QUALITY_POINTS, between 0.00 and 1.00."""
    points = [
        f"CASE WHEN {'size(sic_codes) > 0' if field == 'sic_codes' else f'{field} != ' + repr('')} THEN {value} ELSE 0.0 END"
        for field, value in QUALITY_POINTS.items()
    ]
    return F.expr(f"CAST(least(({' + '.join(points)}) / {QUALITY_TOTAL}, 1.0) AS decimal(3,2))")
