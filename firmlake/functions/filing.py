"""Facts that a filing's file name and tags carry."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where the company number and the period end sit in a file name.
NUMBER_BETWEEN_MARKS = r"(?:^|_)(\d{8})(?:_|\.)"
LETTERED_NUMBER = r"\b([A-Z]{2}\d{6})\b"
DATE_BEFORE_EXTENSION = r"_(\d{8})\."
_NUMBERS = re.compile(NUMBER_BETWEEN_MARKS, re.ASCII), re.compile(LETTERED_NUMBER, re.ASCII)
_DATE = re.compile(DATE_BEFORE_EXTENSION, re.ASCII)


def _group(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def company_number_from_name(name: Column) -> Column:
    """Third ``_`` part when it has eight characters, else an eight-digit or lettered number in the name."""
    third = F.get(F.split(name, "_"), F.lit(2))
    return F.coalesce(
        F.when(F.length(third) == 8, third), _group(name, NUMBER_BETWEEN_MARKS), _group(name, LETTERED_NUMBER)
    )


def period_end_from_name(name: Column) -> Column:
    """Eight digits before the extension as a date; impossible dates and year zero give NULL."""
    digits = _group(name, DATE_BEFORE_EXTENSION)
    return F.when(~digits.startswith("0000"), F.try_to_date(digits, "yyyyMMdd"))


def local_name(tag: Column) -> Column:
    """Tag without its ``{namespace}`` or ``prefix:``."""
    return F.regexp_replace(tag, r"^(?:[^}]*\}|[^:}]*:)", "")


def number(text: Column) -> Column:
    """Decimal from a plain number after commas and blanks are taken out; anything else is NULL."""
    return F.translate(text, ", \t\r\n", "").try_cast("decimal(38,6)")


def name_facts(name: str) -> tuple[str | None, dt.date | None]:
    """Company number and period end of one file name: the two column functions above, where an entry is read."""
    parts = name.split("_")
    third = parts[2] if len(parts) > 2 and len(parts[2]) == 8 else None
    found = None if third else _NUMBERS[0].search(name) or _NUMBERS[1].search(name)
    digits = _DATE.search(name)
    try:
        end = dt.date(int(digits[1][:4]), int(digits[1][4:6]), int(digits[1][6:])) if digits else None
    except ValueError:
        end = None
    return third or (found[1] if found else None), end
