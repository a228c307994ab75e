"""Lenient, day-first date parsing. Text that fits no pattern becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts with the shape of the text they fit. The shape picks the one layout to try, since a
# failed attempt is far dearer than a match.
REGISTER_LAYOUTS = {
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
}
FILING_LAYOUTS = {
    **REGISTER_LAYOUTS,
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "d-M-yy": r"^\d{1,2}-\d{1,2}-\d{2}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{4,} \d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "MMMM d yyyy": r"^[A-Za-z]{4,} \d{1,2} \d{4}$",
    "MMM d yyyy": r"^[A-Za-z]{3} \d{1,2} \d{4}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "d.M.yy": r"^\d{1,2}\.\d{1,2}\.\d{2}$",
    "d/M/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "yyyyMMdd": r"^\d{8}$",
}


def parse_any(c: Column, layouts: dict[str, str]) -> Column:
    date = F.lit(None).cast("date")
    for layout, shape in reversed(layouts.items()):
        date = F.when(c.rlike(shape), F.try_to_date(c, layout)).otherwise(date)
    return date


def register_date(c: Column) -> Column:
    return parse_any(F.trim(c), REGISTER_LAYOUTS)


def filing_date(c: Column) -> Column:
    """Dates as people write them in filings: ordinals, commas, repeated blanks and a time of day are ignored.

    ``Sept`` is short for September.
    """
    plain = F.regexp_replace(F.trim(c), r"(?i)(?<=\d)(st|nd|rd|th)\b", "")
    plain = F.regexp_replace(plain, r"(?i)\bsept\b\.?", "Sep")
    plain = F.regexp_replace(plain, r"^(\d{4}-\d{1,2}-\d{1,2})[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$", "$1")
    return parse_any(F.regexp_replace(plain, r"[,\s]+", " "), FILING_LAYOUTS)


def whole_number(c: Column) -> Column:
    """Integer from text such as ``31`` or ``31.0``; the fraction is cut off."""
    return c.try_cast("double").try_cast("int")


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """Date from parts; a missing day counts as the first, a missing year or month gives NULL."""
    text = F.format_string(
        "%04d-%02d-%02d", whole_number(year), whole_number(month), F.coalesce(whole_number(day), F.lit(1))
    )
    return F.when(whole_number(year).isNotNull() & whole_number(month).isNotNull(), parse_any(text, REGISTER_LAYOUTS))


def reference_day(day: Column, month: Column) -> Column:
    """``MM-dd`` from separate day and month texts; NULL when either is missing or not a number."""

    def two(c: Column) -> Column:
        digits = whole_number(c).cast("string")
        return F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)

    return F.concat(two(month), F.lit("-"), two(day))
