"""Text clean-up, name normalisation and trigram similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stand for "no value" in the bulk files.
MISSING_TOKENS = ["", "nan", "NaN"]


def blank_to_null(c: Column) -> Column:
    """NULL for the missing-value tokens, otherwise the value unchanged."""
    return F.when(~c.isin(MISSING_TOKENS), c)


def filled(c: Column) -> Column:
    """True when a text value is neither NULL nor the empty string."""
    return F.coalesce(c != "", F.lit(False))


def status(c: Column) -> Column:
    return F.trim(F.lower(c))


def normalize_name(c: Column) -> Column:
    """Name key for matching: lower case, word characters only, single blanks.

    ``(?U)`` makes ``\\w`` and ``\\s`` Unicode aware, so accented letters survive.
    """
    letters = F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", "")
    return F.when(filled(c), F.trim(F.regexp_replace(letters, r"(?U)\s+", " ")))


def contains_ci(c: Column, term: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in the term act as wildcards, a backslash stands for itself."""
    escaped = term.replace("\\", "\\\\")
    return c.ilike(f"%{escaped}%")


def join_filled(values: list[Column], separator: str) -> Column:
    """Trimmed, non-blank values joined in order; NULL when none is left."""
    kept = F.array_compact(F.array(*[F.nullif(F.trim(v), F.lit("")) for v in values]))
    return F.nullif(F.array_join(kept, separator), F.lit(""))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 when both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common.cast("double"), F.size(a) + F.size(b) - common), F.lit(0.0))


def trigram_similarity(c: Column, term: Column) -> Column:
    return set_similarity(trigrams(c), trigrams(term))


def display_text(c: Column, default: str = "N/A") -> Column:
    return F.when(filled(c) & (c != "NaN"), c).otherwise(default)
