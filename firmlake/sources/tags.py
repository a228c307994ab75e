"""Which accounts column a tag fills."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.schemas import COUNT_TAGS, MONEY_TAGS, TAG_DICTIONARY

DICTIONARY = "column string, tag string, priority int, numeric boolean"


def spellings(tag: str) -> list[str]:
    """A tag in lower case, and without ``-`` and ``_`` where that differs."""
    return list(dict.fromkeys([tag.lower(), tag.lower().replace("-", "").replace("_", "")]))


def is_numeric(column: str) -> bool:
    return column in MONEY_TAGS or column in COUNT_TAGS


def candidates(dictionary: dict[str, list[str]] | None = None) -> dict[str, list[tuple[str, int, bool]]]:
    """Spelling -> (column, priority, numeric) of the columns that accept it; a lower priority is better."""
    found: dict[str, list[tuple[str, int, bool]]] = {}
    for column, tags in (dictionary or TAG_DICTIONARY).items():
        for priority, tag in enumerate(tags):
            for spelling in spellings(tag):
                found.setdefault(spelling, []).append((column, priority, is_numeric(column)))
    return found


def tag_dictionary(spark: SparkSession, dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per column and candidate tag, to be broadcast: the driver has the dictionary, a constant or a file of settings.

    Without the hint Spark does not know how small it is, and deals all facts by their tags, of which there are few.
    """
    rows = [(c, tag, priority, numeric) for tag, found in candidates(dictionary).items() for c, priority, numeric in found]
    return F.broadcast(spark.createDataFrame(rows, DICTIONARY))


def load_tag_dictionary(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """A dictionary kept as a JSON object ``column -> [tags]``: a configuration file that the driver reads."""
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    found = json.loads(text)
    if not isinstance(found, dict) or not all(isinstance(tags, list) for tags in found.values()):
        raise ValueError(f"{path} is no JSON object of lists")
    return {str(column): [str(tag) for tag in tags] for column, tags in found.items()}


def read_tag_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The same dictionary as rows, as ``tag_dictionary`` gives them."""
    return tag_dictionary(spark, load_tag_dictionary(spark, path))


def read_taxonomies(spark: SparkSession, *paths: str) -> DataFrame:
    """Element lists of the taxonomies: ``(taxonomy, tag, uses, numeric_uses)``."""
    schema = "position int, uses double, tag string, numeric_uses double, source string"
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(list(paths))
        .where(F.col("tag").isNotNull())
        .select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1).alias("taxonomy"), "tag", "uses", "numeric_uses")
    )
