"""All pairs of names that look alike: an exact set-similarity self-join over trigrams.

Names with equal trigrams form a class, so copies are never paired with each other; classes are joined. Two sets whose
Jaccard similarity is at least t share a gram among the first ``n - ceil(t * n) + 1`` of each set of n grams, if both are
in one common order. Rare grams come first in that order, so these prefixes seldom meet by chance. Candidates meet on a
gram of both prefixes and on the size of the smaller set. What two sets must share follows from both sizes, so the prefix of
the larger one is cut for each size of the smaller, that of the smaller for partners of its own size, the least demanding.
Survivors are verified on all their grams. A pair comes out once: at the first gram that both sets share.

Rows that meet on one gram and size are cut into cells of at most about BLOCK rows of either side, which are dealt over all
tasks: no gram's pairs are one task's work.

The order needs counts of frequent grams only. Those with at least one ORDERED-th of all occurrences are at most ORDERED:
that table is broadcast. All others count as equally rare and stand in the order of their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlake.functions.text import trigrams
from firmlake.session import settle
from firmlake.sources.archives import spread

ORDERED = 4096
BLOCK = 1024  # rows of either side in a cell


def name_classes(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``key, class_id`` of every row, and the classes: ``class_id, members, grams``, both settled.

    The class is the least key among names with equal trigrams. Null names and names without letters or digits have no
    class (null). A row with a null key belongs to a class but never names it, unless its class has no other rows; such
    classes, having no id, take no part.
    """
    dealt = spread(df.select(F.col(key).alias("key"), F.coalesce(F.col(name), F.lit("")).alias("name")), "key", "name")  # few rows are much work
    rows = settle(dealt.select("key", F.array_sort(trigrams(F.col("name"))).alias("grams")), "name-grams")
    some = rows.where(F.size("grams") > 0)
    classes = some.groupBy("grams").agg(F.min("key").alias("class_id"), F.count("*").alias("members"))
    classes = settle(classes.where("class_id is not null"), "name-classes")
    # Rows stay on the left: adaptive execution splits the partition of a name that a third of them bear.
    members = some.join(classes, "grams", "left").select("key", "class_id")
    return settle(members.unionByName(rows.where(F.size("grams") == 0).select("key", F.lit(None).cast(rows.schema["key"].dataType).alias("class_id"))), "name-members"), classes


def ordered(classes: DataFrame) -> DataFrame:
    """``class_id, size, grams``: the grams of each class, the rare ones first."""
    each = classes.select("class_id", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    total = classes.agg(F.sum(F.size("grams"))).first()[0] or 0
    # So many occurrences or more: at most ORDERED grams can have them.
    frequent = each.groupBy("gram").agg(F.count("*").alias("times")).where(F.col("times") >= max(1, -(-total // ORDERED)))
    ranked = each.join(F.broadcast(frequent), "gram", "left").select("class_id", "size", F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram").alias("g"))
    return ranked.groupBy("class_id", "size").agg(F.sort_array(F.collect_list("g")).alias("g")).select("class_id", "size", F.col("g.gram").alias("grams"))


def _code(gram):
    """The three characters of a gram as one number: numbers are compared faster."""
    return sum((F.ascii(F.substring(gram, k, 1)).cast("long") * (1 << 21 * (3 - k)) for k in (2, 3)), F.ascii(gram).cast("long") * (1 << 42))


def cells(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by ``keys`` with ``row`` and ``column`` of the cell where rows meet, dealt by these.

    A key whose rows would make more than BLOCK * BLOCK pairs has several cells; each pair of rows meets in one of them.
    """
    sizes = left.groupBy(*keys).agg(F.count("*").alias("n")).join(right.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    hot = sizes.where(F.col("n") * F.col("m") > BLOCK * BLOCK).select(
        *keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("m") / BLOCK).cast("int").alias("columns")
    )
    hot = settle(hot, "hot-grams")
    one = F.lit(1)

    def side(df: DataFrame, own: str, count: str, other: str, others: str, by: str) -> DataFrame:
        known = df.join(hot, keys, "left").withColumn(own, F.pmod(F.xxhash64(by), F.coalesce(count, one)).cast("int"))
        known = known.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(others, one) - 1)))
        return spread(known.drop("rows", "columns"), *keys, "row", "column")

    return side(left, "row", "rows", "column", "columns", left_id), side(right, "column", "columns", "row", "rows", right_id)


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """``class_a, class_b, similarity`` of all pairs of classes (``class_a < class_b``) that reach the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is 1 at most")
    sets = settle(ordered(classes).withColumn("grams", F.transform("grams", _code)), "ordered-grams")
    least = F.ceil(F.col("size") * threshold - 1e-9).cast("int")  # the size of the smaller one at least
    # With ``left`` grams from a place on, a partner may have so many at most if these are to be enough for both.
    left = F.col("size") - F.col("place")
    most = (F.floor((left * (1 + threshold) + 1e-6) / threshold) - F.col("size")).cast("int")
    each = sets.select("class_id", "size", "grams", F.posexplode("grams").alias("place", "gram")).withColumns({"least": least, "most": F.least("size", most)})
    small = each.where(most >= F.col("size")).select("gram", F.col("size").alias("small"), F.col("class_id").alias("a"), F.col("grams").alias("ga"), F.col("place").alias("pa"))
    large = each.where("most >= least").select("gram", F.explode(F.sequence("least", "most")).alias("small"), F.col("class_id").alias("b"), F.col("size").alias("nb"), F.col("grams").alias("gb"))
    small, large = cells(small, large, ["gram", "small"], "a", "b")
    met = small.join(large, ["gram", "small", "row", "column"]).where((F.col("small") < F.col("nb")) | (F.col("a") < F.col("b")))
    met = met.where((F.col("small") - F.col("pa")) * (1 + threshold) >= threshold * (F.col("small") + F.col("nb")) - 1e-6)
    # In the order of the first array: its first element is the first that both have. Exploded, so that it is made once.
    met = met.select("gram", "small", "nb", "a", "b", F.explode(F.array(F.array_intersect("ga", "gb"))).alias("shared"))
    common = F.size("shared")
    similarity = common.cast("double") / (F.col("small") + F.col("nb") - common)
    pairs = met.where((F.get("shared", F.lit(0)) == F.col("gram")) & (similarity >= threshold))
    return pairs.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), similarity.alias("similarity"))


def link_names(df: DataFrame, key: str, name: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Members (``key, class_id``) and linked classes (``class_a, class_b, similarity``)."""
    members, classes = name_classes(df, key, name)
    return members, settle(similar_classes(classes, threshold), "name-links")


def count_links(df: DataFrame, key: str, name: str, threshold: float) -> DataFrame:
    """``key, class_id, n_links`` of every row: how many other rows have a name that is similar enough."""
    members, classes = name_classes(df, key, name)
    pairs = settle(similar_classes(classes, threshold), "name-links")
    both = pairs.select("class_a", "class_b").union(pairs.select("class_b", "class_a"))
    sizes = classes.select(F.col("class_id").alias("class_b"), "members")
    linked = both.join(sizes, "class_b").groupBy(F.col("class_a").alias("class_id")).agg(F.sum("members").alias("linked"))
    links = classes.join(linked, "class_id", "left").select("class_id", (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return members.join(links, "class_id", "left").select("key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
