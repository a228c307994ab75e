"""Who is the same person: records of one block (name and birth) are linked by the fields they agree in.

Every field has a weight for agreement and a lower one for anything else (missing values agree with nothing); two records
of a block are linked if the sum reaches a threshold. More agreement never lowers the sum, so the links are given by the
smallest sets of fields whose agreement is enough. Records that share a block and the values of such a set are linked with
each other: each is tied to the least of them, and no pair is ever formed, whatever the size of a block. Groups are the
connected components of these ties.

Weights are learned without labels, by expectation maximisation over the pairs of all blocks: a mixture of pairs that are
the same person and pairs that are not, with fields that agree independently in both. How many pairs show which pattern of
agreement follows from group sizes, by inclusion and exclusion; again no pair is formed.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlake.functions.text import normalize_name
from firmlake.session import discard, settle


@dataclass(frozen=True)
class Weights:
    """Per field: the weight of agreement and of anything else, in bits; ``prior`` is the share of pairs that match."""

    agree: dict[str, float]
    differ: dict[str, float]
    prior: float = 0.5

    def enough(self, threshold: float) -> list[frozenset[str]]:
        """The smallest sets of fields whose agreement reaches the threshold."""
        out: list[frozenset[str]] = []
        for size in range(len(self.agree) + 1):
            for own in combinations(sorted(self.agree), size):
                total = sum(self.agree[f] if f in own else self.differ[f] for f in self.agree)
                if total >= threshold and not any(known <= set(own) for known in out):
                    out.append(frozenset(own))
        return out


def officer_block(name: str = "officer_name", birth: str = "date_of_birth") -> list[Column]:
    """Name key, and year and month of birth: what officers of one block have in common."""
    return [normalize_name(F.col(name)).alias("_name"), F.date_format(birth, "yyyy-MM").alias("_birth")]


def _blocked(rows: DataFrame, block: list[Column], columns: list[str]) -> tuple[DataFrame, list[str], str]:
    """The rows with their block, its columns, and the condition that it is known: a row with a part of it missing meets nobody.

    The condition is for rows that are settled; before that, Spark would make the block's costly texts twice, for the filter
    and for the rows.
    """
    named = [c.alias(f"_b{k}") for k, c in enumerate(block)]
    keys = [f"_b{k}" for k in range(len(block))]
    return rows.select(*columns, *named), keys, " and ".join(f"{k} is not null" for k in keys)


def pattern_counts(rows: DataFrame, block: list[Column], fields: list[str]) -> dict[frozenset[str], int]:
    """For every set of fields: how many pairs of records of a block agree in exactly these.

    Pairs that agree in a set at least are counted from the sizes of groups with equal values there; what agrees in more is
    then taken off. The result has ``2 ** len(fields)`` numbers.
    """
    found, keys, whole = _blocked(rows, block, fields)
    # Equal rows are counted first, so that a hot block or value is small before it meets anything.
    settled = settle(found.groupBy(*keys, *fields).agg(F.count("*").alias("_n")), "identity")
    known = settled.where(whole)
    at_least: dict[frozenset[str], int] = {}
    for size in range(len(fields) + 1):
        for own in combinations(fields, size):
            there = known.where(" and ".join([f"`{f}` is not null" for f in own]) or "true")
            groups = there.groupBy(*keys, *own).agg(F.sum("_n").alias("n"))
            pairs = groups.agg(F.sum(F.expr("cast(n as decimal(38,0)) * (n - 1) / 2")).alias("pairs")).first()["pairs"]
            at_least[frozenset(own)] = int(pairs or 0)
    discard(settled)
    return {own: sum((-1) ** (len(more) - len(own)) * n for more, n in at_least.items() if own <= more) for own in at_least}


def learn(rows: DataFrame, block: list[Column], fields: list[str], rounds: int = 200, smoothing: float = 0.5) -> Weights:
    """Weights by expectation maximisation over the patterns of agreement.

    A field whose agreement says nothing, or the opposite, gets no weight. Without any pair there is nothing to learn:
    all weights are zero.
    """
    counts = pattern_counts(rows, block, fields)
    total = sum(counts.values())
    if not total:
        return Weights(dict.fromkeys(fields, 0.0), dict.fromkeys(fields, 0.0))
    prior, match, other = 0.2, dict.fromkeys(fields, 0.9), {}
    for f in fields:
        other[f] = (sum(n for own, n in counts.items() if f in own) + smoothing) / (total + 2 * smoothing) * 0.8
    for _ in range(rounds):
        share: dict[frozenset[str], float] = {}
        for own in counts:
            a, b = prior, 1 - prior
            for f in fields:
                a *= match[f] if f in own else 1 - match[f]
                b *= other[f] if f in own else 1 - other[f]
            share[own] = a / (a + b) if a + b else 0.5
        matched = sum(share[own] * n for own, n in counts.items())
        prior = min(max(matched / total, 1e-9), 1 - 1e-9)
        for f in fields:
            both = sum(share[own] * n for own, n in counts.items() if f in own)
            alone = sum((1 - share[own]) * n for own, n in counts.items() if f in own)
            match[f] = (both + smoothing) / (matched + 2 * smoothing)
            other[f] = (alone + smoothing) / (total - matched + 2 * smoothing)
    told = {f: match[f] > other[f] for f in fields}
    return Weights(
        {f: log2(match[f] / other[f]) if told[f] else 0.0 for f in fields},
        {f: log2((1 - match[f]) / (1 - other[f])) if told[f] else 0.0 for f in fields}, prior,
    )


def groups(rows: DataFrame, key: str, block: list[Column], fields: list[str], weights: Weights, threshold: float) -> DataFrame:
    """``key, group_id`` of every row with a key: rows are in one group if links lead from one to the other.

    The group is its least key. A row whose block is not known whole, or that is linked with nobody, is a group of its
    own; rows that repeat a key are one record with the values of each. Rows without a key are left out.
    """
    everyone = rows.where(F.col(key).isNotNull())
    found, keys, whole = _blocked(everyone, block, [key, *fields])
    known = settle(found, "identity").where(whole)
    ties = None
    for own in weights.enough(threshold):
        there = known.where(" and ".join([f"`{f}` is not null" for f in own]) or "true")
        by = [*keys, *sorted(own)]
        # The hub comes from an aggregate and joins back: a hot group is neither gathered nor paired.
        hubs = there.groupBy(*by).agg(F.min(key).alias("v"), F.count("*").alias("_n")).where("_n > 1")
        tied = there.select(F.col(key).alias("u"), *by).join(hubs.drop("_n"), by).select("u", "v").where("u <> v")
        ties = tied if ties is None else ties.union(tied)
    ids = everyone.select(F.col(key).alias("key")).distinct()
    if ties is None:
        return ids.select("key", F.col("key").alias("group_id"))
    found = connected(ties)
    return ids.join(found, ids["key"] == found["node"], "left").select("key", F.coalesce("root", "key").alias("group_id"))


def connected(ties: DataFrame) -> DataFrame:
    """``node, root`` for every node of the ties ``u, v``: the least node it is connected with.

    A round gives every node the first of itself and its neighbours as its label and goes on with the ties between different
    labels, so that what is joined already is not read again. In the first round the least node is first, the hub of its
    group; later rounds go by a hash that differs from round to round, by which on average a quarter of the nodes or more
    goes whatever the shape, long chains too. A node with very many ties is a plain join key: adaptive execution splits it.
    """

    def between(pairs: DataFrame) -> DataFrame:
        return settle(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "ties")

    ties, levels = between(ties), []
    while not levels or not ties.isEmpty():
        both = ties.union(ties.select("v", "u")).toDF("n", "m")
        if levels:
            place = lambda c: F.struct(F.xxhash64(F.lit(len(levels)), c).alias("place"), F.col(c).alias("label"))
            least = both.groupBy("n").agg(F.least(F.min(place("m")), F.first(place("n")))["label"].alias("label"))
        else:
            least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("label"))
        labels = settle(least, "labels")
        by_u, by_v = labels.toDF("u", "_u"), labels.toDF("v", "_v")
        new = between(ties.join(by_u, "u").join(by_v, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")))
        discard(ties)
        ties = new
        levels.append(labels)
    # Labels of labels, from the last round back to the second; the least node of a group is a label of the first round.
    first, *later = levels
    if not later:
        return first.toDF("node", "root")
    last = later.pop()
    while later:
        labels = later.pop()
        last = labels.join(last.toDF("label", "_last"), "label", "left").select("n", F.coalesce("_last", "label").alias("label"))
    roots = settle(last, "labels")
    roots = roots.join(roots.groupBy("label").agg(F.min("n").alias("_root")), "label").select(F.col("n").alias("label"), "_root")
    return first.join(roots, "label", "left").select(F.col("n").alias("node"), F.coalesce("_root", "label").alias("root"))
