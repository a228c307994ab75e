"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Rows with equal texts form a group. Spark sums bytes, tokens and rows of every group; a group that holds a noticeable
share of a shard (``LARGE``) is placed on its own, all others are added up into a fixed number of bundles by the hash of
their text. So the list that is packed on the driver has a bound that does not depend on the data:
3 * shards / LARGE + BUNDLES units. Units go, largest first, to the shard whose residual capacity has the largest dot
product with the unit, among the shards whose bytes still have room for it; if there is none, to the shard with most
bytes left. Groups that fit into a shard stay whole; a group larger than a shard in some dimension is cut by ``doc_id``
into equal pieces.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlake.llm.common import fresh
from firmlake.session import settle

LARGE = 1 / 64  # of a shard, in any dimension
BUNDLES = 4096
PIECES = 8  # pieces a shard's worth of an oversized group is cut into
SLACK = 0.002  # of a shard's bytes
MOST_BUCKETS = 4096  # parts of a shard that are numbered side by side


def pack(units: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit; ``units`` has a row per unit and a column per dimension, bytes first."""
    total = np.maximum(units.sum(axis=0), 1e-9)
    load = units / (total / shards)
    room = np.ones((shards, units.shape[1]))
    room[:, 0] += SLACK
    out = np.zeros(len(units), dtype=np.int32)
    for k in np.lexsort((np.arange(len(units)), -load.max(axis=1, initial=0.0))):
        fits = room[:, 0] >= load[k, 0]
        best = int(np.argmax(np.where(fits, room @ load[k], -np.inf))) if fits.any() else int(np.argmax(room[:, 0]))
        room[best] -= load[k]
        out[k] = best
    return out


def measure(docs: DataFrame) -> DataFrame:
    """One narrow row per document: id, size, tokens, checksum and group."""
    text = F.col("text")
    return docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long").alias("_tokens"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_group"),
    )


def place(rows: DataFrame, shards: int) -> DataFrame:
    """Measured rows with their ``shard``."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("size").alias("b"), F.sum("_tokens").alias("t"), F.count("*").alias("r")).first()
    if not total["r"]:
        return rows.withColumn("shard", F.lit(0))
    share = F.greatest(*[F.col(c) * shards / max(total[c], 1) for c in ("b", "t", "r")])
    groups = rows.groupBy("_group").agg(F.sum("size").alias("b"), F.sum("_tokens").alias("t"), F.count("*").alias("r"))
    bundle = F.pmod(F.xxhash64("_group"), F.lit(BUNDLES)).cast("int")
    units = (
        groups.withColumn("_large", share >= LARGE)
        .select(F.when(F.col("_large"), F.col("_group")).alias("_group"),
                F.when(~F.col("_large"), bundle).alias("_bundle"), "b", "t", "r")
        .groupBy("_group", "_bundle").agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("r").alias("r"))
        .orderBy("_group", "_bundle").collect()  # at most 3 * shards / LARGE + BUNDLES rows
    )
    owner, loads = [], []
    for k, u in enumerate(units):
        most = max(u[c] * shards / max(total[c], 1) for c in ("b", "t", "r"))
        n = math.ceil(PIECES * most) if u["_group"] is not None and most > 1 else 1
        owner += [k] * n
        loads += [[u["b"] / n, u["t"] / n, u["r"] / n]] * n
    homes: list[list[int]] = [[] for _ in units]
    for k, shard in zip(owner, pack(np.array(loads), shards).tolist()):
        homes[k].append(shard)
    large = [(u["_group"], h) for u, h in zip(units, homes) if u["_group"] is not None]
    small = [(u["_bundle"], h[0]) for u, h in zip(units, homes) if u["_group"] is None]
    large_map = F.broadcast(spark.createDataFrame(large, "_group long, _homes array<int>"))
    small_map = F.broadcast(spark.createDataFrame(small, "_bundle int, _home int"))
    piece = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.size("_homes")).cast("int")
    return (
        rows.withColumn("_bundle", bundle)
        .join(large_map, "_group", "left")
        .join(small_map, "_bundle", "left")
        .withColumn("shard", F.coalesce(F.when(F.col("_homes").isNotNull(), F.get("_homes", piece)), F.col("_home")))
        .drop("_homes", "_home", "_bundle")
    )


def number(rows: DataFrame) -> DataFrame:
    """Gapless ``slot`` within each shard, without sorting a whole shard in one task.

    Each shard is cut into buckets by the hash of the id; rows are numbered within their bucket, and a bucket starts
    where the ones before it end. The bucket counts (shards * MOST_BUCKETS rows at most) are what is broadcast.
    """
    spark = rows.sparkSession
    buckets = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    from pyspark.sql import Window as W

    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    starts = starts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_k", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "_bucket"])
        .withColumn("slot", (F.col("_start") + F.col("_k") - 1).cast("long"))
        .drop("_bucket", "_k", "_start")
    )


def assign_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: the place of every document.

    ``law`` is ``bytes``: the shards' sizes are nearly equal. A null text has no bytes and no checksum; null texts form
    one group, empty texts another. Repeated rows are placed each on their own count. Other columns are left out. An
    empty table gives an empty result. ``grown_shard`` is null: another number of shards is packed anew.
    """
    rows = settle(measure(docs), "sharding")
    return number(settle(place(rows, shards), "sharding")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Write the documents below ``path``, one folder per shard; every column is kept.

    The folders are named after a new column ``shard``, with underscores in front if the table has one already.
    """
    shard, key = fresh(docs.columns, "shard"), fresh(docs.columns, "_key")
    placed = place(settle(measure(docs), "sharding"), shards).select("doc_id", "_group", "shard").distinct()
    placed = placed.select(F.struct("doc_id", "_group").alias(key), F.col("shard").alias(shard))
    own = F.struct(F.col("doc_id"), F.xxhash64("text").alias("_group"))
    docs.join(placed, own.eqNullSafe(placed[key])).drop(key).write.partitionBy(shard).parquet(path)
