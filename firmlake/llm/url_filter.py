"""URL filters over time: dated list entries become validity intervals, captures are joined as of their fetch time.

An entry adds a URL, a host or a domain to a list, or takes it off, at some time. What is listed when follows per key
from the order of its entries. Both sides carry the month: intervals are cut at month ends, so captures of one host
spread over the months, a key with very many entries is ordered month by month (only its last state of each month is
carried on), and the join is an equality on key and month with the time as a further condition. Everything is DataFrame
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmlake.session import settle

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^#]*)"


def host(url: Column) -> Column:
    """Host name in lower case, without user, port and final dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 2)), r"\.+$", "")


def normal(url: Column) -> Column:
    """The URL without fragment and user, scheme and host in lower case; other texts stay as they are."""
    parsed = F.concat(F.lower(F.regexp_extract(url, _URL, 1)), F.lit("://"), host(url), F.regexp_extract(url, _URL, 3),
                      F.regexp_extract(url, _URL, 4))
    return F.when(url.rlike(_URL), parsed).otherwise(url)


def entry_key(scope: Column, value: Column) -> Column:
    """``url:``, ``host:`` or ``domain:`` and the normal form of the value; null for any other scope."""
    name = F.regexp_replace(F.lower(value), r"^\.+|\.+$", "")
    return F.when(scope == "url", F.concat(F.lit("url:"), normal(value))).when(
        scope.isin("host", "domain"), F.concat(scope, F.lit(":"), name)
    )


def capture_keys(url: Column) -> Column:
    """All keys a capture can be listed by: its URL, its host, and the host's domains of two labels or more."""
    name = host(url)
    labels = F.split(name, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda k: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")),
    )
    known = F.concat(F.array(F.concat(F.lit("host:"), name)), F.when(F.size(labels) > 1, domains).otherwise(F.array().cast("array<string>")))
    return F.concat(F.array(F.concat(F.lit("url:"), normal(url))), F.when(name != "", known).otherwise(F.array().cast("array<string>")))


def intervals(entries: DataFrame, first: Column, last: Column) -> DataFrame:
    """``key, month, valid_from, valid_to``: when a key is listed, cut at month ends, up to the month of ``last``.

    ``entries``: ``scope, value, listed, at``. Entries with a null in one of them, or another scope, are left out. Of
    entries of one key at one time, one that lists wins. ``first`` and ``last`` bound the months that are of interest.
    """
    rows = entries.select(entry_key(F.col("scope"), F.col("value")).alias("key"), F.col("listed").cast("int").alias("on"), F.col("at").cast("timestamp").alias("at"))
    rows = rows.where("key is not null and `on` is not null and at is not null").groupBy("key", "at").agg(F.max("on").alias("on"))
    rows = settle(rows.withColumn("month", F.trunc("at", "month")), "entries")
    months = rows.groupBy("key", "month").agg(F.max_by("on", "at").alias("on"))
    by_month = W.partitionBy("key").orderBy("month")  # a row per month at most
    months = months.withColumns({"before": F.lag("on").over(by_month), "next": F.lead("month").over(by_month)})
    following = lambda c: F.add_months(c, 1)
    within = rows.select("key", "month", "at", "on", F.lit(1).alias("_order")).union(
        months.where("before = 1").select("key", "month", F.col("month").cast("timestamp"), F.lit(1), F.lit(0))
    )
    place = W.partitionBy("key", "month").orderBy("at", "_order")
    until = F.coalesce(F.lead("at").over(place), following("month").cast("timestamp"))
    within = within.withColumn("until", until).where("`on` = 1 and at < until").select(
        "key", "month", F.col("at").alias("valid_from"), F.col("until").alias("valid_to")
    )
    begin = F.greatest(following("month"), F.trunc(first, "month"))
    end = F.least(F.coalesce(F.add_months("next", -1), F.trunc(last, "month")), F.trunc(last, "month"))
    gaps = months.where("on = 1").where(begin <= end).select(
        "key", F.explode(F.sequence(begin, end, F.expr("interval 1 month"))).alias("month")
    )
    gaps = gaps.select("key", "month", F.col("month").cast("timestamp").alias("valid_from"), following("month").cast("timestamp").alias("valid_to"))
    return within.union(gaps)


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, url, fetched_at, blocked, n_reasons, reasons`` for every capture.

    ``reasons`` are the keys listed at the time of the fetch, sorted and joined by blanks. A capture with a null URL or
    time, and an empty URL, is not blocked. Equal rows get equal results; other columns are left out; without captures
    the result is empty.
    """
    rows = captures.select("page_id", F.col("url").cast("string").alias("url"), F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    span = rows.agg(F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b")).first()
    dated = rows.where("url <> '' and fetched_at is not null").distinct()
    listed = settle(intervals(entries, F.lit(span["a"]).cast("timestamp"), F.lit(span["b"]).cast("timestamp")), "intervals")
    asked = dated.withColumns({"key": F.explode(F.array_distinct(capture_keys(F.col("url")))), "month": F.trunc("fetched_at", "month")})
    met = asked.join(listed, ["key", "month"]).where("fetched_at >= valid_from and fetched_at < valid_to")
    found = met.groupBy("page_id", "url", "fetched_at").agg(F.sort_array(F.collect_set("key")).alias("_keys"))
    found = found.select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("fetched_at").alias("_f"), "_keys")
    same = F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("url") == F.col("_u")) & (F.col("fetched_at") == F.col("_f"))
    out = rows.join(settle(found, "listed"), same, "left")
    return out.select(
        "page_id", "url", "fetched_at", F.col("_keys").isNotNull().alias("blocked"),
        F.coalesce(F.size("_keys"), F.lit(0)).cast("long").alias("n_reasons"),
        F.coalesce(F.array_join("_keys", " "), F.lit("")).alias("reasons"),
    )
