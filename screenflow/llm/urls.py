"""URL filters as a temporal list join.

Dated list entries (a key is listed or taken off a list on a day) become
validity intervals. Every capture is evaluated against the entries active on the
day it was fetched, by an as-of join on its keys: the host, each parent domain,
and the host with the first path segment.

Captures meet the lists as distinct (url, day) pairs, so a page fetched a
million times a day is one row; frequent keys in the joins are split by the
adaptive skew join, as the other side holds at most one row a day for each key
and list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from screenflow.llm.common import col, free_name


def host(url: Column) -> Column:
    """The lower-case host, without user and port; empty without one."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(authority, r"\.+$", "")


def segment(url: Column) -> Column:
    """The first segment of the path; empty without one."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)


def keys(url: Column) -> Column:
    """The keys that can list a URL: the host, its parent domains of two labels or more, host/segment."""
    name, labels = host(url), F.split(host(url), r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    path = F.when(segment(url) != "", F.array(F.concat_ws("/", name, segment(url)))).otherwise(F.array().cast("array<string>"))
    return F.when(name != "", F.array_distinct(F.concat(domains, path))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """``key, list, since, until`` from dated entries ``key, list, dated, action``.

    An ``add`` holds from its day until the day of the next entry for the same
    key and list (open if there is none), and wins over a ``remove`` of the same
    day. Entries with a null are ignored, repeated ones count once.
    """
    daily = entries.dropna(subset=["key", "list", "dated", "action"]).groupBy("key", "list", "dated").agg(
        F.max((F.col("action") == "add").cast("int")).alias("listed")
    )
    following = F.lead("dated").over(Window.partitionBy("key", "list").orderBy("dated"))
    return daily.withColumn("until", following).filter("listed = 1").select("key", "list", F.col("dated").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """``captures`` with ``lists`` (sorted names of the lists active for it) and ``blocked``.

    A null or unreadable URL, or a null day, is on no list. Repeated captures
    each get their row. Empty tables give an empty result, or nothing blocked.
    The new columns get underscores in front where the input has such names.
    """
    seen = captures.select(col(url_col).alias("u"), col(day_col).alias("d")).dropna().distinct()
    asked = seen.select("u", "d", F.explode(keys(F.col("u"))).alias("key"))
    active = intervals(entries)
    on = (asked["key"] == active["key"]) & (active["since"] <= asked["d"]) & (active["until"].isNull() | (asked["d"] < active["until"]))
    found = asked.join(active, on).groupBy("u", "d").agg(F.array_sort(F.collect_set("list")).alias("found"))
    lists, blocked = free_name(captures, "lists"), free_name(captures, "blocked")
    u, d, hit = (free_name(captures, f"url_filter_{c}") for c in ("u", "d", "found"))
    found = found.select(F.col("u").alias(u), F.col("d").alias(d), F.col("found").alias(hit))
    joined = captures.join(found, (col(url_col) == F.col(u)) & (col(day_col) == F.col(d)), "left")
    none = F.array().cast("array<string>")
    return joined.withColumn(lists, F.coalesce(F.col(hit), none)).withColumn(blocked, F.col(hit).isNotNull()).drop(u, d, hit)
