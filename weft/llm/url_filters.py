"""URL filters that change over time: a temporal join of captures with dated list entries.

Entries say that a key is put on a list, or taken off it, at some time. Between
two entries of a key lies a validity interval. A capture is evaluated against
the intervals that hold at its fetch time, for every key that covers its URL:
the host and its parent domains, and the host with each leading part of the
path. The key with the longest path decides, then the one with the most host
labels, then ``allow`` before ``block``.

Intervals and captures meet by key and month: an interval stands once for each
month it touches. A host with a long history therefore doesn't multiply its
captures, and the join, an equi-join of a large with a small side, may be
split where one host has a large part of all captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import free_name

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower case, without user, port and closing dots; empty where there is none."""
    return F.coalesce(F.rtrim(F.lower(F.regexp_extract(url, URL, 1)), F.lit(".")), F.lit(""))


def keys_of(url: Column, labels_most: int | None = None, parts_most: int | None = None) -> Column:
    """All keys that cover a URL; none for a null or hostless one.

    No keys of more host labels or path parts than ``labels_most`` and
    ``parts_most`` are made: longer ones than any listed key match nothing.
    """
    host, path = host_of(url), F.regexp_extract(url, URL, 2)
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda p: p != "")
    none = F.array().cast("array<string>")
    few = F.size(labels) if labels_most is None else F.least(F.size(labels), F.lit(labels_most))
    domains = F.when(few > 0, F.transform(F.sequence(F.lit(1), few), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))).otherwise(none)
    deep = F.size(parts) if parts_most is None else F.least(F.size(parts), F.lit(parts_most))
    prefixes = F.when(deep > 0, F.transform(F.sequence(F.lit(1), deep), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(none)
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(none)


def validity(entries: DataFrame) -> DataFrame:
    """``list, key, since, until`` from ``entries(list, key, action, at)``; ``until`` is open where nothing follows.

    ``add`` begins an interval, ``remove`` ends it; an ``add`` to a listed key
    goes on with it. Of entries at the same time, ``remove`` counts last. Rows
    without key or time, rows whose list is neither ``allow`` nor ``block`` and
    rows whose action is neither ``add`` nor ``remove`` (in just these letters)
    are left out.
    """
    line = W.partitionBy("list", "key").orderBy("at", F.when(F.col("action") == "add", 0).otherwise(1))
    known = entries.select("list", "key", "action", "at").filter("key IS NOT NULL AND at IS NOT NULL AND list IN ('allow', 'block') AND action IN ('add', 'remove')")
    dated = known.withColumn("until", F.lead("at").over(line))
    return dated.filter("action = 'add' AND (until IS NULL OR until > at)").select("list", "key", F.col("at").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures ``(id, url, fetched_at)`` with ``verdict, matched_list, matched_key, listed_since``.

    The verdict is ``block`` or ``allow`` by the deciding list, else ``none``. A
    null or hostless URL or a null time matches nothing. Repeated captures give
    repeated results; other columns of the captures are kept, whatever their
    names, those named like a result are replaced. An empty list gives ``none`` for all.
    """
    made = ["verdict", "matched_list", "matched_key", "listed_since"]
    captures = captures.drop(*made)
    best = free_name(captures, "best")
    month = lambda c: (F.year(c) * 12 + F.month(c)).cast("int")
    latest = captures.agg(F.max(month(F.col("fetched_at")))).first()[0] or 0
    spans = validity(entries).filter(month(F.col("since")) <= latest)
    host_labels, path_parts = F.size(F.split(F.element_at(F.split("key", "/"), 1), r"\.")), F.size(F.split("key", "/")) - 1
    depth = spans.agg(F.max(host_labels), F.max(path_parts)).first()
    spans = spans.withColumn("month", F.explode(F.sequence(month(F.col("since")), F.least(F.lit(latest), F.coalesce(month(F.col("until")), F.lit(latest))))))
    distinct = captures.select("url", "fetched_at").filter("url IS NOT NULL AND fetched_at IS NOT NULL").distinct()
    asked = distinct.withColumn("key", F.explode(keys_of(F.col("url"), depth[0] or 0, depth[1] or 0))).withColumn("month", month(F.col("fetched_at")))
    hit = asked.join(spans, ["key", "month"]).filter("since <= fetched_at AND (until IS NULL OR fetched_at < until)")
    rank = F.struct(path_parts.alias("path"), host_labels.alias("labels"), F.when(F.col("list") == "allow", 1).otherwise(0).alias("allow"), "list", "key", "since")
    chosen = hit.groupBy("url", "fetched_at").agg(F.max(rank).alias(best))
    of = lambda field: F.col(best).getField(field)
    verdict = F.when(of("list") == "allow", "allow").when(F.col(best).isNotNull(), "block").otherwise("none")
    return captures.join(chosen, ["url", "fetched_at"], "left").select(*(F.col(f"`{c}`") for c in captures.columns), verdict.alias("verdict"), of("list").alias("matched_list"), of("key").alias("matched_key"), of("since").alias("listed_since"))
