"""URL filters over time: dated list entries against captures at their fetch time. DataFrame functions only.

Entries are dated ``add`` and ``remove`` events of (list, value); a value is a host or domain (``h:example.org``,
covering its subdomains) or a host with a path prefix (``p:example.org/en``). Events become validity intervals
[add, next event); a capture offers all its domain suffixes and path prefixes as keys, meets the intervals of a key by
equi-join and keeps those open on its fetch date.

Captures are reduced to distinct (url, date) first and list intervals to one row per key, so a host with a third of
all pages only meets the short interval array of its keys.

Defined cases: a null or unparsable url has no host and is not blocked; a null date meets no interval; of two events
of a value on one day ``add`` wins; repeated events count once; repeated captures give repeated results; an empty list
blocks nothing; columns other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"


def host(url: str) -> Column:
    """Lower-case host without user part, port and final dot; empty when there is none."""
    bare = F.regexp_replace(F.lower(F.regexp_extract(url, AUTHORITY, 1)), "^[^@]*@", "")
    return F.coalesce(F.regexp_replace(bare, "[.]?(:[0-9]*)?$", ""), F.lit(""))


def keys(host_col: str, path_col: str) -> Column:
    """All domain suffixes of at least two labels (or the single label), and all path prefixes below the host."""
    labels = F.split(F.col(host_col), "[.]")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)),
                           lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(labels, k, n), ".")))
    parts = F.filter(F.split(F.col(path_col), "/"), lambda x: x != "")
    m = F.size(parts)
    prefixes = F.when(m > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), m)), lambda k: F.concat(
        F.lit("p:"), F.col(host_col), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))) \
        .otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(suffixes, prefixes))


def intervals(events: DataFrame) -> DataFrame:
    """events: list, value, on, action -> one row per value with an array of (list, from, until)."""
    day = events.where(F.col("value").isNotNull() & F.col("on").isNotNull()).groupBy("list", "value", "on") \
        .agg(F.max(F.col("action") == "add").alias("open"))
    following = F.lead("on").over(Window.partitionBy("list", "value").orderBy("on"))
    spans = day.withColumn("until", following).where("open")
    return spans.groupBy("value").agg(F.collect_list(F.struct("list", F.col("on").alias("since"), "until")).alias("spans"))


def filter_captures(captures: DataFrame, events: DataFrame, key: str = "page_id", url: str = "url",
                    fetched: str = "fetched_on") -> DataFrame:
    """Per capture: key, host, fetched, n_entries active, blocked, lists and matched (sorted, comma-joined)."""
    rows = captures.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(fetched).alias("_on"))
    seen = rows.where(F.col("_url").isNotNull() & F.col("_on").isNotNull()).select("_url", "_on").distinct() \
        .withColumn("_host", host("_url")).withColumn("_path", F.regexp_extract("_url", PATH, 1)).where("_host != ''")
    offered = seen.select("_url", "_on", F.explode(keys("_host", "_path")).alias("value"))
    met = offered.join(intervals(events), "value").select(
        "_url", "_on", "value", F.explode("spans").alias("span")).where(
        (F.col("span.since") <= F.col("_on")) & (F.col("span.until").isNull() | (F.col("_on") < F.col("span.until"))))
    decided = met.groupBy("_url", "_on").agg(
        F.count(F.lit(1)).alias("_n"), F.array_join(F.array_sort(F.collect_set("span.list")), ",").alias("_lists"),
        F.array_join(F.array_sort(F.collect_set("value")), ",").alias("_matched"))
    n = F.coalesce(F.col("_n"), F.lit(0).cast("long"))
    return rows.join(decided, ["_url", "_on"], "left").select(
        F.col("_key").alias(key), host("_url").alias("host"), F.col("_on").alias(fetched), n.alias("n_entries"),
        (n > 0).alias("blocked"), F.coalesce("_lists", F.lit("")).alias("lists"),
        F.coalesce("_matched", F.lit("")).alias("matched"))
