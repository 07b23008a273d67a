"""Lookup tables of ingest: spam hosts, time zones, referrer sources, agents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetally.functions import uri
from pagetally.operators.joins import join_on


@dataclass(frozen=True)
class Lookups:
    """``spam_hosts``: host. ``zones``: zone, country_code. ``sources``: host, source.

    ``agents`` (user_agent, browser, browser_version, operating_system,
    operating_system_version, is_bot) is optional; without it every distinct agent is
    read by ``agent_rules`` (see ``operators.agents``), or by the built-in rules.
    """

    spam_hosts: DataFrame
    zones: DataFrame
    sources: DataFrame
    agents: DataFrame | None = None
    agent_rules: DataFrame | None = None


def lookup(rows: DataFrame, key: Column, table: DataFrame, table_key: str, values: dict[str, str]) -> DataFrame:
    """Left join on one key; ``values`` maps a table column to its new name.

    The table is made unique by key first, so it cannot multiply rows.
    """
    entry = F.struct(*[F.col(column).alias(name) for column, name in values.items()])
    unique = table.groupBy(F.col(table_key).alias("__key")).agg(F.min(entry).alias("__entry"))
    return join_on(rows, unique.select("__key", "__entry.*"), {"__key": key})


def with_spam_flag(rows: DataFrame, host: Column, spam_hosts: DataFrame) -> DataFrame:
    flagged = spam_hosts.select("host", F.lit(True).alias("listed"))
    joined = lookup(rows, host, flagged, "host", {"listed": "is_spam_host"})
    return joined.withColumn("is_spam_host", F.coalesce("is_spam_host", F.lit(False)))


def without_spam_hosts(rows: DataFrame, host: Column, spam_hosts: DataFrame) -> DataFrame:
    """Only the rows whose host is not listed; rows without a host stay."""
    listed = spam_hosts.select(F.col("host").alias("__host"))
    return rows.join(listed, host == F.col("__host"), "left_anti")


def with_country(rows: DataFrame, zone: Column, zones: DataFrame) -> DataFrame:
    return lookup(rows, zone, zones, "zone", {"country_code": "country_code"})


# Fixed value: labels that a host name can have, 255 bytes in all.
MOST_LABELS = 127


def _head(path: Column, segments: Column) -> Column:
    """The first segments of a path, each with the slash before it."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda part: part != "")
    kept = F.slice(parts, F.lit(1), segments)
    return F.when(F.size(kept) > 0, F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(F.lit(""))


def _depth(path: Column) -> Column:
    return F.regexp_count(path, F.lit("/"))


def source_rules(sources: DataFrame) -> DataFrame:
    """(domain, prefix, source), one row each, from rules ``host`` or ``host/path``.

    A prefix is whole path segments: ``/shop`` is not one of ``/shopping``.
    """
    text = F.col("host")
    domain = F.substring_index(text, "/", 1)
    path = F.when(F.contains(text, F.lit("/")), F.substr(text, F.length(domain) + 1))
    rules = sources.where(text.isNotNull()).select(domain.alias("domain"), _head(path, F.length(text) + 1).alias("prefix"), "source")
    return rules.groupBy("domain", "prefix").agg(F.min("source").alias("source"))


def with_referrer_source(
    rows: DataFrame, host: Column, sources: DataFrame, path: Column | None = None, seen: DataFrame | None = None
) -> DataFrame:
    """Source of the rule that fits best: the longest domain, and of its rules the longest path.

    Rules are ``host`` or ``host/path``; a rule fits its domain and all below it, and every path that
    starts with its segments. Distinct (host, path) are matched, not rows, and of a path only
    as many segments as the longest rule has, none if no rule has a path. Each meets the
    rules with its domains and path prefixes in one equi-join; the best is joined back. ``seen``
    is a frame that has all referrers of ``rows`` and takes less work to read.
    """
    rules = source_rules(sources)
    if path is None:
        path = F.lit(None).cast("string")
    deepest = F.coalesce(rules.agg(F.max(_depth(F.col("prefix"))).alias("n")).scalar(), F.lit(0))
    place = {"__host": host, "__head": _head(path, deepest)}
    parts = F.split("__host", "[.]")
    ends = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(MOST_LABELS))),
        lambda n: F.struct(n.alias("labels"), F.array_join(F.slice(parts, -n, n), ".").alias("domain")),
    )
    heads = F.transform(
        F.sequence(F.lit(0), _depth(F.col("__head"))),
        lambda n: _head(F.col("__head"), n),
    )
    places = (rows if seen is None else seen).select(*[c.alias(name) for name, c in place.items()])
    places = places.where(F.col("__host").isNotNull()).distinct()
    places = places.select("__host", "__head", F.inline(ends)).select("*", F.explode(heads).alias("prefix"))
    found = join_on(places, rules, ["domain", "prefix"], "inner")
    best = found.groupBy("__host", "__head").agg(
        F.max_by("source", F.struct(F.col("labels"), _depth(F.col("prefix")))).alias("referrer_source")
    )
    return join_on(rows, best, place)


# A small table of our own; pass a larger one for production.
COMMON_SOURCES = [
    ("google.com", "Google"),
    ("mail.google.com", "Gmail"),
    ("bing.com", "Bing"),
    ("duckduckgo.com", "DuckDuckGo"),
    ("search.yahoo.com", "Yahoo!"),
    ("t.co", "Twitter"),
    ("twitter.com", "Twitter"),
    ("facebook.com", "Facebook"),
    ("linkedin.com", "LinkedIn"),
    ("reddit.com", "Reddit"),
    ("youtube.com", "YouTube"),
    ("news.ycombinator.com", "Hacker News"),
]


def common_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMMON_SOURCES, "host string, source string")
