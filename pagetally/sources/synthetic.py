"""Synthetic page views, deterministic by row id and seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetally.functions import uri
from pagetally.model import DIMENSIONS
from pagetally.operators.agents import AGENT_COLUMNS, agent_columns

# (utm_source, utm_medium, utm_campaign, utm_content); a tuple of NULLs is no campaign.
CAMPAIGNS = [
    ("searchads", "ppc", "spring", "headline"),
    ("searchads", "ppc", "autumn", "sidebar"),
    ("newsletter", "email", "monthly", "cta"),
    ("newsletter", "email", "welcome", None),
    ("chat", "social", "launch", None),
    ("video", "social", None, "preroll"),
    ("partner", "referral", "exchange", None),
    ("podcast", "audio", None, None),
    (None, None, None, None),
    (None, None, None, None),
]

AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:133.0) Gecko/20100101 Firefox/133.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.4 Safari/605.1.15",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_5 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.5 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; K) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/130.0.0.0 Mobile Safari/537.36",
]

SECTIONS = ("blog", "docs", "shop", "help", "news", "about")
# Fixed value: the share of the root page, against 1 of every other page.
ROOT_WEIGHT = 300
PAGES_PER_SECTION = 12

REFERRERS = [
    None,
    None,
    "https://www.google.com/",
    "https://duckduckgo.com/",
    "https://news.ycombinator.com/",
    "https://t.co/",
    "https://www.reddit.com/",
    "https://partner.example.org/",
]


def draw(row_id: Column, seed: int, stream: int, size: int) -> Column:
    """A number in [0, size) hashed from seed, stream and row: streams are independent of one another."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(stream)), row_id.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % F.lit(size)


def _pick(values: Sequence[str | None], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at + F.lit(1)).cast("int"))


def synth_page_views(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Fill (id, service_id, timestamp) rows with random dimensions.

    The root path is drawn 300 times as often as any other path together with
    its weight in the table; about a quarter of the referrers are missing.
    """
    row = F.col("id")
    campaign = draw(row, seed, 1, len(CAMPAIGNS))
    agent = _pick(AGENTS, draw(row, seed, 2, len(AGENTS)))
    referrer = _pick(REFERRERS, draw(row, seed, 3, len(REFERRERS)))
    others = len(SECTIONS) * PAGES_PER_SECTION
    slot = draw(row, seed, 4, ROOT_WEIGHT + others) - F.lit(ROOT_WEIGHT)
    section = _pick(SECTIONS, F.pmod(slot, F.lit(len(SECTIONS))))
    page = F.concat(F.lit("/"), section, F.lit("/"), F.floor(slot / len(SECTIONS)).cast("string"))
    drawn = agent_columns(rows.withColumns({"user_agent": agent, "__referrer": referrer}))
    columns = {
        "namespace": F.concat(F.col("service_id"), F.lit(".example.com")),
        "path": F.when(slot < 0, F.lit("/")).otherwise(page),
        "referrer": uri.referrer(F.col("__referrer")),
        "referrer_source": F.lit(None).cast("string"),
        "utm_source": _pick([c[0] for c in CAMPAIGNS], campaign),
        "utm_medium": _pick([c[1] for c in CAMPAIGNS], campaign),
        "utm_campaign": _pick([c[2] for c in CAMPAIGNS], campaign),
        "utm_content": _pick([c[3] for c in CAMPAIGNS], campaign),
        "country_code": F.lit(None).cast("string"),
        **{name: F.col(name) for name in AGENT_COLUMNS},
    }
    return drawn.select("id", "service_id", "timestamp", *[columns[d].alias(d) for d in DIMENSIONS])


def synth_ids(spark: SparkSession, n: int, sites: Sequence[str], start: str = "2024-01-01") -> DataFrame:
    """``n`` rows (id, service_id, timestamp), one second apart, sites in turn."""
    ids = spark.range(n)
    moment = F.lit(start).cast("timestamp_ntz") + F.make_interval(secs=F.col("id"))
    return ids.select("id", _pick(list(sites), F.col("id") % len(sites)).alias("service_id"), moment.alias("timestamp"))
