"""Raw beacons to accepted page views and rejects with a reason.

Everything is one projection plus left joins with lookup tables; no row is
multiplied, regrouped or dropped. The same function serves batch frames and
the micro-batches of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.functions import clock, uri
from pagetally.functions.agents import system_name
from pagetally.model import DIMENSIONS, PAGE_VIEW_TYPE
from pagetally.operators import agents
from pagetally.operators import lookups as lk
from pagetally.operators.joins import join_on
from pagetally.operators.registry import Registry, accepts, matcher_candidates

# Texts accepted as a boolean.
TRUE_TEXTS = ("1", "true")
FALSE_TEXTS = ("0", "false")

# Reasons for a reject, in order of precedence. ``missing_instance``
# is our own: an event without tenant would be one that no tenant can read.
REASONS = (
    "invalid_path",
    "invalid_params",
    "missing_instance",
    "is_bot",
    "missing_user_agent",
    "spam_host",
    "no_origin",
    "service_not_found",
    "no_pattern_match",
)


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def parse_flag(text: Column) -> Column:
    return F.when(text.isin(*TRUE_TEXTS), F.lit(True)).when(text.isin(*FALSE_TEXTS), F.lit(False))


def cast_beacons(beacons: DataFrame) -> DataFrame:
    """Typed beacon columns; what cannot be cast is flagged, not raised.

    In steps, so that a pattern read by several columns runs once per row.
    """
    fields = {f"__{name}": blank_to_null(F.col(name)) for name in "bpro"}
    b, p, r, o = (F.col(name) for name in fields)
    parts = {
        "bot_flag": parse_flag(b),
        "__path": uri.path(p),
        "__scheme": uri.scheme(r),
        "referrer_path": uri.path(r),
        "referrer_host": uri.host(r),
        "namespace": uri.host(o),
        "service_id": blank_to_null(F.col("i")),
    }
    path = F.col("__path")
    unread = F.col("broken").isNotNull() if "broken" in beacons.columns else F.lit(False)
    results = {
        "invalid_params": unread | (b.isNotNull() & F.col("bot_flag").isNull()),
        "invalid_path": p.isNotNull() & path.isNull(),
        "path": uri.rooted(path),
        "referrer": uri.referrer_from(F.col("__scheme"), F.col("referrer_host"), F.col("referrer_path")),
    }
    done = beacons.withColumns(fields).withColumns(parts).withColumns(results)
    return done.drop(*fields, "__path", "__scheme")


def utm_columns(rows: DataFrame) -> DataFrame:
    """The four campaign columns from the decoded query."""
    pairs = rows.withColumn("__pairs", uri.query_pairs(blank_to_null(F.col("q"))))
    values = {key: uri.last_value(F.col("__pairs"), key) for key in uri.ALLOWED_QUERY_KEYS}
    return pairs.withColumns(values).drop("__pairs")


def agent_columns(
    rows: DataFrame, table: DataFrame | None = None, rules: DataFrame | None = None, seen: DataFrame | None = None
) -> DataFrame:
    """All columns derived from the user agent, from a finished table of agents or by rules."""
    if table is None:
        return agents.agent_columns(rows, rules, seen)
    values = {**{name: name for name in agents.AGENT_COLUMNS}, "is_bot": "bot_agent"}
    joined = lk.lookup(rows, F.col("user_agent"), table, "user_agent", values)
    return joined.withColumns(
        {
            "operating_system": system_name(F.col("operating_system")),
            "bot_agent": F.coalesce("bot_agent", F.lit(False)),
        }
    )


def matched_hosts(rows: DataFrame, registry: Registry, mode: str = "reference") -> DataFrame:
    """Distinct (site, host) pairs of the rows of which some matcher accepts the host.

    Host and matchers meet in an equi-join on a piece of text that the matcher needs (see
    ``registry.indexed_matchers``), so that a site with many hosts and many matchers tests
    few of its pairs.
    """
    keys = registry.keys
    pairs = rows.where(F.col("service_id").isNotNull() & F.col("namespace").isNotNull())
    pairs = pairs.select(*keys, "namespace").distinct()
    found = matcher_candidates(pairs, registry.matchers, keys, mode).where(accepts(mode))
    return found.select(*keys, "namespace").distinct()


def match_sites(
    rows: DataFrame, registry: Registry, mode: str = "reference", seen: DataFrame | None = None
) -> DataFrame:
    """Add ``service_found`` and ``host_matched``.

    One plan for a registry of any size: every distinct (site, host) pair is tested
    once, and the accepted pairs are joined back. Nothing is written, and no job
    starts before the result is asked for. ``seen`` is a frame that has all pairs of ``rows``
    and takes less work to read.
    """
    keys = registry.keys
    accepted = matched_hosts(rows if seen is None else seen, registry, mode).withColumn("host_matched", F.lit(True))
    sites = registry.services.select(*keys).distinct().withColumn("service_found", F.lit(True))
    joined = join_on(join_on(rows, sites, keys), accepted, [*keys, "namespace"])
    return joined.withColumns(
        {name: F.coalesce(name, F.lit(False)) for name in ("service_found", "host_matched")}
    )


def reject_reason() -> Column:
    """First reason that applies; NULL means accepted."""
    return (
        F.when(F.col("invalid_path"), F.lit("invalid_path"))
        .when(F.col("invalid_params"), F.lit("invalid_params"))
        .when(F.col("instance").isNull(), F.lit("missing_instance"))
        .when(F.col("bot_flag"), F.lit("is_bot"))
        .when(F.col("user_agent").isNull(), F.lit("missing_user_agent"))
        .when(F.col("bot_agent"), F.lit("is_bot"))
        .when(F.col("is_spam_host"), F.lit("spam_host"))
        .when(F.col("namespace").isNull(), F.lit("no_origin"))
        .when(~F.col("service_found"), F.lit("service_not_found"))
        .when(~F.col("host_matched"), F.lit("no_pattern_match"))
    )


def ingest(
    beacons: DataFrame,
    registry: Registry,
    lookups: lk.Lookups,
    mode: str = "reference",
    drop_local: bool = False,
) -> DataFrame:
    """Every beacon with its reject reason (NULL = accepted) and the page-view columns.

    ``drop_local`` leaves out beacons from local hosts before anything else. A
    column ``broken`` (see ``beacons.from_messages``), if there is one, holds the
    text of what could not be read.
    """
    raw = beacons.columns

    # First all that can reject a beacon.
    rows = cast_beacons(beacons)
    if drop_local:
        rows = rows.where(~F.coalesce(uri.is_local_host(F.col("namespace")), F.lit(False)))
    # Distinct agents, hosts and referrers are all taken from here, before any join.
    seen = rows
    rows = agent_columns(rows, lookups.agents, lookups.agent_rules, seen)
    rows = lk.with_spam_flag(rows, F.col("namespace"), lookups.spam_hosts)
    rows = match_sites(rows, registry, mode, seen)
    rows = rows.withColumn("reason", reject_reason())

    # Then what describes a page view. A filter on the reason moves below these
    # steps, so accepted events pay for them and rejects do not. Keeping the two
    # halves apart also keeps the generated code of each small enough to compile.
    rows = utm_columns(rows)
    rows = lk.with_country(rows, F.col("z"), lookups.zones)
    rows = lk.with_referrer_source(rows, F.col("referrer_host"), lookups.sources, F.col("referrer_path"), seen)
    moment = clock.trunc_column("second", F.col("received_at")).alias("timestamp")
    return rows.select(*raw, "service_id", moment, *DIMENSIONS, "reason")


def accepted(ingested: DataFrame) -> DataFrame:
    return ingested.where(F.col("reason").isNull())


def rejected(ingested: DataFrame, beacon_columns: list[str]) -> DataFrame:
    """Rejected beacons as they came in, with the reason."""
    return ingested.where(F.col("reason").isNotNull()).select(*beacon_columns, "reason")


def reject_counts(ingested: DataFrame) -> DataFrame:
    return ingested.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("count"))


def to_events(ingested: DataFrame, blank_as_null: bool = True) -> DataFrame:
    """Accepted rows as events (instance, entity_id, timestamp, type, properties).

    With ``blank_as_null`` an empty property is stored as NULL, so that it can be
    selected and is counted together with missing ones.
    """

    def stored(name: str) -> Column:
        column = F.col(name)
        return (F.nullif(column, F.lit("")) if blank_as_null else column).alias(name)

    return accepted(ingested).select(
        "instance",
        F.col("service_id").alias("entity_id"),
        "timestamp",
        F.lit(PAGE_VIEW_TYPE).alias("type"),
        F.struct(*[stored(name) for name in DIMENSIONS]).alias("properties"),
    )
