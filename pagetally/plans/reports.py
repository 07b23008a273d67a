"""Site scope and the complete dashboard report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.model import DEFAULT_LIMIT
from pagetally.operators import panels, registry
from pagetally.operators.joins import join_on
from pagetally.plans.spec import QuerySpec

Sites = DataFrame | Sequence[str] | None


def _restrict(services: DataFrame, sites: Sites) -> DataFrame:
    if sites is None:
        return services
    if isinstance(sites, DataFrame):
        return services.join(sites.select("service_id"), "service_id", "left_semi")
    return services.where(F.col("service_id").isin(list(sites)))


def visible_services(services: DataFrame, permitted: Sites = None, requested: Sites = None) -> DataFrame:
    """Published sites that are permitted and, if any are asked for, requested.

    ``permitted=None`` permits every site; an empty list permits none.
    """
    found = _restrict(registry.published(services), permitted)
    if requested is None or (not isinstance(requested, DataFrame) and not list(requested)):
        return found.select("service_id")
    return _restrict(found, requested).select("service_id")


def scope(page_views: DataFrame, sites: DataFrame) -> DataFrame:
    """Page views of the given sites; no sites, no rows."""
    return join_on(page_views, sites.select("service_id"), ["service_id"], "left_semi")


def report(
    page_views: DataFrame,
    spec: QuerySpec,
    sites: DataFrame | None = None,
    territories: DataFrame | None = None,
    limit: int | None = DEFAULT_LIMIT,
) -> DataFrame:
    """What one dashboard shows: scoped, filtered, counted, cut and labelled."""
    rows = spec.apply(page_views)
    if sites is not None:
        rows = scope(rows, sites)
    return panels.present(panels.panel(rows, limit), territories)
