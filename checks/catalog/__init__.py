"""All registered queries, grouped as in the survey."""

from checks.catalog import filters, functions, ingest, lake, panels, registry, streams

_MODULES = (panels, filters, functions, registry, ingest, lake, streams)


def all_queries():
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def all_sql():
    return {name: text for module in _MODULES for name, text in module.SQL.items()}
