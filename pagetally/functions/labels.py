"""What a report shows for a stored value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetally.functions import uri
from pagetally.model import GROUPING_IDS, UNKNOWN_LABEL


def present(grouping_id: Column, value: Column, territory: Column | None = None) -> Column:
    """Label of a panel value; ``territory`` is the country name joined in, if any."""
    unknown = F.lit(UNKNOWN_LABEL)
    country = value if territory is None else F.coalesce(territory, value)
    # a referrer like mailto:a@b has no host; one without scheme, host and path is unknown
    named = F.when(uri.scheme(value).isNotNull(), value)
    return (
        F.when(value.isNull() | (value == ""), unknown)
        .when(grouping_id == GROUPING_IDS["country_code"], country)
        .when(grouping_id == GROUPING_IDS["referrer"], F.coalesce(uri.referrer(value), named, unknown))
        .otherwise(value)
    )


def value_key(grouping_id: Column, value: Column) -> Column:
    """Hash key of a (dimension, value) pair; '' and NULL share one key."""
    return F.xxhash64(grouping_id, F.nullif(value, F.lit("")))
