"""RFC 3986 pieces and query strings as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
_BEFORE_PATH = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"
_HOST = _BEFORE_PATH + "//(?:[^/?#]*@)?(\\[[A-Za-z0-9:.]*\\]|[^/?#:]*)"
_PATH = _BEFORE_PATH + "(?://[^/?#]*)?([^?#]*)"

# The query keys a tracker may send.
ALLOWED_QUERY_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_content")

# Hosts that mean "developer's own machine or network".
LOCAL_HOSTS = "localhost$|^127[.]|^10[.]|^172[.](1[6-9]|2[0-9]|3[0-1])[.]|^192[.]168[.]|^0[.]0[.]0[.]0$"


def _part(uri: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(uri, pattern, 1), F.lit(""))


def scheme(uri: Column) -> Column:
    return F.lower(_part(uri, _SCHEME))


def host(uri: Column) -> Column:
    """Host without user info, port and IPv6 brackets; NULL when there is none."""
    return F.translate(_part(uri, _HOST), "[]", "")


def path(uri: Column) -> Column:
    """Path without query and fragment; NULL when it is empty.

    A text that starts with one slash needs no pattern, only the cuts.
    """
    plain = F.startswith(uri, F.lit("/")) & ~F.startswith(uri, F.lit("//"))
    cut = F.substring_index(F.substring_index(uri, "#", 1), "?", 1)
    return F.nullif(F.when(plain, cut).otherwise(F.regexp_extract(uri, _PATH, 1)), F.lit(""))


def rooted(found: Column) -> Column:
    """A path with a leading slash."""
    return F.when(F.startswith(found, F.lit("/")), found).otherwise(F.concat(F.lit("/"), found))


def referrer_from(found_scheme: Column, found_host: Column, found_path: Column) -> Column:
    """Host of a referrer; a bare text without scheme and host stands for itself."""
    return F.when(found_scheme.isNull() & found_host.isNull(), found_path).otherwise(found_host)


def referrer(uri: Column) -> Column:
    return referrer_from(scheme(uri), host(uri), path(uri))


def is_absolute(uri: Column) -> Column:
    """True when the URI has both a scheme and a host; NULL passes as NULL."""
    return F.when(uri.isNotNull(), scheme(uri).isNotNull() & host(uri).isNotNull())


def strip_www(name: Column) -> Column:
    """Drop leading ``www.`` labels."""
    return F.regexp_replace(name, "^(www[.])+", "")


def is_local_host(name: Column) -> Column:
    return F.regexp_like(name, F.lit(LOCAL_HOSTS))


def _sound_percent(text: Column) -> Column:
    """Escape percent signs that start no escape, so decoding keeps them."""
    return F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")


def percent_decode(text: Column) -> Column:
    """RFC 3986 decoding: ``+`` stays ``+`` and a malformed escape stays as it is."""
    decoded = F.try_url_decode(F.replace(_sound_percent(text), F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(text, F.lit("%")), decoded).otherwise(text)


def form_decode(text: Column) -> Column:
    """Form decoding: ``+`` is a space; a malformed escape stays as it is."""
    return F.try_url_decode(_sound_percent(text))


def query_pairs(query: Column, decode=percent_decode) -> Column:
    """Array of (key, value) in order of appearance; a key without ``=`` has value ''."""

    def pair(part: Column) -> Column:
        at = F.instr(part, "=")
        key = F.when(at > 0, F.substring_index(part, "=", 1)).otherwise(part)
        value = F.when(at > 0, F.substr(part, at + F.lit(1))).otherwise(F.lit(""))
        return F.struct(decode(key).alias("key"), decode(value).alias("value"))

    return F.transform(F.split(F.regexp_replace(query, "^[?]+", ""), "&"), pair)


def last_value(pairs: Column, key: str) -> Column:
    """Value of the last pair with that key; NULL when the key is missing."""
    return F.try_element_at(F.filter(pairs, lambda p: p["key"] == F.lit(key)), F.lit(-1))["value"]


def keep_allowed(query: Column, keys: Sequence[str] = ALLOWED_QUERY_KEYS) -> Column:
    """Query string cut down to the allowed keys, last duplicate wins, '' when none is left."""
    kept = F.filter(query_pairs(query, form_decode), lambda p: p["key"].isin(*keys))
    names = F.array_distinct(F.transform(kept, lambda p: p["key"]))

    def rendered(name: Column) -> Column:
        last = F.try_element_at(F.filter(kept, lambda p: p["key"] == name), F.lit(-1))["value"]
        return F.concat(name, F.lit("="), F.url_encode(last))

    body = F.array_join(F.transform(names, rendered), "&")
    return F.when(F.length(body) > 0, F.concat(F.lit("?"), body)).otherwise(F.lit(""))


def last_labels(name: Column, count: int) -> Column:
    """The last ``count`` labels of a host name."""
    return F.substring_index(name, ".", -count)
