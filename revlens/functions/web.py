"""Article addresses and user names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def title(url: Column) -> Column:
    """Percent-decoded last path segment; '+' stays, a malformed escape leaves it as it is."""
    segment = F.substring_index(url, "/", -1)
    return F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)


def domain(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 1)


def language(url: Column) -> Column:
    return F.substring_index(domain(url), ".", 1)


def api_url(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, _SCHEME, 1), F.lit("://"), domain(url), F.lit("/w/api.php"))


def is_ip(user: Column) -> Column:
    """1 for an anonymous user name: dotted quad without range check, or a loose IPv6 form."""
    v4 = user.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    v6 = user.rlike(r"^\[?[0-9a-fA-F:]+:[0-9a-fA-F]{1,4}\]?$")
    return F.coalesce(v4 | v6, F.lit(False)).cast("int")
