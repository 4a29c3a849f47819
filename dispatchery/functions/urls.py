"""Canonical URL keys, in JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.functions.text import alternation, strip

_SHAPE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _quote(part: Column) -> Column:
    """Decode then encode one query piece, so that one value has one spelling."""
    decoded = F.coalesce(F.try_url_decode(part), part)
    encoded = F.url_encode(decoded)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def host_of(url: Column) -> Column:
    """Lowercased host without credentials and port."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), _SHAPE, 2)
    bare = F.regexp_replace(authority, r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":[0-9]*$", ""))


def is_blocked(url: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r"^old\.", "")
    return host.isin(*K.BLOCKED_HOSTS)


def canonical_url(raw: Column) -> Column:
    """A stable key for a link. Input without a host comes back trimmed."""
    trimmed = strip(F.coalesce(raw, F.lit("")))
    # A bare `host/path` is read as https; other schemes without a host are left alone.
    bare = F.rlike(trimmed, F.lit(r"^[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)+(:[0-9]+)?([/?#]|$)"))
    url = F.when(bare, F.concat(F.lit("https://"), trimmed)).otherwise(trimmed)

    scheme = F.lower(F.regexp_extract(url, _SHAPE, 1))
    scheme = F.when(scheme.isin("", "http", "https"), F.lit("https")).otherwise(scheme)
    host = F.regexp_replace(host_of(url), f"^{alternation(K.MIRROR_LABELS)}\\.", "")
    port = F.regexp_extract(F.regexp_extract(url, _SHAPE, 2), r":([0-9]+)$", 1)
    port = F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))

    path = F.regexp_replace(F.regexp_extract(url, _SHAPE, 3), r"/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)

    tracked = f"^(?:{alternation(K.TRACKING_PREFIXES)}.*|{alternation(K.TRACKING_KEYS)})$"
    pairs = F.filter(F.split(F.regexp_extract(url, _SHAPE, 4), "&"), lambda p: p != "")
    spelled = F.transform(
        pairs,
        lambda p: F.struct(
            _quote(F.regexp_extract(p, r"^([^=]*)", 1)).alias("key"),
            _quote(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )
    kept = F.filter(spelled, lambda p: ~F.rlike(F.lower(p["key"]), F.lit(tracked)))
    query = F.array_join(
        F.transform(kept, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&"
    )
    query = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))

    usable = F.rlike(url, F.lit(_SHAPE)) & (host != "")
    return F.when(
        usable, F.concat(scheme, F.lit("://"), host, port, path, query)
    ).otherwise(trimmed)
