"""Article addresses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.functions import fixed


def normalize_url(url: Column) -> Column:
    """http(s) addresses without fragment and tracking parameters, with a lower-case host; null for anything else.

    Path case and other parameters stay. Default ports go and an empty path becomes "/".
    """
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#]+)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(fixed.TRACKING_PARAMS))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    built = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), tail)
    return F.when(scheme.isin("http", "https") & (host != ""), built)


def domain(url: Column) -> Column:
    """Lower-case host name without a leading "www."; null where the address is none."""
    host = F.regexp_extract(normalize_url(url), r"^[a-z]+://([^/?#:]+)", 1)
    return F.when(normalize_url(url).isNotNull(), F.regexp_replace(host, r"^www\.", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(normalize_url(url), F.lit("http://x/")), r"^[a-z]+://[^/?#]+([^?#]*)", 1)


def fingerprint(url: Column) -> Column:
    """The first 16 hex digits of SHA-1 of the normalised (else trimmed, lower-case) address."""
    return F.substring(F.sha1(F.coalesce(normalize_url(url), F.lower(F.trim(url)))), 1, 16)


def source_quality(host: Column) -> Column:
    """"low-quality", "known" or "unknown" by the host or any parent domain; low quality is tested first."""
    labels = F.split(F.lower(host), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    within = lambda names: F.arrays_overlap(parents, F.array(*[F.lit(n) for n in names]))
    return F.when(within(fixed.LOW_QUALITY_DOMAINS), "low-quality").when(within(fixed.KNOWN_DOMAINS), "known").otherwise("unknown")
