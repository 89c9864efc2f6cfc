"""Column functions over URLs and keys made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts of single-publisher primaries beside any government's.
INSTITUTIONAL = ["arxiv.org", "nature.com", "science.org", "europa.eu", "courtlistener.com"]


def host_of(url: Column) -> Column:
    """Lower-cased host without one leading www.; an unparseable or missing URL gives ''."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(F.trim(url), F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def url_key(url: Column) -> Column:
    """What two URLs of one page have in common: no scheme, query, fragment, trailing slash or case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?i)^https?://", ""), r"[?#](?s:.*)$", ""), "/+$", ""))


def title_key(title: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9 ]", ""), 1, most)


def is_https(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https://"), F.lit(False))


def is_institutional(url: Column) -> Column:
    host = host_of(url)
    return host.rlike(r"(^|\.)gov(\.[a-z]{2})?$") | host.isin(INSTITUTIONAL)


def host_suffixes(host: Column) -> Column:
    """A host and all that remains after each of its dots: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def topic_search_url(base: str, query: Column, window: str = "2d") -> Column:
    """A topic feed's address: the query, limited to a window, percent-encoded."""
    return F.concat(F.lit(base), F.replace(F.url_encode(F.concat(F.lit(f"when:{window} "), query)), F.lit("+"), F.lit("%20")))
