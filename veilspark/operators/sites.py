"""Restricting rows to the sites that are covered."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import SALTS, join_lookup

# Fixed values: (scheme, host) of the covered sites.
SITES = (
    ("https", "chat.openai.com"),
    ("https", "chatgpt.com"),
    ("https", "claude.ai"),
    ("https", "gemini.google.com"),
    ("https", "copilot.microsoft.com"),
    ("https", "poe.com"),
    ("https", "perplexity.ai"),
    ("https", "you.com"),
    ("https", "grok.com"),
    ("https", "x.com"),
)

# scheme, optional user info, host, optional port; any path
_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(?:[/?#]|$)"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _ORIGIN, 1))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _ORIGIN, 2))


def site_filter(
    df: DataFrame, url: str, sites: Iterable[tuple[str, str]] | DataFrame = SITES
) -> DataFrame:
    """Rows whose URL has exactly the scheme and host of a site, whatever its path.

    A list of sites becomes a plain predicate; a table ``(scheme, host)`` a semi join.
    """
    if isinstance(sites, DataFrame):
        keyed = df.withColumns({"scheme": url_scheme(F.col(url)), "host": url_host(F.col(url))})
        return join_lookup(keyed, sites.distinct(), ["scheme", "host"], "left_semi", SALTS).select(
            *df.columns
        )
    wanted = [f"{scheme}://{host}".lower() for scheme, host in sites]
    origin = F.concat(url_scheme(F.col(url)), F.lit("://"), url_host(F.col(url)))
    return df.where(origin.isin(wanted))
