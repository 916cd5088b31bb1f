"""URL columns: normal form, site, crawl patterns, document type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_url(url: Column) -> Column:
    """Without query, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), r"/+$", "")


def site(url: Column) -> Column:
    """Lower-case authority, port included, without one leading ``www.``; null where the URL has none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    return F.coalesce(site(a) == site(b), F.lit(False))


def root_domain(url: Column) -> Column:
    """The host's last two labels."""
    labels = F.split(F.try_parse_url(url, F.lit("HOST")), r"\.")
    return F.when(F.size(labels) > 2, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.concat_ws(".", labels))


def crawlable(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """No excluded pattern is found and, if there are any to include, one of those is."""
    out = F.lit(True)
    for pattern in exclude:
        out &= ~url.rlike(pattern)
    wanted = F.lit(not include)
    for pattern in include:
        wanted |= url.rlike(pattern)
    return out & wanted


# Document types, each with the parts of a URL that show it, in order of precedence.
DOC_TYPES = (
    ("release-notes", ("/release-notes", "/updates", "/releases")),
    ("api", ("/api",)),
    ("tutorial", ("/tutorial",)),
    ("cli", ("/commands/", "/cli")),
    ("docs", ("/docs/", "/documentation")),
    ("guide", ("/guide",)),
    ("reference", ("/reference",)),
)


def doc_type(url: Column) -> Column:
    low, out = F.lower(url), None
    for name, parts in DOC_TYPES:
        found = F.lit(False)
        for part in parts:
            found |= low.contains(part)
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise("docs")


def url_key(url: Column) -> Column:
    """Key of a page in the page cache."""
    return F.substring(F.sha2(url, 256), 1, 32)


def site_query(query: Column, site_name: Column) -> Column:
    """A web query, held to one site where that is given."""
    return F.when(F.coalesce(site_name, F.lit("")) != "", F.concat(F.lit("site:"), site_name, F.lit(" "), query)).otherwise(query)
