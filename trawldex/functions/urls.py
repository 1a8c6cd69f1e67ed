"""URL expressions: site, path, normalisation of links, file test, lenient equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the link rules.
FILE = r"^.*[.](?!html?)[^/]+$"
SITE = r"^(https?://[^/?#]+)"
HTTP_URL = r"^https?://(www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_\+.~#?&//=]*)$"


def site_of(url: Column) -> Column:
    return F.regexp_extract(url, SITE, 1)


def path_of(url: Column, site: Column) -> Column:
    return F.when(url == site, "/").otherwise(F.replace(url, site, F.lit("")))


def is_file(url: Column) -> Column:
    return url.rlike(FILE)


def is_http(url: Column) -> Column:
    return url.rlike(HTTP_URL)


def normalize(href: Column, site: Column) -> Column:
    """A link of a page of site: root and files become the site, root-relative links are put under it, query and fragment go.

    A fragment is only cut where there is no query, and one that starts the link stays.
    """
    url = F.when((href == "/") | is_file(href), site).otherwise(href)
    rooted = F.concat(F.regexp_replace(site, "/$", ""), url)
    url = F.when(url.startswith("/"), rooted).otherwise(url)
    return F.when(F.contains(url, F.lit("?")), F.substring_index(url, "?", 1)).when(F.locate("#", url) > 1, F.substring_index(url, "#", 1)).otherwise(url)


def in_scope(url: Column, site: Column) -> Column:
    """Containment, not prefix."""
    return F.contains(url, site)


def key(url: Column) -> Column:
    """Two urls are leniently equal when their keys are: one trailing slash does not count (urls of one character stay as they are)."""
    return F.when(F.char_length(url) <= 1, url).when(url.endswith("/"), url).otherwise(F.concat(url, F.lit("/")))


def contains_leniently(urls_: Column, url: Column) -> Column:
    """Whether an array of urls holds one that is leniently equal to url."""
    return F.exists(urls_, lambda u: key(u) == key(url))
