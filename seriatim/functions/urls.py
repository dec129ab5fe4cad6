"""URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of paths that no post has.
NO_POST = ("/tag/", "/category/", "/author/", "/page/", "/about", "/contact", "/privacy", "/terms", "/feed", "/sitemap", "/wp-content/", "/wp-admin/")


def authority(url: Column) -> Column:
    """Host and port."""
    return F.nullif(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def is_post(url: Column, site: Column) -> Column:
    """On the site, not its root, and no listing, account or feed path."""
    own = F.regexp_replace(path(url), "/+$", "")
    skipped = F.exists(F.array(*map(F.lit, NO_POST)), lambda x: F.contains(F.lower(own), x))
    return (authority(url) == authority(site)) & (own != "") & ~skipped


def is_archive_link(url: Column) -> Column:
    """At least two segments, or one of more than ten characters."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return (F.size(parts) >= 2) | ((F.size(parts) == 1) & (F.length(F.try_element_at(parts, F.lit(1))) > 10))


def slug_of(url: Column) -> Column:
    """The last segment of the path, without ``.html``."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1), r"\.html$", "")


def path_slug(url_path: Column) -> Column:
    """A whole path as a slug: ``/`` becomes ``-``, ``.html`` goes."""
    return F.replace(F.replace(F.regexp_replace(url_path, "^/+|/+$", ""), F.lit(".html"), F.lit("")), F.lit("/"), F.lit("-"))


def parameter(url: Column, name: str, default: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)), F.lit(default))


def is_absolute(url: Column, schemes: tuple[str, ...] = ("http://", "https://", "mailto:", "#")) -> Column:
    out = F.lit(False)
    for s in schemes:
        out = out | url.startswith(s)
    return out


def join(base: Column, href: Column) -> Column:
    """``href`` resolved against ``base`` (RFC 3986): scheme, host, path without dot segments, query and fragment, each from ``href`` or else, as far as it has none, from ``base``."""
    whole = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*:))?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"

    def part(u: Column, i: int) -> Column:
        return F.regexp_extract(u, whole, i)

    own, above = part(href, 3), F.regexp_replace(part(base, 3), "[^/]*$", "")
    rooted = F.when((above == "") & (part(base, 2) != ""), F.lit("/")).otherwise(above)
    merged = F.when(own.startswith("/"), own).otherwise(F.concat(rooted, own))
    steps = F.split(merged, "/")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.array_append(acc, x)))
    path_ = F.concat(F.array_join(walked, "/"), F.when(F.element_at(steps, -1).isin(".", "..") & ~F.array_join(walked, "/").endswith("/"), "/").otherwise(""))
    site, tail = F.concat(part(base, 1), part(base, 2)), F.concat(part(href, 4), part(href, 5))
    return (
        F.when(href == "", base)
        .when(part(href, 1) != "", href)
        .when(part(href, 2) != "", F.concat(part(base, 1), href))
        .when(own != "", F.concat(site, path_, tail))
        .when(part(href, 4) != "", F.concat(site, part(base, 3), tail))
        .otherwise(F.concat(site, part(base, 3), part(base, 4), part(href, 5)))
    )
