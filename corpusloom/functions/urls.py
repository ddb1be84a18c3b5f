"""URL expressions (Column to Column). A null url gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a crawl leaves out.
BAD_EXTENSIONS = ("pdf", "jpg", "jpeg", "png", "gif", "svg", "css", "js", "ico", "zip", "rar", "doc", "docx", "xls", "xlsx", "mp4", "webp")
BAD_PARTS = ("/ur-", "/ur/", "/api/", "graphql")
BAD_SCHEMES = ("mailto:", "tel:", "javascript:")

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 3)


def normalize(url: Column) -> Column:
    """Scheme, host with port and user, and path without trailing slashes; query and fragment go."""
    return F.concat(scheme(url), F.lit("://"), netloc(url), F.regexp_replace(path(url), "/+$", ""))


def is_internal(url: Column, base: Column) -> Column:
    return netloc(url) == netloc(base)


def is_valid(url: Column) -> Column:
    """Neither a file to leave out, nor an excluded section or scheme, nor a fragment."""
    bad = F.lower(url).rlike(r"\.(" + "|".join(BAD_EXTENSIONS) + ")$") | url.contains("#")
    for p in BAD_PARTS:
        bad = bad | url.contains(p)
    for s in BAD_SCHEMES:
        bad = bad | url.startswith(s)
    return ~bad


def resolve(base: Column, href: Column) -> Column:
    """A link against the base of its site: absolute, scheme-relative, rooted, empty or relative to the base's folder."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_replace(path(base), "[^/]*$", ""), F.lit("")), F.lit("/")))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when((href == "") | href.startswith("#") | href.startswith("?"), F.concat(root, path(base), href))
        .otherwise(F.concat(folder, href))
    )


def site_label(url: Column) -> Column:
    """The capitalised first label of the host without www., `page` if there is none."""
    first = F.regexp_extract(F.regexp_replace(netloc(url), r"www\.", ""), r"^([^.]*)", 1)
    return F.coalesce(F.nullif(F.concat(F.upper(F.left(first, F.lit(1))), F.lower(F.substring(first, 2, 1000))), F.lit("")), F.lit("page"))
