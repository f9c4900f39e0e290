"""URL columns: normalisation, components, numbers. All functions take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: scheme, authority, path, query, fragment of a URL reference.
URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
#: Schemes whose last path segment may end in ;parameters that are not part of the path.
WITH_PARAMETERS = ("", "http", "https", "ftp")
#: Listing pages that are looked at, from 1.
PAGES = 19


def percent_decode(url: Column) -> Column:
    """Escapes decoded once; + and malformed escapes stay, bytes that are not UTF-8 become U+FFFD."""
    safe = F.regexp_replace(F.replace(url, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), url)


def strip_slashes(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def parts(url: Column) -> Column:
    """STRUCT<hostname, path, query, protocol, split_path, path_params> of a normalised URL; all null for null."""
    piece = lambda i: F.regexp_extract(url, URL, i)
    protocol = F.lower(piece(1))
    host = F.regexp_replace(piece(2), r"^.*@", "")
    host = F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)", 1)).otherwise(F.regexp_replace(host, r":[^:]*$", ""))
    path = F.when(protocol.isin(*WITH_PARAMETERS), F.regexp_replace(piece(3), r";[^/]*$", "")).otherwise(piece(3))
    query = piece(4)
    return F.struct(
        F.nullif(F.lower(host), F.lit("")).alias("hostname"),
        path.alias("path"),
        query.alias("query"),
        protocol.alias("protocol"),
        split_path(path).alias("split_path"),
        path_params(path, query).alias("path_params"),
    )


def normalise(url: Column) -> Column:
    """The URL as it is compared: decoded once, without trailing slashes."""
    return strip_slashes(percent_decode(url))


def split_path(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def path_params(path: Column, query: Column) -> Column:
    return F.concat(path, F.lit("?"), query)


def same_page(host: Column, path: Column, other_host: Column, other_path: Column) -> Column:
    """Equality of URLs: host and path only, null hosts equal."""
    return host.eqNullSafe(other_host) & (path == other_path)


def page_url(url: Column, query: Column, page: Column) -> Column:
    """The address of a later listing page."""
    return F.concat(url, F.when(query == "", F.lit("?page=")).otherwise(F.lit("&page=")), page.cast("string"))


def with_origin(url: Column, origin: str) -> Column:
    """origin before addresses that do not contain 'http'."""
    return F.when(url.contains("http"), url).otherwise(F.concat(F.lit(origin), url))


def current_url(current: Column, origin: Column) -> Column:
    return F.coalesce(F.nullif(current, F.lit("")), origin)


def join_classes(classes: Column) -> Column:
    return F.array_join(F.filter(classes, lambda c: c != ""), " ")


def numbers(params: Column) -> Column:
    """Distinct numbers of path?query in ascending order, as structs (size, digits); a number at the very end is not one.

    Structs of the number of digits and the digits compare as the numbers do, however large these are.
    """
    runs = F.regexp_extract_all(params, F.lit("0*([0-9]+)[^0-9]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(runs, lambda x: F.struct(F.length(x).alias("size"), x.alias("digits")))))


def digits(found: Column) -> Column:
    """Numbers as text."""
    return F.transform(found, lambda x: x["digits"])
