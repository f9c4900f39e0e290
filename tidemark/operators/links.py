"""Links of pages: one row for each anchor, normalised, with missing hosts and schemes filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.html import hrefs


def extract(pages: DataFrame, html: str = "html", title: str | None = None) -> DataFrame:
    """A row for each anchor with a non-empty href: the other columns of pages, pos (from 0 in the page) and href.

    With the title 'youtube' (in any case) only addresses that contain 'watch' are links.
    """
    rest = [c for c in pages.columns if c != html]
    rows = pages.select(*rest, F.posexplode(hrefs(F.col(html))).alias("pos", "href")).where("href is not null and href <> ''")
    return rows.where(F.col("href").contains("watch")) if (title or "").lower() == "youtube" else rows


def resolve(href: Column, page_host: Column, page_protocol: Column, how: str = "compat") -> Column:
    """STRUCT<raw_url, url, hostname, path, query, protocol, split_path, path_params> of an href on a page.

    Path and query always are those of the href itself. compat: an address without a host is the page's host and the
    href, without a scheme it is the page's scheme, :// and the href, which replaces the former. rfc3986: relative
    addresses are put behind the page's scheme and host.
    """
    raw = urls.percent_decode(href)
    url = urls.strip_slashes(raw)
    own = urls.parts(url)
    host, protocol = own["hostname"], own["protocol"]
    if how == "compat":
        address = F.when(protocol == "", F.concat(page_protocol, F.lit("://"), href)).when(host.isNull(), F.concat(page_host, href)).otherwise(url)
    elif how == "rfc3986":
        rooted = F.when(href.startswith("/"), href).otherwise(F.concat(F.lit("/"), href))
        address = F.when(protocol != "", url).when(host.isNotNull(), F.concat(page_protocol, F.lit(":"), href)).otherwise(F.concat(page_protocol, F.lit("://"), page_host, rooted))
    else:
        raise ValueError(how)
    return F.struct(
        raw.alias("raw_url"),
        address.alias("url"),
        F.coalesce(host, page_host).alias("hostname"),
        own["path"].alias("path"),
        own["query"].alias("query"),
        F.when(protocol == "", page_protocol).otherwise(protocol).alias("protocol"),
        own["split_path"].alias("split_path"),
        own["path_params"].alias("path_params"),
    )
