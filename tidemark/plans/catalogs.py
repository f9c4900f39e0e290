"""Whole plans over many catalogs at once: from fetched pages to the ordered entries of each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import links as link_ops
from ..operators.order import directions, ranked, reversed_unless
from ..operators.pagination import until_end
from ..operators.select import by_catalog, filter_links, mean_filter, scored
from ..storage import written

_PARTS = ("hostname", "path", "query", "protocol", "split_path", "path_params")


def page_parts(pages: DataFrame) -> DataFrame:
    """page_id, html and the normalised url with its components."""
    rows = pages.withColumn("url", urls.normalise(F.col("url"))).withColumn("parts", urls.parts(F.col("url")))
    return rows.select("page_id", "html", "url", *(F.col("parts")[c].alias(c) for c in _PARTS))


def site_catalogs(pages: DataFrame) -> DataFrame:
    """A catalog for each host: its pages' addresses in order of page_id."""
    rows = page_parts(pages).drop("html")
    return rows.select(F.col("hostname").alias("catalog_id"), F.lit(1).alias("page_no"), F.col("page_id").alias("pos"), "page_id", "url", *_PARTS)


def nav_catalogs(pages: DataFrame, how: str = "compat") -> DataFrame:
    """A catalog for each page: its anchors in order."""
    rows = page_parts(pages).select("page_id", "html", F.col("hostname").alias("page_host"), F.col("protocol").alias("page_protocol"))
    found = link_ops.extract(rows).withColumn("link", link_ops.resolve(F.col("href"), F.col("page_host"), F.col("page_protocol"), how))
    return found.select(F.col("page_id").alias("catalog_id"), F.lit(1).alias("page_no"), "pos", "page_id", "href", F.col("link.url").alias("url"), *(F.col("link")[c].alias(c) for c in _PARTS))


def host_nav_catalogs(pages: DataFrame) -> DataFrame:
    """A catalog for each host: the anchors of all its pages; the scheme is that of its first page."""
    rows = page_parts(pages)
    first = rows.groupBy(F.col("hostname").alias("page_host")).agg(F.min_by("protocol", "page_id").alias("page_protocol"))
    rows = rows.select("page_id", "html", F.col("hostname").alias("page_host")).join(first, "page_host")
    found = link_ops.extract(rows).withColumn("link", link_ops.resolve(F.col("href"), F.col("page_host"), F.col("page_protocol")))
    return found.select(F.col("page_host").alias("catalog_id"), F.col("page_id").alias("page_no"), "pos", "page_id", "href", F.col("link.url").alias("url"), *(F.col("link")[c].alias(c) for c in _PARTS))


def first_targets(links: DataFrame) -> DataFrame:
    """catalog_id and target_path: each catalog's first link."""
    return links.groupBy("catalog_id").agg(F.min_by("split_path", F.struct("page_no", "pos")).alias("target_path"))


def listing_links(responses: DataFrame, listings: DataFrame, how: str = "compat", title: str | None = None) -> DataFrame:
    """Links of fetched listing pages, up to where each listing ends.

    responses: catalog_id, page_no, request_url, final_url, status, body; listings: catalog_id, source_url.
    """
    own = listings.select("catalog_id", urls.parts(urls.normalise(F.col("source_url"))).alias("page")).select("catalog_id", F.col("page.hostname").alias("page_host"), F.col("page.protocol").alias("page_protocol"))
    pages = by_catalog(until_end(responses.where(F.col("page_no") <= urls.PAGES)).select("catalog_id", "page_no", F.col("body").alias("html")), own)
    found = link_ops.extract(pages, title=title).withColumn("link", link_ops.resolve(F.col("href"), F.col("page_host"), F.col("page_protocol"), how))
    return found.select("catalog_id", "page_no", "pos", "href", F.col("link.url").alias("url"), *(F.col("link")[c].alias(c) for c in _PARTS))


def targets(listings: DataFrame) -> DataFrame:
    """catalog_id and target_path of listings (catalog_id, target_url)."""
    return listings.select("catalog_id", urls.parts(urls.normalise(F.col("target_url")))["split_path"].alias("target_path"))


def _scored_once(links: DataFrame, target_paths: DataFrame) -> DataFrame:
    """The scored links, written, as their catalogs' aggregates are needed beside them: pages are read and parsed once."""
    return written(scored(links, target_paths).select("catalog_id", "page_no", "pos", "url", "hostname", "path", "path_params", "score"), "scored")


def get_links(links: DataFrame, target_paths: DataFrame) -> DataFrame:
    """catalog_id, rank (from 1), url and score of each catalog's entries, in the order of the series."""
    kept = written(filter_links(_scored_once(links, target_paths)), "kept")
    ordered = reversed_unless(kept, directions(kept)).select("catalog_id", "page_ord", "pos_ord", "url", "score")
    return ranked(ordered, "catalog_id", "page_ord", "pos_ord").select("catalog_id", "rank", "url", "score")


def batch(links: DataFrame, target_paths: DataFrame) -> DataFrame:
    """Entries after both filters, in the order in which they were found: catalog_id, page_no, pos, url, score."""
    kept = written(filter_links(_scored_once(links, target_paths)), "kept")
    return mean_filter(kept).select("catalog_id", "page_no", "pos", "url", "score")


def whole_listings(responses: DataFrame, listings: DataFrame, how: str = "compat", title: str | None = None) -> DataFrame:
    """get_links over fetched listings: catalog_id, source_url, target_url."""
    return get_links(listing_links(responses, listings, how, title), targets(listings))


def batch_of_pairs(responses: DataFrame, listings: DataFrame) -> DataFrame:
    """batch over fetched listings that are given with their targets: catalog_id, source_url, target_url."""
    return batch(listing_links(responses, listings), targets(listings))
