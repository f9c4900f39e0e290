"""Where pages come from: a snapshot table, a database, or the network."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.urls import PAGES
from .web import Connections

RESPONSES = "catalog_id long, page_no int, request_url string, final_url string, status int, body string"
#: Characters of an address that go over the wire as they are.
_PLAIN = "/:?#[]@!$&'()*+,;=%~-._"


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The table of fetched pages: page_id, url, html."""
    return spark.read.parquet(f"{folder}/pages.parquet")


#: Pairs of a listing and an entry of its series.
EXAMPLE_PAIRS = [
    ("https://fourseasonsforest.wordpress.com/about-your-pride-and-my-prejudice/", "https://fourseasonsforest.wordpress.com/2021/12/14/about-your-pride-and-my-prejudice-01/"),
    ("https://lorenovels.com/surviving-in-a-romance-fantasy-novel/", "https://lorenovels.com/chapter-59-black-moon-unit-part-6/"),
    ("https://asuracomic.net/manga/magic-academys-genius-blinker/", "https://asuracomic.net/magic-academys-genius-blinker-chapter-22/"),
    ("https://www.lightnovelworld.co/novel/advent-of-the-three-calamities/chapters", "https://www.lightnovelworld.co/novel/advent-of-the-three-calamities-1678/chapter-4"),
    ("https://genesistls.com/series/the-academys-weakest-became-a-demon-limited-hunter/", "https://genesistls.com/demon-limited-hunter-chapter-1/"),
]


def pairs(spark: SparkSession, rows: list[tuple[str, str]] = EXAMPLE_PAIRS) -> DataFrame:
    """Listings given with a target: catalog_id in the order of the rows, source_url, target_url."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "catalog_id long, source_url string, target_url string")


def database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational database; needs its JDBC driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def page_address(listing: str, page: int) -> str:
    """The address to ask for: that of the listing, decoded once and without slashes at its end, and the page from 2 on."""
    from urllib.parse import quote, unquote, urlsplit

    base = unquote(listing).rstrip("/")
    if page > 1:
        base += f"{'&' if urlsplit(base).query else '?'}page={page}"
    # A % that is left begins an escape that was there twice, or none at all.
    return quote(base.replace("%", "%25"), safe=_PLAIN)


class _Listing(InputPartition):
    def __init__(self, catalog_id: int, url: str):
        self.catalog_id, self.url = catalog_id, url


class _ListingReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.pages = int(options.get("pages", PAGES))
        self.timeout = float(options.get("timeout", 30))

    def partitions(self):
        return [_Listing(i, u) for i, u in enumerate(self.urls)]

    def read(self, partition: _Listing) -> Iterator[tuple]:
        """Later pages are asked for only while the listing goes on; whatever fails is a row without status and ends it."""
        from urllib.parse import unquote

        connections = Connections(self.timeout)
        try:
            for n in range(1, self.pages + 1):
                url = partition.url
                try:
                    url = page_address(partition.url, n)
                    final, status, body = connections.ask(url)
                except Exception:  # an address or an answer that is none must not stop the other listings
                    final, status, body = url, None, ""
                yield partition.catalog_id, n, url, final, status, body
                if status != 200 or not body or n > 1 and unquote(final).rstrip("/") != unquote(url):
                    return
        finally:
            connections.close()


class ListingSource(DataSource):
    """Format 'listing': option urls has one listing address a line; one partition for each, as many as 19 pages."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return RESPONSES

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options)


def listings(spark: SparkSession, urls: list[str], pages: int = PAGES) -> DataFrame:
    """Fetched responses of the listings, catalog_id in the order of urls; addresses as they went over the wire."""
    spark.dataSource.register(ListingSource)
    return spark.read.format("listing").option("urls", "\n".join(urls)).option("pages", pages).load()
