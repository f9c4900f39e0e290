"""Pages of a listing: the addresses to ask for, and which answers belong to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls


def page_urls(listings: DataFrame, pages: int = urls.PAGES) -> DataFrame:
    """listings (url, query, ...) with a row for each page_no from 1; page 1 is the listing's own address."""
    rows = listings.withColumn("page_no", F.explode(F.sequence(F.lit(1), F.lit(pages))))
    later = urls.page_url(F.col("url"), F.col("query"), F.col("page_no"))
    return rows.withColumn("page_url", F.when(F.col("page_no") == 1, F.col("url")).otherwise(later))


def until_end(responses: DataFrame) -> DataFrame:
    """The responses of each catalog before the first bad one: not 200, empty, or a later page that led elsewhere.

    Addresses are those on the wire; both are normalised before they are compared.
    """
    elsewhere = (F.col("page_no") != 1) & ~urls.normalise(F.col("request_url")).eqNullSafe(urls.normalise(F.col("final_url")))
    bad = ~F.col("status").eqNullSafe(200) | (F.coalesce(F.col("body"), F.lit("")) == "") | elsewhere
    ahead = Window.partitionBy("catalog_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return responses.withColumn("ended", F.max(bad.cast("int")).over(ahead)).where("ended = 0").drop("ended")
