"""The content test over pages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.content import page_content

PAGES = "page_id long, url string, html string"


def arriving_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet files of pages that appear in a folder."""
    return spark.readStream.schema(PAGES).parquet(folder)


def content_updates(pages: DataFrame, folder: str, checkpoint: str):
    """Starts a query that appends page_id, paragraphs and has_content of each arriving page to a folder, exactly once."""
    return page_content(pages).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
