"""Whether a page has content: enough paragraphs, and not missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import open_paragraphs, toplevel_paragraphs

LEAST_PARAGRAPHS = 30


def has_content(paragraphs: Column, status: Column | None = None, least: int = LEAST_PARAGRAPHS) -> Column:
    """False for status 404 whatever the body; else by the number of paragraphs."""
    enough = paragraphs >= least
    return enough if status is None else F.when(status == 404, F.lit(False)).otherwise(enough)


def page_content(pages: DataFrame, how: str = "open", least: int = LEAST_PARAGRAPHS) -> DataFrame:
    """page_id, paragraphs and has_content; pages may have a status. how: 'open' or 'toplevel' paragraphs."""
    counted = {"open": open_paragraphs, "toplevel": toplevel_paragraphs}[how](F.col("html"))
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    return pages.select("page_id", counted.alias("paragraphs"), status.alias("status")).select("page_id", "paragraphs", has_content(F.col("paragraphs"), F.col("status"), least).alias("has_content"))
