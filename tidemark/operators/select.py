"""Which links of a catalog are entries of its series. A catalog is all rows with one catalog_id (null is one too).

What is compared with a catalog's mean is joined with its aggregates, which Spark counts up before it shuffles them: no
task gets all links of a catalog, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import above_mean, above_share_of_mean, similarity, z_score


def by_catalog(links: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """links with the other columns of facts, which has a row for each catalog_id; catalogs without an id meet too."""
    facts = facts.withColumnRenamed("catalog_id", "_catalog")
    return links.join(facts, F.col("catalog_id").eqNullSafe(F.col("_catalog")), how).drop("_catalog")


def scored(links: DataFrame, targets: DataFrame) -> DataFrame:
    """links (catalog_id, split_path, ...) with the similarity to the catalog's target (catalog_id, target_path).

    An equi-join; Spark broadcasts the targets if they are small enough by its own threshold.
    """
    return by_catalog(links, targets).withColumn("score", similarity(F.col("target_path"), F.col("split_path"))).drop("target_path")


def statistics(links: DataFrame) -> DataFrame:
    """Of each catalog: n links, the total, least and most score, their mean and population deviation."""
    return links.groupBy("catalog_id").agg(
        F.count("*").alias("n"), F.sum("score").alias("total"), F.min("score").alias("least"), F.max("score").alias("most"),
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"),
    )


_STATISTICS = ("n", "total", "least", "most", "mean", "deviation")


def z_scores(links: DataFrame) -> DataFrame:
    """links with z, the standard score in their catalog."""
    known = by_catalog(links, statistics(links))
    return known.withColumn("z", z_score(F.col("score"), F.col("mean"), F.col("deviation"))).drop(*_STATISTICS)


def keep_last(links: DataFrame, *more: str) -> DataFrame:
    """Of links with the same address, host and path (and more), the last of the catalog; an aggregate, so repeats are combined before they are shuffled."""
    keys = ["catalog_id", "url", "hostname", "path", *more]
    rest = F.struct(*(c for c in links.columns if c not in keys))
    last = links.groupBy(*keys).agg(F.max_by(rest, F.struct("page_no", "pos")).alias("last"))
    return last.select(*keys, "last.*").select(*links.columns)


def where_value(rows: DataFrame, value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """The rows whose value passes a test given as a function of columns."""
    return rows.where(keep(value))


def filter_links(links: DataFrame) -> DataFrame:
    """Links that score above their catalog's mean, the last of equal ones; all links of a catalog with one score only."""
    flat = F.col("least") == F.col("most")
    kept = by_catalog(links, statistics(links)).where(flat | above_mean(F.col("score"), F.col("n"), F.col("total")))
    # Only catalogs with several scores lose duplicates: a flat link's own place makes it unlike all others.
    kept = kept.withColumns({"flat_page": F.when(flat, F.col("page_no")), "flat_pos": F.when(flat, F.col("pos"))}).drop(*_STATISTICS)
    return keep_last(kept, "flat_page", "flat_pos").drop("flat_page", "flat_pos")


def mean_filter(links: DataFrame) -> DataFrame:
    """Links that score above four fifths of the mean of the links given."""
    return by_catalog(links, statistics(links)).where(above_share_of_mean(F.col("score"), F.col("n"), F.col("total"))).drop(*_STATISTICS)
