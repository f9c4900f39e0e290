"""The table of tracked items: _id, name, originUrl, currUrl, all strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import current_url
from .web import request

ENVELOPE = "success boolean, data array<struct<_id: string, name: string, originUrl: string, currUrl: string>>"


def from_answers(answers: DataFrame, body: str = "body") -> DataFrame:
    """The items in JSON answers {success, data} that succeeded."""
    parsed = answers.select(F.from_json(F.col(body), ENVELOPE).alias("a"))
    return parsed.where("a.success").selectExpr("inline(a.data)")


def to_answer(items: DataFrame) -> Column:
    """An item as the JSON body that creates it, an empty currUrl replaced by originUrl."""
    return F.to_json(F.struct("name", "originUrl", current_url(F.col("currUrl"), F.col("originUrl")).alias("currUrl")))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def one(items: DataFrame, item_id: str) -> DataFrame:
    return items.where(F.col("_id") == item_id)


def names(items: DataFrame) -> DataFrame:
    return items.select("name")


def valid(items: DataFrame) -> DataFrame:
    """Items that may be added: name and originUrl must not be empty, currUrl defaults to originUrl."""
    good = items.where("name <> '' and originUrl <> ''")
    return good.withColumn("currUrl", current_url(F.col("currUrl"), F.col("originUrl"))).select("_id", "name", "originUrl", "currUrl")


def append(items: DataFrame, path: str) -> None:
    """Adds the items that are valid."""
    valid(items).write.mode("append").parquet(path)


def fetch(spark: SparkSession, origin: str) -> DataFrame:
    """The items that a server lists; none if it does not answer that it succeeded."""
    return from_answers(request(spark.createDataFrame([("/item/get-items",)], "path string"), F.col("path"), origin=origin), "answer")


def create(items: DataFrame, origin: str) -> DataFrame:
    """Sends the valid items to a server, one request each: the items with status and answer. Writing the result sends them."""
    rows = valid(items)
    return request(rows, F.lit("/item/create-item"), "POST", to_answer(rows), origin)
