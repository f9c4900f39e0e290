"""Documents under keys of their own, equal texts as one representative, and tables cut to a list of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize

#: A list of ids is broadcast to filter a table up to so many; beyond, the table is shuffled.
BROADCAST_IDS = 1_000_000


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id and text with a doc_id that no two rows share; None, or of each doc_id the id that its row came with).

    whole: with a column row, all columns of the row as they came.

    Ids that are there and do not repeat stay as they are, which is the rule. Otherwise each row is a document of its
    own: the rows are written in the order of their ids (those without one last), numbered from 0, and named(...) puts
    the ids back. So the least of some numbers always belongs to the least id.
    """
    more = ["row"] * whole
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.struct(*(f"`{c}`" for c in docs.columns)).alias("row")] * whole))
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs, None
    # By ranges of all columns, so that not even one id with a third of the rows is in one task.
    rows = docs.select(F.col("doc_id").alias("id"), "text", *more, F.xxhash64("text").alias("h"), F.rand(7).alias("tie"))
    order = [F.col("id").asc_nulls_last(), "h", "tie"]
    rows = materialize(materialize(rows, "rows").orderBy(*order).select(F.monotonically_increasing_id().alias("doc_id"), "id", "text", *more), "keyed")
    return rows.select("doc_id", "text", *more), rows.select("doc_id", "id")


def named(rows: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """rows with the ids that their documents came with, in the given columns (doc_id, if none are given)."""
    if names is None:
        return rows
    kept = rows.columns
    for c in columns or ("doc_id",):
        rows = rows.join(names.withColumnRenamed("doc_id", c), c).drop(c).withColumnRenamed("id", c)
    return rows.select(*kept)


def exact_copies(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id and rep, the least doc_id with an equal text, of all that are not it themselves; bytes of all texts).

    Texts are equal if two 64-bit hashes and the length are. Only hashes are shuffled, counted before that.
    """
    marked = materialize(docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), F.octet_length("text").alias("bytes")), "marks")
    same = materialize(marked.groupBy("h1", "h2", "bytes").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "groups")
    copies = join_counted(marked, same, ["h1", "h2", "bytes"]).where("doc_id <> rep").select("doc_id", "rep")
    return materialize(copies, "copies"), marked.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The documents whose doc_id is in ids (or, left_anti, is not); ids are broadcast only while they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)
