"""The order in which a series is numbered.

A series is walked from row to row. After a row there is a slot for each of its numbers and one more: slot k is 1 more
than the slot of the row before that follows all its numbers up to the k-th of this row; slots before the place of the
first number of the row before, and the last one, are 0. The measure is the largest slot after the last row.

A slot thus is a number, or a number more than one slot before. What a range of rows does to the slots before it is of
that form too, whatever they are. So ranges are walked apart, and only what they do is put together for a catalog: no
task gets all its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import numbers
from ..storage import written
from .select import by_catalog


def _following(last: Column, now: Column, slots: Column, one_more: Callable[[Column], Column], zero: Column) -> Column:
    """Slots after the row now, from the slots after the row last."""
    upto = lambda row, x: F.size(F.filter(row, lambda e: e <= x))
    begin = F.greatest(upto(now, F.get(last, F.lit(0))) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.size(now)), lambda k: F.when((k >= begin) & (k < F.size(now)), one_more(F.get(slots, upto(last, F.get(now, k))))).otherwise(zero))


def _done(rows: Column) -> Column:
    """What an array of rows does to the slots after its first one: for each slot after the last row what to add to which (none: -1)."""
    unknown = lambda add, slot: F.struct(add.cast("int").alias("add"), slot.cast("int").alias("slot"))
    more = lambda s: unknown(s["add"] + 1, s["slot"])
    start = F.transform(F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0)))), lambda k: unknown(F.lit(0), k))
    step = lambda slots, i: _following(F.get(rows, i - 1), F.get(rows, i), slots, more, unknown(F.lit(0), F.lit(-1)))
    return F.when(F.size(rows) < 2, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(rows) - 1), start, step))


def _together(ranges: Column) -> Column:
    """The measure of a series from its ranges in order: structs of the first and last row and what is done between them."""
    applied = lambda done, slots: F.transform(done, lambda s: s["add"] + F.coalesce(F.get(slots, F.when(s["slot"] >= 0, s["slot"])), F.lit(0)))
    after = lambda x, slots: F.struct(x["last"].alias("last"), applied(x["done"], slots).alias("slots"))
    head = F.get(ranges, F.lit(0))
    start = after(head, F.array_repeat(F.lit(0), F.size(head["first"]) + 1))
    step = lambda acc, x: after(x, _following(acc["last"], x["first"], acc["slots"], lambda s: s + 1, F.lit(0)))
    return F.aggregate(F.slice(ranges, F.lit(2), F.size(ranges)), start, step, lambda acc: F.array_max(acc["slots"]))


def _range(rows: Column) -> Column:
    return F.struct(F.get(rows, F.lit(0)).alias("first"), F.element_at(rows, -1).alias("last"), _done(rows).alias("done"))


def fold(rows: Column) -> Column:
    """The measure of an array of ascending arrays; 0 with fewer than two rows."""
    return F.when(F.size(rows) < 2, F.lit(0)).otherwise(_together(F.array(_range(rows))))


def directions(links: DataFrame, ranges: int | None = None) -> DataFrame:
    """catalog_id and ascending: whether the catalog's order stays (it is reversed otherwise, also on a tie)."""
    rows = links.select("catalog_id", "page_no", "pos", numbers(F.col("path_params")).alias("numbers")).where(F.size("numbers") > 0)
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), "catalog_id", "page_no", "pos").withColumn("range", F.spark_partition_id())
    listed = dealt.groupBy("catalog_id", "range").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "pos", "numbers"))), lambda x: x["numbers"]).alias("rows"))
    walked = listed.select("catalog_id", F.struct("range", _range(F.col("rows")).alias("there"), _range(F.reverse("rows")).alias("back")).alias("x"))
    whole = walked.groupBy("catalog_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    there, back = F.transform("x", lambda x: x["there"]), F.reverse(F.transform("x", lambda x: x["back"]))
    return whole.select("catalog_id", _together(there).alias("forward"), _together(back).alias("backward")).withColumn("ascending", F.col("forward") > F.col("backward"))


def reversed_unless(links: DataFrame, known: DataFrame) -> DataFrame:
    """links with page_ord and pos_ord, the keys that put a catalog in its final order."""
    sign = F.when(F.coalesce(F.col("ascending"), F.lit(False)), 1).otherwise(-1)
    ordered = by_catalog(links, known.select("catalog_id", "ascending"), "left")
    return ordered.withColumns({"page_ord": F.col("page_no") * sign, "pos_ord": F.col("pos") * sign}).drop("ascending")


def ranked(rows: DataFrame, group: str, *by: str) -> DataFrame:
    """rows with rank, their place (from 1) in their group in the order of the columns by.

    The rows are dealt by ranges of all these columns and written, so that also a group with very many of them is counted by
    many tasks; each place is one in a range and what the ranges before it have.
    """
    dealt = written(rows.repartitionByRange(group, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*by))
    placed = dealt.withColumn("_own", own).join(sizes, (F.col("_range") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return placed.withColumn("rank", F.col("_before") + F.col("_own")).drop("_range", "_group", "_of", "_n", "_before", "_own")
