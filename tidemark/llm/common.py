"""What the operators of this subpackage share: written tables, samples, joins on hot keys, file access, batches of text."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written

#: Characters of text that a worker turns into arrays at once.
SLICE_CHARS = 4_000_000
#: Bytes that Spark and Python pass to each other at once.
BATCH_BYTES = 8_000_000
#: Rows that one key may bring to a task of a join, at least.
HOT_ROWS = 1_000
#: How a worker forgets what it remembers for tasks of one kind. Tasks of other kinds begin with that.
forgetting: list[Callable[[], None]] = []

# Workers serve many tasks; what one frees must not stay with the worker.
pa.set_memory_pool(pa.system_memory_pool())


def release() -> None:
    """Gives freed memory back to the machine."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def lean(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of one group after which freed memory is given back."""

    @wraps(f)
    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        release()
        return out

    return run


def bound_batches(spark: SparkSession) -> None:
    """Batches between the JVM and Python of a few MB, whatever the size of a row; both sides hold some of them.

    Spark reads this setting when a plan runs, so it has to be the session's own; a lower one stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name))
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there and survives lost executors."""
    bound_batches(df.sparkSession)
    return written(df, name)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI, for workers that read or write files of their own format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:{uri}")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS, remember: bool = False) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `chars` bytes of text, or one row. remember: the task uses what the worker remembers."""
    if not remember and forgetting:
        for forget in forgetting:
            forget()
        release()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + chars, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's texts; null reads as empty."""
    return [x or "" for x in batch[name].to_pylist()]


def _draw(rows: DataFrame, n: int, by: tuple[str, ...]) -> tuple[F.Column, F.Column]:
    """A number for each row by the hash of some columns, and whether it is so small that about 4 n of all rows have one as small."""
    span = 1 << 40
    number = F.pmod(F.xxhash64(F.lit("sample"), *by), F.lit(span))
    return number, number < min(span, 4 * n * span // max(1, rows.count()) + 1)


def bounded_sample(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """n rows (or all, if there are no more) by the hash of the columns by; few are sorted, however many partitions there are."""
    number, small = _draw(rows, n, by)
    return rows.where(small).orderBy(number, *by).limit(n)


def bounded_texts(rows: DataFrame, n: int, most_bytes: int, text: str, *by: str) -> DataFrame:
    """n different rows by the hash of the columns by, or as many as have no more bytes of text together (one at least)."""
    number, small = _draw(rows, n, by)
    listed = rows.where(small).select(number.alias("number"), F.octet_length(text).alias("bytes")).groupBy("number").agg(F.max("bytes").alias("bytes")).orderBy("number").limit(n).collect()
    total, last = 0, -1
    for r in listed:
        total += r["bytes"] or 0
        if last >= 0 and total > most_bytes:
            break
        last = r["number"]
    once = rows.withColumn("number", number).where(F.col("number") <= last).groupBy("number").agg(*(F.first(c).alias(c) for c in rows.columns))
    return once.orderBy("number").drop("number")


def join_counted(rows: DataFrame, groups: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """rows joined with groups, which has one row for each key and in n how many rows have it; both are written tables.

    Keys with very many rows would each keep one task busy. There are few of them, as each has a fixed share of all
    rows, so these groups are broadcast and only the rest is shuffled: no task gets more than that share of one key.
    """
    total = groups.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    least = max(HOT_ROWS, total // (4 * shuffle_width(rows.sparkSession)))
    hot = groups.where(F.col(n) > least)  # 4 for each partition at most
    if hot.isEmpty():
        return rows.join(groups, on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(groups.where(F.col(n) <= least), on)
    return rest.unionByName(rows.join(F.broadcast(hot), on))
