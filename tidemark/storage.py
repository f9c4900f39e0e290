"""Tables in the folder that driver and executors share, written to cut a plan where it is needed twice."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Scratch paths of this process that still stand.
_standing: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A session on this machine alone may do without; it gets a folder of its own."""
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{SETTING} is not set: name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _standing.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession, since: int = 0) -> None:
    """Removes the scratch tables made since so many stood; what was read from them must have been used."""
    for path in _standing[since:]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _standing.remove(path)


@contextmanager
def scratch_until_end(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are removed at the end."""
    since = len(_standing)
    try:
        yield
    finally:
        remove_scratch(spark, since)
