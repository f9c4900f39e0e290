import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_rows():
    """Whether a DataFrame has the rows that DuckDB gets from the tables of a folder."""
    import duckdb

    def rows(frame, columns):
        frame = frame[columns].astype(object)
        return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))

    def check(df, sql, folder=DATA, tables=None):
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
        for name, frame in (tables or {}).items():
            con.sql(f"drop view if exists {name}")
            con.register(name, frame)
        left, right = df.toPandas(), con.sql(sql).df()
        columns = sorted(left.columns)
        assert columns == sorted(right.columns)
        assert rows(left, columns) == rows(right, columns)

    return check
