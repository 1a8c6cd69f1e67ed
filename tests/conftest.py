import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    """DuckDB with the tables of the test folder as views."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Compare a query with its SQL as bags of rows."""

    def compare(query, sql):
        df = query(spark, sf)
        found = df.collect()
        cur = duck.execute(sql)
        names = [c[0] for c in cur.description]
        rows = cur.fetchall()
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        ours = sorted(tuple(repr(r[n]) for n in order) for r in found)
        theirs = sorted(tuple(repr(r[names.index(n)]) for n in order) for r in rows)
        assert ours == theirs
        return found

    return compare
