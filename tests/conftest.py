import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parents[1])
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_rows(spark):
    """Runs a query and its SQL on the same tables and compares their rows."""
    import glob

    import duckdb

    def check(run, sql, folder):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for p in glob.glob(f"{folder}/*.parquet"):
            con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{p}')")
        df = run(spark, folder)
        columns = sorted(df.columns)
        cell = lambda x: repr(round(x, 9)) if isinstance(x, float) else repr(x)
        got = sorted(tuple(map(cell, r)) for r in df.select(*columns).collect())
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert got == sorted(tuple(map(cell, r)) for r in want)

    return check
