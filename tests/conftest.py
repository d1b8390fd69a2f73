import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    shared = tempfile.TemporaryDirectory(prefix="ledgerseek-tests-")
    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared.name).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
    shared.cleanup()


@pytest.fixture(scope="session")
def same_as_duckdb(spark):
    """Runs a query and its statement on sf0.001 and compares all rows."""
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")

    def check(query, sql):
        got, want = query(spark, f"{DATA}/sf0.001").toArrow(), con.sql(sql).to_arrow_table()
        names = sorted(want.column_names)
        assert sorted(got.column_names) == names
        rows = lambda t: sorted(map(repr, zip(*(t[n].to_pylist() for n in names))))
        assert rows(got) == rows(want)

    return check
