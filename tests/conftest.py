import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from cairnlake.session import ship

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same():
    """Compare a query with its SQL on the smallest tables."""
    import glob

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")

    def plain(v):
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    def check(df, sql):
        r = c.execute(sql)
        names = [x[0] for x in r.description]
        theirs = sorted(str([plain(row[names.index(n)]) for n in sorted(names)]) for row in r.fetchall())
        ours = sorted(str([plain(row[n]) for n in sorted(df.columns)]) for row in df.collect())
        assert sorted(names) == sorted(df.columns)
        assert ours == theirs

    return check
