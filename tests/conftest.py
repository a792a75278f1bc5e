import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def compare(spark):
    """Rows of a query and of its SQL in DuckDB, as comparable sets."""
    import duckdb

    def run(query, sql, sf=SF):
        df = query(spark, sf)
        names = sorted(df.columns)
        norm = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
        got = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        out = con.execute(sql)
        cols = [x[0] for x in out.description]
        assert sorted(cols) == names
        want = sorted(tuple(norm(r[cols.index(c)]) for c in names) for r in out.fetchall())
        assert got == want

    return run
