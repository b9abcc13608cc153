import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    tmp = tmp_path_factory.mktemp("spark")
    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp}/shared").config("spark.sql.warehouse.dir", f"{tmp}/wh").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _canon(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a Spark query and SQL give the same rows."""

    def check(query, sql):
        df = query(spark, DATA)
        got = df.collect()
        ref = duck.execute(sql)
        cols = [c[0] for c in ref.description]
        assert sorted(df.columns) == sorted(cols)
        order = sorted(cols)
        assert _canon([r[df.columns.index(c)] for c in order] for r in got) == _canon([r[cols.index(c)] for c in order] for r in ref.fetchall())

    return check
