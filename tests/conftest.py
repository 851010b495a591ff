import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 5)
    return value


@pytest.fixture(scope="session")
def same(spark, duck):
    """Runs a registered query and its SQL and holds them against each other."""

    def check(query, sql):
        df = query(spark, SF)
        names = sorted(df.columns)
        got = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)
        answer = duck.execute(sql)
        have = [d[0] for d in answer.description]
        assert sorted(have) == names
        order = [have.index(c) for c in names]
        want = sorted((tuple(_plain(r[i]) for i in order) for r in answer.fetchall()), key=repr)
        assert got == want

    return check
