import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def normal(pdf):
    """Rows in a form in which the results of two engines compare."""

    def one(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 5) if isinstance(v, float) else str(v)

    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(one(v) for v in row) for row in pdf.astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    def check(name, queries, sql):
        if not os.path.isdir(DATA):
            pytest.skip("no test data")
        got, want = queries[name](spark, DATA).toPandas(), duck.execute(sql[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)

    return check
