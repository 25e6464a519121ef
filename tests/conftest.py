import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{t}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def same_rows(spark, duck, query, sql):
    """The query's rows on the smallest tables are those of its SQL."""
    df = query(spark, SMALL)
    columns = sorted(df.columns)
    assert sorted(duck.sql(sql).columns) == columns
    got = sorted(str([plain(x) for x in row]) for row in df.select(*columns).collect())
    want = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})").fetchall()
    assert got == sorted(str([plain(x) for x in row]) for row in want)
