import os
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = ":".join(x for x in (HERE, os.environ.get("PYTHONPATH")) if x)

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.warehouse.dir", f"file://{shared}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    """A value as both engines give it, for comparing."""
    if x is None or x != x:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return round(x, 6)
    return int(x) if isinstance(x, int) else x


def same(df, con, sql):
    """Spark's rows equal DuckDB's, as bags."""
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    found = con.sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    want = [tuple(plain(r[k]) for k in at) for r in found.fetchall()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order(want)
