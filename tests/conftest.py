import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
os.environ.setdefault("OMP_NUM_THREADS", "1")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(frame):
    """Rows as sorted tuples of columns by name; floats to nine digits, nulls as None."""
    import math

    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, float):
            return round(x, 9) + 0.0
        return x

    cols = sorted(frame.columns)
    return cols, sorted((tuple(cell(v) for v in row) for row in zip(*(frame[c].astype(object).where(frame[c].notna(), None) for c in cols))), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Whether a query and its SQL agree in columns, and in rows in any order."""

    def check(query, sql):
        ours, theirs = query(spark, sf_dir).toPandas(), duck.execute(sql).df()
        a, b = canonical(ours), canonical(theirs)
        assert a[0] == b[0]
        num = lambda rows: [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows]
        assert sorted(num(a[1]), key=repr) == sorted(num(b[1]), key=repr)

    return check
